"""Suffix-array dedup: remove byte strings that an earlier document already holds.

A window is a string of ``window`` bytes. Every window has an anchor: its leftmost
GRAM-byte string of least hash. Equal windows have equal anchors, so windows that share
an anchor (runs of them overlap into one short string) can be routed by the anchor's
hash and equal windows always meet. A repeat filter keeps back windows whose anchor,
taken with the bytes beside it, occurs in one document only.

The routed strings of a part are made distinct and cut into shards. Each shard gets a
suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's walk; a
stretch of the array with common prefixes of a window or more is one repeated window.
Shards of a part are merged by binary search of their sorted windows. What comes back
to each batch of documents is, for its strings, the smallest document id by window.

A batch sends each distinct string once, so anchors well inside a passage that a third
of all documents hold are met once a batch. Near the passage's edges strings reach into
what surrounds it and differ by document. Anchors with so many strings are found by
counting what batches send, and their windows are routed one by one, by their own hash:
equal windows still meet, and no part grows with one anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import MIX1, MIX2, blocks, column, frequency_sketch, mix, packed, repeat_filter, send_suspects, unpacked
from burnish.session import scratch_path

GRAM = 16
#: Bytes of documents handled at once, of a shard, and of the strings of one part.
BATCH = 16 << 20
SHARD = 2 << 20
PART = 10 << 20
#: Bytes of texts whose anchors are found in one go.
PIECE = 1 << 19
#: Slots that strings are counted in by anchor.
SLOTS = 1 << 20
#: Strings of one anchor that are always left together.
FEW = 64
LOW32 = np.uint64(0xFFFFFFFF)
HIGH32 = np.uint64(0xFFFFFFFF00000000)


# --- suffix arrays -------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Suffixes are sorted by eight bytes, then by twice as many each round; only groups
    that are still equal are sorted again, by the rank of what follows.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    first = np.ndarray((n,), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    order = np.argsort(first)
    keys = first[order]
    head = np.ones(n, dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    for key in np.unique(first[max(0, n - 7) :]):
        # zero padding makes a short end equal to zero bytes; the shorter comes first
        a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        real = np.minimum(n - order[a:b], 8)
        again = np.argsort(real, kind="stable")
        order[a:b] = order[a:b][again]
        head[a:b] |= np.append(False, np.diff(real[again]) > 0)[: b - a]
    del first, keys, padded
    at = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    h = 8
    while True:
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(open_):
            break
        rows = order[open_]
        follow = rows + h
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[rows]
        again = np.argsort(group * (n + 1) + after)
        rows, after, group = rows[again], after[again], group[again]
        order[open_] = rows
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[open_] = new
        rank[rows] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lane: int = 64) -> np.ndarray:
    """Common prefix with the suffix before in the array, up to ``cap``, by Kasai's walk.

    Going from a position to the next, the common prefix shrinks by one at most. The
    text is walked in many lanes of ``lane`` positions at once.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.int16), np.full(cap + 1, -1, dtype=np.int16)])
    out = np.zeros(n, dtype=np.int16)
    starts = np.arange(0, n, lane)
    have = np.zeros(len(starts), dtype=np.int64)
    for step in range(lane):
        here = starts + step
        live = np.flatnonzero(here < n)
        i = here[live]
        j = before[i]
        h = np.maximum(have[live] - 1, 0)
        h[j < 0] = 0
        going = np.flatnonzero(j >= 0)
        while len(going):
            a, b, k = i[going], j[going], h[going]
            # an end (-1) equals nothing, not even another end, as i and j differ
            same = (k < cap) & (padded[a + k] == padded[b + k]) & (padded[a + k] >= 0)
            going = going[same]
            h[going] += 1
        have[live] = h
        out[i] = h
    return out[order]


class Shard:
    """Distinct strings with the smallest document of each: by window, the smallest of all."""

    def __init__(self, strings: list[bytes], least: np.ndarray, window: int):
        self.window = window
        self.text = np.frombuffer(b"".join(strings), dtype=np.uint8)
        sizes = np.array([len(s) for s in strings])
        begin = np.cumsum(sizes) - sizes
        spots = sizes - window + 1
        self.string = np.repeat(np.arange(len(strings)), spots)  # of each window, in text order
        self.offset = np.arange(spots.sum()) - np.repeat(np.cumsum(spots) - spots, spots)
        where = begin[self.string] + self.offset
        order = suffix_array(self.text)
        shared = common_prefixes(self.text, order, window)
        spot = np.full(len(self.text), -1, dtype=np.int64)
        spot[where] = np.arange(len(where))
        run = np.cumsum(shared < window)
        mine = spot[order]
        valid = mine >= 0
        run, mine = run[valid], mine[valid]
        heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        self.least = np.minimum.reduceat(least[self.string[mine]], heads)  # by distinct window, in sorted order
        self.window_of = np.empty(len(where), dtype=np.int64)
        self.window_of[mine] = np.cumsum(np.append(True, run[1:] != run[:-1])) - 1
        self.first = where[mine[heads]]

    def windows(self) -> np.ndarray:
        """The distinct windows, sorted."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.window)
        return np.ascontiguousarray(view[self.first]).view(f"S{self.window}").ravel()

    def merge(self, other: Shard) -> None:
        """Windows of both get the smaller of the two smallest documents."""
        mine, theirs = self.windows(), other.windows()
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        same = np.flatnonzero(mine[at] == theirs)
        at = at[same]
        both = np.minimum(self.least[at], other.least[same])
        self.least[at] = other.least[same] = both

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(string, first window, last window, smallest document) of stretches of equal answers."""
        least = self.least[self.window_of]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (self.string[1:] != self.string[:-1]) | (least[1:] != least[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(least)) - 1
        return self.string[a], self.offset[a], self.offset[b], least[a]


def alike(strings: list[bytes], length: np.ndarray, gram: np.ndarray, window: int) -> np.ndarray:
    """Which of the distinct strings may share a window with another one.

    Only strings of one anchor can, and of those only strings that have a window of
    equal hash; a hash met by chance costs a needless place in a suffix array.
    """
    _, group, size = np.unique(gram, return_inverse=True, return_counts=True)
    shared = size[group] > 1
    picked = np.flatnonzero(shared)
    if not len(picked):
        return shared
    hashes, owners = [], []
    for a in range(0, len(picked), 1 << 14):
        some = picked[a : a + (1 << 14)]
        data = np.frombuffer(b"".join([strings[k] for k in some]) + bytes(2 * GRAM), dtype=np.uint8)
        g = grams(data)
        spots = length[some] - window + 1
        start = np.cumsum(length[some]) - length[some]
        at = np.repeat(start, spots) + np.arange(spots.sum()) - np.repeat(np.cumsum(spots) - spots, spots)
        h = np.zeros(len(at), dtype=np.uint64)
        for step in [*range(0, window - GRAM, GRAM), window - GRAM]:
            h = mix(h ^ g[at + step])
        hashes.append(h)
        owners.append(np.repeat(some, spots))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    same = (h[1:] == h[:-1]) & (owner[1:] != owner[:-1])
    shared[:] = False
    shared[owner[1:][same]] = True
    shared[owner[:-1][same]] = True
    return shared


# --- anchors -------------------------------------------------------------------


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place but the last ones of padded data."""
    n = len(data) - 2 * GRAM
    eight = np.ndarray((n + 8,), dtype="<u8", buffer=data.data, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    eight ^= eight >> np.uint64(29)
    out = eight[8:] * MIX1
    out += eight[:n]
    out ^= out >> np.uint64(32)
    out *= MIX2
    out ^= out >> np.uint64(32)
    return out


def reach(window: int) -> int:
    """How many bytes beside the anchor its left and right hashes take in.

    Every window that holds the anchor also holds as many bytes on one of its sides, so
    a window that occurs twice has a left or a right hash that does.
    """
    return min(GRAM, (window - GRAM + 1) // 2)


def halves(first, last, place, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have a window that holds the left hash's bytes, and one that holds the right one's."""
    more = reach(window)
    return first <= place - more, last >= place + GRAM + more - window


def anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text number, first, last window, anchor hash, left, right, place).

    Windows and the anchor's place count from the start of all texts joined; texts
    shorter than a window have none. ``left`` and ``right`` hash the anchor with the
    bytes before or after it, see ``reach``. Texts are taken a few at a time, so that
    the arrays stay small.
    """
    found, number, start, at = [], 0, 0, 0
    while at < len(texts):
        to, have = at, 0
        while to < len(texts) and (not have or have + len(texts[to]) <= PIECE):
            have += len(texts[to])
            to += 1
        which, first, last, gram, left, right, place = _anchors(texts[at:to], window)
        found.append((which + number, first + start, last + start, gram, left, right, place + start))
        number, start, at = number + to - at, start + have, to
    if not found:
        found.append(_anchors([], window))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(7))


def _anchors(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(texts) + bytes(2 * GRAM), dtype=np.uint8)
    n = len(data) - 2 * GRAM
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    empty = np.empty(0, dtype=np.int64)
    if n < window:
        none = np.empty(0, dtype=np.uint64)
        return empty, empty, empty, none, none, none, empty
    gram = grams(data)
    least = gram & HIGH32
    least |= np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost
    span, need = 1, window - GRAM + 1
    while span * 2 <= need:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if need > span:
        least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
    place = (least[: n - window + 1] & LOW32).astype(np.int64)
    # runs of one anchor, cut where a window would leave its text
    change = np.flatnonzero(place[1:] != place[:-1]) + 1
    long = sizes >= window
    begin, stop = (ends - sizes)[long], (ends - window + 1)[long]  # of the texts' windows
    first = np.union1d(change, begin)
    text = np.searchsorted(begin, first, side="right") - 1
    inside = (text >= 0) & (first < stop[np.maximum(text, 0)])
    last = np.minimum(np.append(first[1:], n - window + 1), stop[np.maximum(text, 0)])[inside] - 1
    first, text = first[inside], text[inside]
    at, more = place[first], reach(window)
    here = gram[at]
    left = mix(gram[np.maximum(at - more, 0)] * MIX1 ^ here)
    right = mix(gram[np.minimum(at + more, n - 1)] * MIX2 ^ here)
    return np.flatnonzero(long)[text], first, last, here, left, right, at


def slots_of(part: int, gram: np.ndarray) -> np.ndarray:
    """Where the strings of a part are counted, by their anchors' hashes."""
    return mix(gram.astype(np.uint64) | np.uint64(part) << np.uint64(32)) & np.uint64(SLOTS - 1)


def single_windows(strings: list[bytes], window: int, cells: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of strings, the cell of each and its number there, and the window at each place."""
    known: dict[bytes, int] = {}
    at = np.array([known.setdefault(s[k : k + window], len(known)) for s in strings for k in range(len(s) - window + 1)], dtype=np.int64)
    cell = (np.array([xxhash.xxh3_64_intdigest(w) for w in known], dtype=np.uint64) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    begin = np.searchsorted(cell[order], cell)
    number = np.empty(len(cell), dtype=np.int64)
    number[order] = np.arange(len(cell))
    return list(known), cell, number - begin, at


def grouped(kind: np.ndarray) -> list[np.ndarray]:
    """The places of each kind, in order."""
    order = np.argsort(kind, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(kind) else []


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack(a: np.ndarray, kind: str) -> bytes:
    return _small(np.ascontiguousarray(a, dtype=kind).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_whole(data), dtype=kind)


def written(rows: DataFrame, label: str) -> DataFrame:
    """Rows of packed bytes through a table in the shared folder, in row groups that take little memory."""
    path = scratch_path(rows.sparkSession, label)
    few = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    rows.write.options(compression="none", **few).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _bundles(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Documents in bundles of about ``size`` bytes: ids, row keys, texts."""
    ids, keys, texts, have = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(batch["id"], batch["rid"], batch["text"]):
            ids.append(i)
            keys.append(k)
            texts.append(t.encode())
            have += len(texts[-1])
            if have >= size:
                yield np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int64), texts
                ids, keys, texts, have = [], [], [], 0
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(keys, dtype=np.int64), texts


# --- the operator --------------------------------------------------------------


def drop_repeated_bytes(
    docs: DataFrame,
    window: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bits: int = 1 << 29,
    batch_bytes: int = BATCH,
    part_bytes: int = PART,
    shard_bytes: int = SHARD,
) -> DataFrame:
    """All rows and columns, and kept (binary), n_bytes, n_removed, n_spans.

    Texts are UTF-8 bytes. Each byte covered by a ``window``-byte string that also
    starts in a document with a smaller id is removed; matches overlap, never cross
    documents, and are judged on the input. n_spans counts maximal removed runs.

    Null text is empty. Rows with a null id are kept whole and remove nothing; rows of
    one id remove nothing from each other. Ids are integers. Extra columns pass
    through; columns named like the new ones are replaced. An empty table gives an
    empty table. The table is read four times and must give the same rows in the same
    order each time, as a written table does.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    texts = docs.select(column(id_col).cast("bigint").alias("id"), F.hash(column(text_col)).alias("rid"), column(text_col).alias("text"))
    texts = texts.filter((F.octet_length("text") >= window) & F.col("id").isNotNull())

    def hashes(batch: pd.DataFrame) -> np.ndarray:
        found = []
        for _, _, part in _bundles([batch], batch_bytes):
            which, first, last, _, left, right, place = anchors(part, window)
            on_left, on_right = halves(first, last, place, window)
            gram = np.concatenate([left[on_left], right[on_right]])
            which = np.concatenate([which[on_left], which[on_right]])
            # distinct within a document: equal pairs meet under one sort of their sum
            order = np.argsort(gram + which.astype(np.uint64) * MIX2)
            g, w = gram[order], which[order]
            keep = np.ones(len(g), dtype=bool)
            keep[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
            found.append(g[keep])
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)

    suspected = send_suspects(texts, repeat_filter(texts, hashes, filter_bits))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_parts = max(1, -(-total // (2 * part_bytes)))

    def runs(batches: Iterator[pd.DataFrame], make: Callable[..., Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        """What ``make`` makes of each bundle of documents and part."""
        suspects = suspected.value
        for ids, keys, part in _bundles(batches, batch_bytes):
            name = hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest()
            which, first, last, gram, left, right, place = anchors(part, window)
            on_left, on_right = halves(first, last, place, window)
            on_left &= suspects(left)
            on_right &= suspects(right)
            # windows that hold a hash's bytes which one document alone has are done
            more = reach(window)
            first = np.where(on_left, first, np.maximum(first, place + GRAM + more - window))
            last = np.where(on_right, last, np.minimum(last, place - more))
            hit = (on_left | on_right) & (first <= last)
            which, first, last, gram = which[hit], first[hit], last[hit], gram[hit]
            del left, right, place, on_left, on_right, hit
            if not len(which):
                continue
            base = np.cumsum([0, *map(len, part)])
            raw = b"".join(part)
            to = (mix(gram) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                own = order[a:b]
                known: dict[bytes, int] = {}
                spans = zip(first[own].tolist(), (last[own] + window).tolist())
                slot = np.array([known.setdefault(raw[x:y], len(known)) for x, y in spans])
                hashed = np.empty(len(known), dtype=np.uint32)
                hashed[slot] = gram[own] & LOW32
                key = int.from_bytes(name, "little", signed=True), int(to[own[0]])
                yield from make(*key, list(known), hashed, slot, ids, keys, which[own], first[own] - base[which[own]])

    def row(batch: int, part: int, fields: dict[str, str], facts: dict) -> pd.DataFrame:
        return pd.DataFrame({"batch": [batch], "part": [part]} | {c: [_pack(facts[c], kind)] for c, kind in fields.items()})

    asks = {"sizes": "<i4", "gram": "<u4", "least": "<i8", "most": "<i8"}
    holds = {"slot": "<i4", "number": "<i4", "first": "<i8", "id": "<i8", "rid": "<i4"}

    def ask(batch: int, part: int, strings: list[bytes], gram: np.ndarray, least: np.ndarray, most: np.ndarray) -> pd.DataFrame:
        facts = {"sizes": np.array([len(s) for s in strings]), "gram": gram, "least": least, "most": most}
        return row(batch, part, asks, facts).assign(strings=[_small(b"".join(strings))])

    def asking(batch, part, strings, gram, slot, ids, keys, which, first) -> Iterator[pd.DataFrame]:
        least = np.full(len(strings), np.iinfo(np.int64).max)
        most = np.full(len(strings), np.iinfo(np.int64).min)
        np.minimum.at(least, slot, ids[which])
        np.maximum.at(most, slot, ids[which])
        yield ask(batch, part, strings, gram, least, most)

    def sent(make: Callable[..., Iterator[pd.DataFrame]], fields: dict[str, str], more: str = "") -> DataFrame:
        schema = "batch bigint, part int, " + ", ".join(f"{c} binary" for c in fields) + more
        return texts.mapInPandas(lambda batches: runs(batches, make), schema)

    asked = written(sent(asking, asks, ", strings binary"), "asked")

    # anchors with many strings: their windows go one by one to cells, which are parts behind the others
    def anchored(rows: pd.DataFrame) -> np.ndarray:
        found = [slots_of(p, _unpack(g, "<u4")) for p, g in zip(rows["part"], rows["gram"])]
        return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)

    most_strings = max(FEW, part_bytes // (4 * (2 * window - GRAM)))
    hot = np.flatnonzero(frequency_sketch(asked.select("part", "gram"), anchored, SLOTS) > most_strings)
    cells = np.zeros(n_parts, dtype=np.int64)

    def wide(part: int, gram: np.ndarray) -> np.ndarray:
        return np.isin(slots_of(part, gram), hot)

    if len(hot):

        def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = [int(wide(p, _unpack(g, "<u4")).sum()) for p, g in zip(batch["part"], batch["gram"])]
                yield pd.DataFrame({"part": batch["part"], "n": n})

        counted = asked.select("part", "gram").mapInPandas(tally, "part int, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
        for r in counted.toLocalIterator():
            cells[r.part] = -(-r.n * (window - GRAM + 1) * window // part_bytes)
    cell_base = n_parts + np.cumsum(cells) - cells

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                gram = _unpack(r.gram, "<u4")
                apart = wide(r.part, gram)
                if not apart.any():
                    yield pd.DataFrame([r])
                    continue
                raw, ends = _whole(r.strings), np.cumsum(_unpack(r.sizes, "<i4"))
                strings = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                least, most = _unpack(r.least, "<i8"), _unpack(r.most, "<i8")
                if not apart.all():
                    stay = np.flatnonzero(~apart)
                    yield ask(r.batch, r.part, [strings[k] for k in stay], gram[stay], least[stay], most[stay])
                several = np.flatnonzero(apart)
                windows, cell, _, place = single_windows([strings[k] for k in several], window, cells[r.part])
                owner = np.repeat(several, [len(strings[k]) - window + 1 for k in several])
                low, high = np.full(len(windows), np.iinfo(np.int64).max), np.full(len(windows), np.iinfo(np.int64).min)
                np.minimum.at(low, place, least[owner])
                np.maximum.at(high, place, most[owner])
                near = np.empty(len(windows), dtype=np.uint32)
                near[place] = gram[owner]
                for some in grouped(cell):
                    to = int(cell_base[r.part] + cell[some[0]])
                    yield ask(r.batch, to, [windows[k] for k in some], near[some], low[some], high[some])

    def holding(batch, part, strings, gram, slot, ids, keys, which, first) -> Iterator[pd.DataFrame]:
        def hold(part: int, slot: np.ndarray, which: np.ndarray, first: np.ndarray) -> pd.DataFrame:
            used, number = np.unique(which, return_inverse=True)
            return row(batch, part, holds, {"slot": slot, "number": number, "first": first, "id": ids[used], "rid": keys[used]})

        apart = wide(part, gram)
        stay = ~apart[slot]
        if stay.any():
            yield hold(part, (np.cumsum(~apart) - 1)[slot[stay]], which[stay], first[stay])
        if not apart.any():
            return
        several = np.flatnonzero(apart)
        _, cell, number, place = single_windows([strings[k] for k in several], window, cells[part])
        spots = np.zeros(len(strings), dtype=np.int64)
        spots[several] = [len(strings[k]) - window + 1 for k in several]
        begin, many = np.cumsum(spots) - spots, spots[slot]
        run = np.repeat(np.arange(len(slot)), many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        met = place[begin[slot[run]] + offset]
        for some in grouped(cell[met]):
            to = int(cell_base[part] + cell[met[some[0]]])
            yield hold(to, number[met[some]], which[run[some]], first[run[some]] + offset[some])

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for (part,), piece in blocks(batches, ["part"]):
            if part != at and held:
                yield from settled(at, held)
                held = []
            at = part
            held.extend(piece.itertuples(index=False))
        if held:
            yield from settled(at, held)

    def settled(part: int, rows: list) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        slots, hashed = [], []
        for r in rows:
            raw, sizes = _whole(r.strings), _unpack(r.sizes, "<i4")
            ends = np.cumsum(sizes).tolist()
            slots.append(np.array([known.setdefault(raw[e - s : e], len(known)) for s, e in zip(sizes.tolist(), ends)]))
            hashed.append(_unpack(r.gram, "<u4"))
        strings = list(known)
        del known
        least, gram = np.full(len(strings), np.iinfo(np.int64).max), np.empty(len(strings), dtype=np.uint32)
        for r, slot, g in zip(rows, slots, hashed):
            least[slot] = np.minimum(least[slot], _unpack(r.least, "<i8"))
            gram[slot] = g
        # windows that only one string has have that string's documents; the rest is sorted
        length = np.array([len(s) for s in strings])
        shared = alike(strings, length, gram, window)
        lone, several = np.flatnonzero(~shared), np.flatnonzero(shared)
        found = [(lone, np.zeros(len(lone), dtype=np.int64), length[lone] - window, least[lone])]
        if len(several):
            shard_of = np.cumsum(length[several]) // shard_bytes
            cuts = [0, *(np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1).tolist(), len(several)]
            picks = [several[a:b] for a, b in zip(cuts, cuts[1:])]
            shards = [Shard([strings[k] for k in pick], least[pick], window) for pick in picks]
            for _ in range(2 if len(shards) > 2 else 1):  # the second round takes to earlier pairs what a later pair found
                for j in range(len(shards)):
                    for i in range(j):
                        shards[i].merge(shards[j])
            for shard, pick in zip(shards, picks):
                own, *rest = shard.pieces()
                found.append((pick[own], *rest))
        string, low, high, doc = (np.concatenate([f[k] for f in found]) for k in range(4))
        order = np.lexsort((low, string))
        string, low, high, doc = string[order], low[order], high[order], doc[order]
        begin = np.searchsorted(string, np.arange(len(strings)))
        count = np.diff(np.append(begin, len(string)))
        for r, slot in zip(rows, slots):
            many = count[slot]
            local = np.repeat(np.arange(len(slot)), many)
            piece = np.repeat(begin[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            keep = doc[piece] < _unpack(r.most, "<i8")[local]
            local, piece = local[keep], piece[keep]
            if len(local):
                yield pd.DataFrame(
                    {
                        "batch": [r.batch],
                        "part": [part],
                        "slot": [_pack(local, "<i4")],
                        "low": [_pack(low[piece], "<i4")],
                        "high": [_pack(high[piece], "<i4")],
                        "doc": [_pack(doc[piece], "<i8")],
                    }
                )

    dealt = asked.mapInPandas(deal, asked.schema) if len(hot) else asked
    answers = (
        dealt.repartition(4 * n_parts + int(cells.sum()), "part")  # so that few tasks get several parts
        .sortWithinPartitions("part")
        .mapInPandas(settle, "batch bigint, part int, slot binary, low binary, high binary, doc binary")
    )

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for (batch,), piece in blocks(batches, ["batch"]):
            if batch != at and held:
                yield removed(held)
                held = []
            at = batch
            for r in piece.itertuples(index=False):
                held.append(located(r))
        if held:
            yield removed(held)

    def located(r) -> tuple[np.ndarray, ...]:
        """The removed spans of one batch and part: id, rid, start, end."""
        slot, low, high, least = _unpack(r.p_slot, "<i4"), _unpack(r.low, "<i4"), _unpack(r.high, "<i4"), _unpack(r.doc, "<i8")
        use, number, first = _unpack(r.slot, "<i4"), _unpack(r.number, "<i4"), _unpack(r.first, "<i8")
        doc, rid = _unpack(r.id, "<i8")[number], _unpack(r.rid, "<i4")[number]
        a, b = np.searchsorted(slot, use, "left"), np.searchsorted(slot, use, "right")
        many = b - a
        row = np.repeat(np.arange(len(use)), many)
        piece = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        keep = least[piece] < doc[row]
        row, piece = row[keep], piece[keep]
        return doc[row], rid[row], first[row] + low[piece], first[row] + high[piece] + window

    def removed(held: list) -> pd.DataFrame:
        doc, rid, start, end = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((start, rid, doc))
        doc, rid, start, end = doc[order], rid[order], start[order], end[order]
        rows, i = [], 0
        cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]))) if len(doc) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(doc)) if len(doc) else []):
            s, e = start[a:b], np.maximum.accumulate(end[a:b])
            new = np.append(True, s[1:] > e[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
            rows.append((doc[a], rid[a], s[new], e[last]))
        return pd.DataFrame(rows, columns=["id", "rid", "starts", "ends"])

    held = sent(holding, holds)
    met = held.join(answers.withColumnRenamed("slot", "p_slot"), ["batch", "part"])
    cut = (
        met.repartition("batch")
        .sortWithinPartitions("batch")
        .mapInPandas(spans, "id bigint, rid int, starts array<bigint>, ends array<bigint>")
        # equal rows in several batches have equal spans
        .dropDuplicates(["id", "rid"])
    )

    @F.pandas_udf("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    def apply(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, e in zip(text, starts, ends):
            raw = _whole(t)
            if s is None or not len(s):
                out.append((raw, len(raw), 0, 0))
                continue
            edges = [0, *np.column_stack([s, e]).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((kept, len(raw), len(raw) - len(kept), len(s)))
        return pd.DataFrame(out, columns=list(new))

    @F.pandas_udf("binary")
    def small(text: pd.Series) -> pd.Series:
        return pd.Series([_small((t or "").encode()) for t in text])

    # texts move once, compressed
    rest = docs.select(
        packed(docs, (text_col,)).alias("row"), F.isnull(column(text_col)).alias("void"), column(id_col).cast("bigint").alias("id"), F.hash(column(text_col)).alias("rid"), small(column(text_col)).alias("text")
    )
    joined = rest.join(cut, ["id", "rid"], "left").select("row", "void", "text", apply("text", "starts", "ends").alias("cut"))

    @F.pandas_udf("string")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([_whole(t).decode() for t in text])

    values = {text_col: F.when(~F.col("void"), whole("text"))} | {c: F.col(f"cut.{c}") for c in new}
    order = [c for c in docs.columns if c not in new] + list(new)
    return joined.select(*unpacked(joined, "row", values)).select(*map(column, order))
