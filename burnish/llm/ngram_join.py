"""N-gram Jaccard join: documents whose shingle sets are alike, and their groups.

The incidence matrix of documents by shingles is multiplied with itself in blocks, and
every product counts overlaps. Size bounds thin it out at each step:

1. Linked sets share enough of their heads, the shingles of the smallest hashes. Heads
   are dealt out by hash and each bucket tells which of its hashes several rows have;
   only sets whose heads have enough of those are written, equal ones once, as one class.
   Of these a repeat filter drops the shingles that one alone has, which add to no
   overlap, and with them each set left with fewer than the overlap its size needs.
2. Classes with an equal least hash share a block; its product finds most links, and
   linked classes become one component.
3. What is missing are links between components. Two linked sets share one of the first
   r - need + 1 of their r shingles, counted from the rarest. Rows of a shingle are paired
   only within bands of sizes in which what follows the shingle can still make up a link;
   overlaps are counted for classes and other components and discarded below the bound
   that sizes set. What is left visits the other component's blocks, which multiply it
   with all its members.

Pairs inside a component are never listed: a chain of links is enough to group it, and
step 3 tests every pair between components that the bounds leave, so no group is split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import (
    CHUNK, SHARE, SLICE, attach, blocks, components, distinct, frequency_sketch, hash_filter, meet, mix, repeat_filter,
    send_suspects, short_batches, slices,
)
from burnish.session import checkpointed

#: Buckets that heads are dealt to, and the bits for a row's place in its chunk; a bucket
#: compares 32 more bits of a hash, so that its own number and those make 42.
BUCKETS, PLACE_BITS = 1024, 14
#: Seeds of the least hashes that step 2 blocks by.
KEYS = 2
#: Rows and shingles of one block of a product.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
#: Sizes of one band differ by this factor at most; and the share of an overlap that
#: is looked for in shared columns, which decides how far down a set they are read.
BAND, SLACK = 1.05, 0.03
#: Words whose hashes a task remembers.
CACHE_WORDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: Words, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; a shorter text is one shingle."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * STEP + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h))


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def head_of(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's smallest hashes its head has, and how many of them a linked set's head has at least.

    Linked sets share ``need`` hashes or more. Behind the k-th that they share, either set
    has need - k others; so it is among the first size - need + k of both, for any k.
    """
    need = -(-percent * size // 100)
    k = need - need // 2
    return size - need + k, k


def row_tags(digests: list[bytes], ids: np.ndarray) -> np.ndarray:
    """A hash of each row's digest and of the hash of its id."""
    return mix(np.frombuffer(b"".join(digests), dtype="<u8")[::2] ^ mix(ids.view(np.uint64)))


def pack_heads(heads: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """The heads of a chunk of rows by bucket: gaps between sorted hashes and the rows' places, byte by byte."""
    place = np.repeat(np.arange(len(heads), dtype=np.uint64), [len(h) for h in heads])
    h = np.concatenate(heads)
    bits = np.uint64(PLACE_BITS)
    entries = (h & np.uint64(BUCKETS - 1)) << np.uint64(32) | h >> np.uint64(BUCKETS.bit_length() - 1) & np.uint64(0xFFFFFFFF)
    entries = entries << bits | place
    entries.sort()
    edges = np.searchsorted(entries, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32 + PLACE_BITS)).tolist()
    hashes, place = (entries >> bits).astype("<u4"), (entries & np.uint64((1 << PLACE_BITS) - 1)).astype("<u2")
    for b, (low, high) in enumerate(zip(edges, edges[1:])):
        if high > low:
            gaps = np.diff(hashes[low:high], prepend=np.uint32(0))
            yield b, gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + place[low:high].view(np.uint8).reshape(-1, 2).T.tobytes()


def unpack_heads(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of a chunk's rows in a bucket, and the rows' places."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) // 6
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32), np.ascontiguousarray(raw[4 * n :].reshape(2, n).T).view("<u2").ravel()


def repeated_heads(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk the place of a row whenever one of its hashes is in the bucket twice; rosters pass as they are."""
    if key[0] >= BUCKETS:
        yield from (b[["chunk", "data"]].assign(roster=True) for b in batches)
        return
    chunks, hashes, places = [], [], []
    for batch in batches:
        for chunk, data in zip(batch["chunk"], batch["data"]):
            h, p = unpack_heads(data)
            chunks.append(chunk)
            hashes.append(h)
            places.append(p)
    every = np.concatenate(hashes)
    every.sort()
    twice = distinct(every[1:][every[1:] == every[:-1]])
    if not len(twice):
        return
    hits = [p[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h] for h, p in zip(hashes, places)]
    found = [i for i, hit in enumerate(hits) if len(hit)]
    yield pd.DataFrame({"chunk": [chunks[i] for i in found], "data": [hits[i].tobytes() for i in found], "roster": False})


def shared_enough(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a chunk whose heads have as many repeated hashes as a link needs."""
    hits, roster = [np.empty(0, dtype="<u2")], b""
    for batch in batches:
        for data, is_roster in zip(batch["data"], batch["roster"]):
            if is_roster:
                roster = data
            else:
                hits.append(np.frombuffer(data, dtype="<u2"))
    n = len(roster) // 28
    need = np.frombuffer(roster, dtype="<u4", offset=24 * n)
    keep = np.flatnonzero(np.bincount(np.concatenate(hits), minlength=n) >= need)
    tags = np.frombuffer(roster, dtype="<i8", count=n, offset=16 * n)
    yield pd.DataFrame({"digest": [roster[16 * i : 16 * i + 16] for i in keep], "tag": tags[keep]})


def linked(overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """overlap / union >= percent / 100, in integers."""
    return (100 + percent) * overlap >= percent * (size_a + size_b)


def product(sets: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all rows of a block with each other: the incidence matrix times itself.

    Columns that many rows share are multiplied as dense ones, the others pair by pair.
    """
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((m, m), dtype=np.int64)
    heavy = count > max(8, m // 16)
    number = np.cumsum(heavy) - 1
    for a in range(0, int(heavy.sum()), 2048):
        use = heavy[column] & (number[column] >= a) & (number[column] < a + 2048)
        dense = np.zeros((m, min(2048, int(heavy.sum()) - a)), dtype=np.float32)
        dense[rows[use], number[column[use]] - a] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    use = (count[column] > 1) & ~heavy[column]
    order = np.argsort(column[use], kind="stable")
    r, c = rows[use][order], column[use][order]
    flat = out.ravel()
    for shift in range(1, int(count[~heavy].max(initial=0))):
        same = c[shift:] == c[:-shift]
        a, b = r[:-shift][same], r[shift:][same]
        if not len(a):
            break
        flat += np.bincount(np.concatenate([a * m + b, b * m + a]), minlength=m * m)
    return out


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of m rows reaches over the links (a, b)."""
    label = np.arange(m)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def block_links(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Edges (a, b) that group the linked rows of each block, at most one a row.

    A bucket is worked off in blocks of bounded size; one member of each group of a
    block goes on into the next, so that groups grow together across blocks.
    """

    def close(cls: list, size: list, sets: list) -> tuple[pd.DataFrame, list[int]]:
        s = np.array(size)
        a, b = np.nonzero(np.triu(linked(product(sets), s[:, None], s[None, :], percent), 1))
        label = roots(len(sets), a, b)
        c = np.array(cls, dtype=np.int64)
        moved = np.flatnonzero(label != np.arange(len(sets)))
        kinds, members = np.unique(label, return_counts=True)
        stay = kinds[np.argsort(-members, kind="stable")][:64].tolist()
        return pd.DataFrame({"a": c[moved], "b": c[label[moved]]}), stay

    at, cls, size, sets, have = None, [], [], [], 0
    for key, piece in blocks(batches, ["key", "salt"]):
        if key != at:
            if len(sets) > 1:
                yield close(cls, size, sets)[0]
            at, cls, size, sets, have = key, [], [], [], 0
        for c, s, data in zip(piece["cls"], piece["size"], piece["set"]):
            cls.append(c)
            size.append(s)
            sets.append(unpack(data))
            have += len(sets[-1])
            if len(sets) >= BLOCK_ROWS or have >= BLOCK_SHINGLES and len(sets) > 1:
                edges, stay = close(cls, size, sets)
                yield edges
                if sum(len(sets[i]) for i in stay) > BLOCK_SHINGLES // 2:
                    stay = stay[:1]
                cls, size, sets = [cls[i] for i in stay], [size[i] for i in stay], [sets[i] for i in stay]
                have = sum(map(len, sets))
    if len(sets) > 1:
        yield close(cls, size, sets)[0]


class Members:
    """A block of a component: the shingles of its members, sorted, for overlap counts."""

    def __init__(self, block: pd.DataFrame):
        sets = [unpack(d) for d in block["set"]]
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        joined = np.concatenate(sets)
        order = np.argsort(joined, kind="stable")
        self.hashes, self.rows = joined[order], rows[order]
        self.cls, self.size = block["cls"].to_numpy(), block["size"].to_numpy()

    def links(self, probes: pd.DataFrame, percent: int) -> pd.DataFrame:
        """For each probe that links with a member, an edge to one such member."""
        a, b = [], []
        for c, s, data in zip(probes["cls"], probes["size"], probes["set"]):
            own = unpack(data)
            low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
            many = high - low
            place = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            overlap = np.bincount(self.rows[place], minlength=len(self.cls))
            hit = np.flatnonzero(linked(overlap, s, self.size, percent) & (self.cls != c))
            if len(hit):
                a.append(c)
                b.append(self.cls[hit[0]])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def overlap_bound(size: Column, other: Column, t: float) -> Column:
    """The overlap that two linked sets of these sizes have at least."""
    return (size + other) * F.lit(t / (1 + t))


def bands_of(low: Column, high: Column) -> Column:
    """The size bands from that of ``low`` to that of ``high``."""
    return F.sequence(band_of(low), band_of(high))


def band_of(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(np.log(BAND)) + F.lit(1e-9)).cast("int")


def band_low(band: Column) -> Column:
    """No size of the band is below this."""
    return F.pow(F.lit(BAND), band) * F.lit(1 - 1e-9)


def between(columns: DataFrame, comp_of: DataFrame, sets_of: DataFrame, percent: int, hub: bool) -> DataFrame:
    """Edges between components that have linked classes; at least one where there are any.

    Classes of the component with the larger label visit the other one, if they share
    enough columns. Say that two linked sets overlap by o at least, by their sizes. The
    m-th of the shingles they share, rarest first, leaves o - m or more behind it in
    either set; so a shingle with less than (1 - SLACK) * o of its set from it on
    (``rest``) need not be looked at, and more than SLACK * o of the others are shared,
    or, where prefixes end before, more than o - t * (the larger size).

    ``rest`` is compared before anything is paired: a row goes only to the bands of
    partner sizes that it can still reach, and a component has one row for each shingle,
    band of its members' sizes and band of partners. ``hub`` looks at the column's
    component of the smallest label only, which is where most belong.
    """
    t, size = percent / 100, F.col("size")
    met = columns.join(comp_of, "cls")
    ends = met.groupBy("shingle").agg(F.min("comp").alias("to"), F.max("comp").alias("_last")).filter("to < _last")
    reach = lambda rest, own, other: rest >= overlap_bound(own, other, t) * F.lit(1 - SLACK) - F.lit(1e-6)
    sums = F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("tail")
    if hub:
        met = checkpointed(met.join(ends.select("shingle", "to"), "shingle"), "open")
        to = met.filter("comp = to").groupBy("shingle").agg(*sums)
        asked = met.filter("comp > to").join(to, "shingle")
    else:
        met = checkpointed(met.join(ends, "shingle", "left_semi"), "open")
        bands = bands_of(F.ceil(size * F.lit(t) - F.lit(1e-6)), F.floor(size / F.lit(t) + F.lit(1e-6)))
        sent = met.withColumn("theirs", F.explode(bands)).withColumn("own", band_of(size))
        sent = sent.filter(reach(F.col("rest"), size, F.greatest(band_low(F.col("theirs")), size * F.lit(t))))
        sides = sent.groupBy("shingle", "own", "theirs", "comp").agg(*sums)
        turned = F.col("theirs").alias("own"), F.col("own").alias("theirs")
        sides = sides.select("shingle", *turned, F.col("comp").alias("to"), "low", "high", "tail")
        asked = sent.join(sides, ["shingle", "own", "theirs"]).filter("comp > to")
    low, high = F.col("low"), F.col("high")
    least, most = F.greatest(low, size * F.lit(t)), F.least(high, size / F.lit(t))  # sizes that can link
    fits = (size >= low * F.lit(t) - F.lit(1e-6)) & (high >= size * F.lit(t) - F.lit(1e-6))
    asked = asked.filter(fits & reach(F.least("rest", "tail"), size, least))
    by = ["cls", "size", "to"] if hub else ["cls", "size", "to", "theirs"]
    pairs = asked.groupBy(*by).agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))

    def shared(other: Column) -> Column:
        o = overlap_bound(size, other, t)
        return F.least(o * F.lit(SLACK), o - F.greatest(size, other) * F.lit(t))

    enough = F.floor(F.least(shared(least), shared(most)) - F.lit(1e-6)) + F.lit(1)
    asked = checkpointed(pairs.filter(F.col("c") >= enough).select("cls", "to").distinct(), "asked")
    # a component's blocks, by the shingles of its members
    wanted = asked.select(F.col("to").alias("comp")).distinct()
    held = comp_of.join(wanted, "comp", "left_semi").join(sets_of, "cls")
    cuts = held.groupBy("comp").agg(
        F.ceil(F.sum("kept") / F.lit(BLOCK_SHINGLES)).cast("int").alias("cuts"), F.count("*").alias("_n")
    )
    cuts = checkpointed(cuts, "cuts")
    total = cuts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    block = lambda comp, cut: F.xxhash64(comp, cut).alias("block")
    loaded = attach(held, cuts, "comp", "_n", total).select(
        "cls", "size", "set", block("comp", F.pmod(F.xxhash64("cls"), "cuts").cast("int"))
    )
    sent = asked.join(cuts.select(F.col("comp").alias("to"), "cuts"), "to").select(
        "cls", "to", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("_cut")
    )
    probes = sent.join(sets_of, "cls").select("cls", "size", "set", block("to", F.col("_cut")))
    found = meet(loaded, probes, Members, lambda m, p: m.links(p, percent), "a bigint, b bigint")
    return found.join(comp_of.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(
        comp_of.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b"
    ).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def merged(comp_of: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after joining those that the edges link."""
    roots_of = components(edges).select(F.col("node").alias("comp"), "root")
    out = comp_of.join(roots_of, "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp"))
    return checkpointed(out, "members")


@short_batches
def jaccard_groups(
    docs: DataFrame,
    n: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bits: int = 1 << 29,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    A set holds the distinct shingles of ``n`` words of the text, A-Z lower-cased, words
    being runs without ASCII white space; a shorter text's words are one shingle. Two
    rows link when their sets' Jaccard index is ``percent`` / 100 or more;
    component_id is the smallest id reachable over links, the row's own included.

    Null, empty and blank texts have no shingle, link with nothing and have their own
    id. Null ids are never the smallest unless all of a component are null. Repeated
    rows link like any others; rows of one id are rows of their own. Extra columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("row"))
    kind = rows.schema["id"].dataType.simpleString()

    words = Words()  # empty here; each task fills its own copy

    def digest_of(full: np.ndarray) -> bytes:
        return hashlib.blake2b(full.tobytes(), digest_size=16).digest()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk = TaskContext.get().partitionId(), 0
        found, digests, ids, need, have = [], [], [], [], 0

        def packed() -> pd.DataFrame:
            number = part << 32 | chunk
            data = dict(pack_heads(found))
            tags = row_tags(digests, np.array(ids, dtype=np.int64))
            data[BUCKETS + part] = b"".join(digests) + tags.astype("<u8").tobytes() + np.array(need, dtype="<u4").tobytes()
            return pd.DataFrame({"bucket": list(data), "chunk": number, "data": list(data.values())})

        for batch in slices(batches):
            for i, text in zip(batch["row"], batch["text"]):
                full = shingles(text, words, n)
                if not len(full):
                    continue
                length, k = head_of(len(full), percent)
                found.append(full[:length])
                digests.append(digest_of(full))
                ids.append(i)
                need.append(k)
                have += length
                if have >= CHUNK or len(found) >> PLACE_BITS:
                    yield packed()
                    chunk += 1
                    found, digests, ids, need, have = [], [], [], [], 0
        if found:
            yield packed()

    # rows whose heads others share; of each digest the row of the least tag
    dealt = rows.select("row", "text").filter("text IS NOT NULL").mapInPandas(heads, "bucket int, chunk bigint, data binary")
    repeats = dealt.groupBy("bucket").applyInPandas(repeated_heads, "chunk bigint, data binary, roster boolean")
    shared = repeats.groupBy("chunk").applyInPandas(shared_enough, "digest binary, tag bigint")
    wanted = send_suspects(rows, hash_filter(shared.groupBy("digest").agg(F.min("tag").alias("tag")), "tag"))

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = wanted.value
        for batch in slices(batches):
            sets = [shingles(text, words, n) for text in batch["text"]]
            digests = [digest_of(full) if len(full) else bytes(16) for full in sets]
            asked = chosen(row_tags(digests, batch["row"].to_numpy()))
            frame = pd.DataFrame(
                {
                    "id": batch["id"],
                    "size": [len(full) for full in sets],
                    "digest": [d if len(full) else None for d, full in zip(digests, sets)],
                    "set": [full.tobytes() if a and len(full) else None for a, full in zip(asked, sets)],
                }
            )
            yield frame.astype({"id": "Int64"} if kind in ("bigint", "int") else {})

    sets = checkpointed(rows.mapInPandas(outline, f"id {kind}, size bigint, digest binary, set binary"), "sets")
    wanted.destroy()

    # shingles of one set alone go, and sets that then cannot link
    chosen = sets.filter("set IS NOT NULL").select("digest", "size", "set")
    hashes = lambda batch: np.concatenate([unpack(d) for d in batch["set"]]) if len(batch) else np.empty(0, np.uint64)
    repeated = send_suspects(sets, repeat_filter(chosen.select("set"), hashes, filter_bits))

    def trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suspects = repeated.value
        for batch in slices(batches):
            out = []
            for digest, size, data in zip(batch["digest"], batch["size"], batch["set"]):
                own = unpack(data)
                own = own[suspects(own)]
                if 100 * len(own) >= percent * size:
                    least = [mix(own ^ np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)).min().astype(np.int64) for k in range(KEYS)]
                    out.append((digest, size, own.tobytes(), len(own), least))
            yield pd.DataFrame(out, columns=["digest", "size", "set", "kept", "least"])

    # equal sets by 128 bits; a class then has a number of its own
    alike = chosen.mapInPandas(trimmed, "digest binary, size bigint, set binary, kept bigint, least array<bigint>")
    grouped = alike.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("size", "set", "kept", "least")])
    classes = checkpointed(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    repeated.destroy()

    # step 2: products of classes with an equal least hash
    keyed = classes.select("cls", "size", "set", "kept", F.posexplode("least").alias("_at", "_least"))
    keyed = keyed.withColumn("key", F.xxhash64("_at", "_least"))
    weights = keyed.groupBy("key").agg(F.sum("kept").alias("_n"))
    total = weights.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first().n
    hot = weights.filter(F.col("_n") > max(8 * BLOCK_SHINGLES, total // SHARE))  # at most SHARE of them
    salt = F.pmod(F.xxhash64("cls"), F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(8 * BLOCK_SHINGLES))).cast("int")
    dealt = keyed.join(F.broadcast(hot), "key", "left").select("key", salt.alias("salt"), "cls", "size", "set")
    found = (
        dealt.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInPandas(lambda b: block_links(b, percent), "a bigint, b bigint")
    )
    first = components(found)
    comp_of = classes.select("cls").join(first.select(F.col("node").alias("cls"), "root"), "cls", "left")
    comp_of = checkpointed(comp_of.select("cls", F.coalesce("root", "cls").alias("comp")), "members")

    # step 3: links between components
    sketch = frequency_sketch(classes.select("set"), hashes)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 4 * SLICE):
            heads, rests = [], []
            for data, size in zip(batch["set"], batch["size"]):
                own = unpack(data)
                often = np.log2(sketch[(own & np.uint64(len(sketch) - 1)).astype(np.int64)] + 1).astype(np.int64)
                need = -(-percent * int(size) // 100)
                heads.append(own[np.lexsort((own, often))][: len(own) - need + 1].astype(np.int64))
                rests.append(np.arange(len(own), need - 1, -1))
            many = [len(h) for h in heads]
            yield pd.DataFrame(
                {
                    "shingle": np.concatenate(heads),
                    "rest": np.concatenate(rests),
                    **{c: np.repeat(batch[c].to_numpy(), many) for c in ("cls", "size")},
                }
            )

    heads = classes.select("cls", "size", "set").mapInPandas(prefixes, "shingle bigint, rest bigint, cls bigint, size bigint")
    columns = checkpointed(heads, "columns")
    sets_of = classes.select("cls", "size", "kept", "set")
    # first towards one component of each column, which thins them out; then between all
    for hub in (True, False):
        comp_of = merged(comp_of, between(columns, comp_of, sets_of, percent, hub))

    # smallest id by component; a digest without a class is a component
    each = sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    roots_of = classes.select("cls", "digest").join(comp_of, "cls").select("digest", F.col("comp").alias("root"))
    each = checkpointed(each.join(roots_of, "digest", "left"), "ids")
    several = each.filter("root IS NOT NULL")
    whole = several.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("_n"))
    named = attach(several, whole, "root", "_n", several.count()).select("digest", "n", "component_id")
    named = checkpointed(named.unionByName(each.filter("root IS NULL").select("digest", "n", F.col("low").alias("component_id"))), "named")
    full = sets.filter("digest IS NOT NULL").select("id", "size", "digest")
    labelled = attach(full, named, "digest", "n", full.count())
    empty = sets.filter("digest IS NULL").select("id", "size", F.col("id").alias("component_id"))
    return labelled.select("id", "size", "component_id").unionByName(empty).select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id"
    )
