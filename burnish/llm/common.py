"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.session import checkpointed

#: A group is hot when it holds over 1/SHARE of all rows; so at most SHARE groups are.
SHARE = 10_000
#: Bits of one repeat filter (16 MiB) and the pieces it is merged in.
FILTER_BITS = 1 << 27
SEGMENTS = 64
#: Hashes that a task gathers before it makes filters of them; they need about 40 bytes each.
CHUNK = 1_000_000
#: Rows of a batch that are worked on at a time; texts may be long.
SLICE = 512

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near and equal-stepped inputs get unrelated outputs."""
    x = x ^ (x >> _S33)
    x = x * MIX1
    x = x ^ (x >> _S33)
    x = x * MIX2
    return x ^ (x >> _S33)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The columns of a table but ``without`` as one struct, so that no name can clash with an operator's own."""
    return F.struct(*[column(c) for c in df.columns if c not in without], F.lit(0).alias("_"))


def unpacked(df: DataFrame, row: str, columns: dict[str, Column]) -> list[Column]:
    """The packed columns again and ``columns``, which replace or follow them."""
    own = [f.name for f in df.schema[row].dataType.fields[:-1]]
    return [F.col(row).getField(c).alias(c) for c in own if c not in columns] + [v.alias(c) for c, v in columns.items()]


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to one entry per group, without a hot group meeting in one task.

    ``weight`` is a column of ``groups`` with the group's rows, ``total`` a bound on
    their sum. Entries of hot groups number at most SHARE and are broadcast; the
    others join by shuffle, and none of them has over total / SHARE rows. ``how`` is
    inner or left. Keys of ``rows`` must not be null.
    """
    hot = F.col(weight) * F.lit(SHARE) > F.lit(total)
    few, many = groups.filter(hot), groups.filter(~hot)
    marked = rows.join(F.broadcast(few.withColumn("_few", F.lit(True))), key, "left")
    cold = marked.filter("_few IS NULL").select(*rows.columns).join(many, key, how)
    names = [*rows.columns, *[c for c in groups.columns if c != key]]
    return marked.filter("_few").select(*names).unionByName(cold.select(*names))


# --- which hashes occur in two or more documents -------------------------------


def filter_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    m = np.uint64(bits - 1)
    return (hashes & m).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & m).astype(np.int64)


def distinct(ordered: np.ndarray) -> np.ndarray:
    """A sorted array without repetitions."""
    keep = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


def sorted_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The sorted distinct places of hashes; 32 bits are enough for any filter's."""
    both = np.empty(2 * len(hashes), dtype=np.uint32)
    both[: len(hashes)], both[len(hashes) :] = filter_places(hashes, bits)
    both.sort()
    return distinct(both)


def _pack(places: np.ndarray, size: int) -> bytes:
    """Set bits of a segment: gaps between sorted places where few are set, else all bits."""
    if len(places) * 16 < size:
        return b"s" + zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)
    flags = np.zeros(size, dtype=bool)
    flags[places] = True
    return b"d" + zlib.compress(np.packbits(flags).tobytes(), 1)


def _unpack(data: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(memoryview(data)[1:])
    if data[:1] == b"d":
        return np.frombuffer(raw, dtype=np.uint8)
    flags = np.zeros(size, dtype=bool)
    flags[np.cumsum(np.frombuffer(raw, dtype="<u4"), dtype=np.int64)] = True
    return np.packbits(flags)


def _or_into(bits: np.ndarray, data: bytes, size: int) -> np.ndarray:
    """The bits that ``bits`` and ``data`` share; ``bits`` then has those of both."""
    other = _unpack(data, size)
    shared = bits & other
    bits |= other
    return shared


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The batches in pieces of a few rows, which keeps what is made of each small."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows]


def short_batches(operator: Callable) -> Callable:
    """Python workers get batches of SLICE rows at most from all that ``operator``, on its first argument, runs itself.

    Texts, sets and filter segments are long; Spark's usual batch of them is held several
    times over, in the JVM and in each worker. What the returned table still has to
    run gets the session's own batches.
    """

    @functools.wraps(operator)
    def run(rows: DataFrame, *args, **kwargs):
        conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, str(min(int(before), SLICE) if int(before) > 0 else SLICE))
        try:
            return operator(rows, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


@short_batches
def repeat_filter(rows: DataFrame, hashes_of: Callable[[pd.DataFrame], np.ndarray], bits: int = FILTER_BITS) -> list[bytes]:
    """A Bloom filter of the hashes that two or more documents have, in compressed segments.

    ``hashes_of`` turns a batch into hashes, those of each document distinct. Each task
    makes two filters of up to CHUNK of its hashes at a time: those seen once, and
    those seen twice. When two such pairs meet, what both have seen once has been seen
    twice: twice = twice1 | twice2 | once1 & once2, bit by bit, so the merge loses
    nothing and only adds false suspects. The filter's size is fixed, whatever the
    input; beyond it more is suspected, and the exact steps behind it do the rest. The
    driver passes the segments on as they come and never holds the filter unpacked.
    """
    if bits > 1 << 32:
        raise ValueError("a filter has 2**32 bits at most")
    size = bits // SEGMENTS
    edges = np.arange(SEGMENTS + 1) * size

    def seen(found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        hashes = np.concatenate(found)
        found.clear()
        hashes.sort()
        first = np.ones(len(hashes), dtype=bool)
        np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
        twice = sorted_places(distinct(hashes[~first]), bits)
        hashes = hashes[first]
        once = sorted_places(hashes, bits)
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        for s in range(SEGMENTS):
            if a[s + 1] > a[s]:
                start = np.uint32(s * size)
                yield pd.DataFrame(
                    {
                        "segment": [s],
                        "once": [_pack(once[a[s] : a[s + 1]] - start, size)],
                        "twice": [_pack(twice[b[s] : b[s + 1]] - start, size)],
                    }
                )

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, have = [], 0
        for part in slices(batches):
            hashes = hashes_of(part)
            if not len(hashes):
                continue
            found.append(hashes)
            have += len(hashes)
            if have >= CHUNK:
                yield from seen(found)
                have = 0
        if have:
            yield from seen(found)

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(size // 8, dtype=np.uint8), np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            for a, b in zip(batch["once"], batch["twice"]):
                _or_into(twice, b, size)
                twice |= _or_into(once, a, size)
        yield pd.DataFrame({"segment": [key[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})

    partial = rows.mapInPandas(build, "segment int, once binary, twice binary")
    merged = partial.groupBy("segment").applyInPandas(merge, "segment int, twice binary")
    found = [zlib.compress(bytes(size // 8), 1)] * SEGMENTS
    for r in merged.toLocalIterator():
        found[r.segment] = bytes(r.twice)
    return found  # sent to every executor; most bits are 0


@short_batches
def hash_filter(rows: DataFrame, name: str, bits: int = FILTER_BITS) -> list[bytes]:
    """A Bloom filter of the hashes in a bigint column, in segments as those of ``repeat_filter``."""
    size = bits // SEGMENTS
    edges = np.arange(SEGMENTS + 1) * size

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, have = [], 0

        def segments() -> Iterator[pd.DataFrame]:
            places = sorted_places(np.concatenate(found), bits)
            found.clear()
            cuts = np.searchsorted(places, edges)
            for s in range(SEGMENTS):
                if cuts[s + 1] > cuts[s]:
                    yield pd.DataFrame({"segment": [s], "bits": [_pack(places[cuts[s] : cuts[s + 1]] - np.uint32(s * size), size)]})

        for batch in batches:
            found.append(batch[name].to_numpy(dtype=np.int64).view(np.uint64))
            have += len(batch)
            if have >= CHUNK:
                yield from segments()
                have = 0
        if have:
            yield from segments()

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(size // 8, dtype=np.uint8)
        for batch in batches:
            for data in batch["bits"]:
                whole |= _unpack(data, size)
        yield pd.DataFrame({"segment": [key[0]], "bits": [zlib.compress(whole.tobytes(), 1)]})

    schema = "segment int, bits binary"
    found = [zlib.compress(bytes(size // 8), 1)] * SEGMENTS
    for r in rows.select(name).mapInPandas(build, schema).groupBy("segment").applyInPandas(merge, schema).toLocalIterator():
        found[r.segment] = bytes(r.bits)
    return found


class Suspects:
    """Reads a filter of hashes."""

    def __init__(self, segments: list[bytes]):
        first = zlib.decompress(segments[0])
        self.bytes = np.empty(len(first) * len(segments), dtype=np.uint8)
        for s, data in enumerate(segments):
            self.bytes[s * len(first) : (s + 1) * len(first)] = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
        self.bits = len(self.bytes) * 8

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hashes), dtype=bool)
        for p in filter_places(hashes, self.bits):
            hit &= (self.bytes[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return hit


class Sent:
    """A filter on its way: it leaves in compressed segments and arrives as Suspects."""

    def __init__(self, segments: list[bytes]):
        self.segments = segments

    def __reduce__(self) -> tuple:
        return Suspects, (self.segments,)


def send_suspects(rows: DataFrame, segments: list[bytes]) -> Broadcast:
    """The filter for the tasks over ``rows``; a worker unpacks it once and keeps no compressed copy beside it."""
    return rows.sparkSession.sparkContext.broadcast(Sent(segments))


# --- connected components ------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach.

    Alternates large-star and small-star steps; each is a grouping and a join, and
    every round is cut through the shared folder. Nodes without an edge are absent.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        met = both.join(least, "a")
        if large:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
        return out.filter("a <> b").distinct()

    e = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = e.agg(mark.alias("m")).first().m
    for _ in range(max_rounds):
        if not before.n:
            break
        e = checkpointed(star(star(e, True), False), "edges")
        after = e.agg(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


# --- blocks of members that meet a stream of probes ----------------------------


def blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys in batches sorted by them; a run may come in several pieces."""
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.iloc[a:b]
            yield tuple(piece[k].iat[0] for k in keys), piece


def meet(
    members: DataFrame,
    probes: DataFrame,
    load: Callable[[pd.DataFrame], object],
    probe: Callable[[object, pd.DataFrame], pd.DataFrame | None],
    schema: str,
    key: str = "block",
    partitions: int | None = None,
) -> DataFrame:
    """Bring each block of members and the probes sent to it into one task.

    A task holds one block of members at a time; the probes pass by in Arrow batches.
    Both tables have the columns of ``members``. Blocks must be of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pieces, loaded = None, [], None
        for (k, side), piece in blocks(batches, [key, "_side"]):
            if k != at:
                at, pieces, loaded = k, [], None
            if side == 0:
                pieces.append(piece)
                continue
            if loaded is None:
                if not pieces:
                    continue
                loaded, pieces = load(pd.concat(pieces, ignore_index=True)), []
            out = probe(loaded, piece)
            if out is not None and len(out):
                yield out

    both = members.withColumn("_side", F.lit(0)).unionByName(probes.withColumn("_side", F.lit(1)))
    dealt = both.repartition(partitions, key) if partitions else both.repartition(key)
    return dealt.sortWithinPartitions(key, "_side").mapInPandas(run, schema)


def vectors_in_use(v: Column) -> Column:
    """True for vectors that are whole: not null, no null, NaN or infinite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


# --- about how often a hash occurs ---------------------------------------------


def frequency_sketch(rows: DataFrame, hashes_of: Callable[[pd.DataFrame], np.ndarray], slots: int = 1 << 20) -> np.ndarray:
    """Counts of the hashes by slot (an upper bound for each), summed over all rows; 4 bytes a slot."""
    step = slots // SEGMENTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            total += np.bincount((hashes_of(batch) & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint32)
        for s in range(SEGMENTS):
            part = total[s * step : (s + 1) * step]
            if part.any():
                yield pd.DataFrame({"segment": [s], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(step, dtype=np.uint32)
        for batch in batches:
            for c in batch["counts"]:
                total += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        yield pd.DataFrame({"segment": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "segment int, counts binary"
    whole = np.zeros(slots, dtype=np.uint32)
    for r in rows.mapInPandas(count, schema).groupBy("segment").applyInPandas(add, schema).toLocalIterator():
        whole[r.segment * step : (r.segment + 1) * step] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    return whole
