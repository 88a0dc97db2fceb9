"""Merkle manifest of a dataset: one root digest, and a proof for every document.

Documents are the leaves of one tree per source, the sources' roots those of a tree
above. Inner nodes are kept by content: a table of records, from a node's digest to its
children's digests. Proofs are read from that table alone. All requests start at the
root together and descend by the hexadecimal digits of their ranks; requests that still
share a node travel as one row, which splits over the node's children and takes the
digests of those not chosen along. Reversed, these are the segments of a proof.

Ranks come from one range partitioning: counts by partition and source say where each
part of a source begins, so a source may fill any share of the rows. No node has more
than FANOUT children and no task ever holds more than a partition or a run of children.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.llm.common import attach, column
from burnish.session import checkpointed

#: Children of a node, and the bits that a node's number has more than its parent's.
FANOUT, BITS = 16, 4
#: Bytes of a digest.
SIZE = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(digests: Column) -> Column:
    """The digest of digests put together, taken as hexadecimal text."""
    return F.unhex(F.sha2(hexed(digests).cast("binary"), 256))


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as '-' if null, else its length in UTF-8 bytes, ':' and itself."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def joined(digests: Column) -> Column:
    """An array of digests as one value."""
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def ranked(leaves: DataFrame) -> DataFrame:
    """The rows with ``s``, the source's number, ``r``, their rank in it, and ``n``, its rows.

    Rows go by id, then by digest; equal rows in any order, which no digest shows.
    """
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf", "tie")]
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = checkpointed(placed.select("*", F.shiftright("at", 33).alias("part")).drop("tie"), "placed")
    # one entry for each partition and source in it: sources and partitions are few beside the rows
    entries = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    of_source = Window.partitionBy("source")
    earlier = of_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.select(
        "*", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"), F.sum("k").over(of_source).alias("n")
    )
    opens = (F.col("before") == 0).cast("bigint")
    by_source = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())
    entries = checkpointed(entries.select("*", F.sum(opens).over(by_source).alias("nth"), opens.alias("opens")), "entries")
    # a row a partition
    opened = entries.groupBy("part").agg(F.sum("opens").alias("m"))
    shift = opened.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("shift"))
    number = F.max(F.when(F.col("before") == 0, F.col("shift") + F.col("nth") - 1)).over(of_source)
    entries = entries.join(shift, "part").select(
        "part", F.col("source").alias("_source"), (F.col("first") - F.col("before")).alias("zero"), "n", number.alias("s")
    )
    met = placed.join(entries, (placed["part"] == entries["part"]) & placed["source"].eqNullSafe(F.col("_source")))
    return met.select("id", "leaf", "changed", "s", (F.col("at") - F.col("zero")).alias("r"), "n")


def climb(nodes: DataFrame, of_leaves: bool) -> tuple[list[DataFrame], DataFrame, int]:
    """Records (digest, children, bottom) by level, the one node (s, digest) left of each tree, and the levels.

    ``nodes`` has (s, i, n, digest): the i-th of the n nodes of tree s. Trees of one node
    are done; of the others every FANOUT consecutive nodes become one.
    """
    records, tops, level = [], [], 0
    run = F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x.digest)
    while True:
        tops.append(nodes.filter("n = 1").select("s", "digest"))
        rest = nodes.filter("n > 1")
        if rest.isEmpty():
            break
        up = rest.groupBy("s", F.shiftright("i", BITS).alias("i")).agg(F.first("n").alias("n"), joined(run).alias("children"))
        size = F.floor((F.col("n") + F.lit(FANOUT - 1)) / F.lit(FANOUT)).cast("bigint")
        up = checkpointed(up.select("s", "i", size.alias("n"), "children", digest_of(F.col("children")).alias("digest")), "level")
        records.append(up.select("digest", "children", F.lit(of_leaves and level == 0).alias("bottom")))
        nodes, level = up.select("s", "i", "n", "digest"), level + 1
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return records, top, level


def descend(spark: SparkSession, root: bytes, records: DataFrame, levels: int, total: int) -> DataFrame:
    """Where all requests arrive: (s, r, subroot, path, digits, children).

    A row is a node above leaves, whose digests are ``children``, and the r-th such node
    of tree s; or a leaf that is a whole tree, without children. ``path`` has the digests
    not chosen on the way from the root, ``digits`` the places of those chosen.
    ``levels`` lie between the root and the subroots.
    """
    front = spark.createDataFrame(
        [(bytearray(root), 0, 0, None, [], [])],
        "digest binary, s bigint, r bigint, subroot binary, path array<binary>, digits array<int>",
    )
    arrived, depth = [], 0
    while True:
        if depth == levels:
            front = front.withColumn("subroot", F.col("digest"))
        met = checkpointed(attach(front, records, "digest", "times", total, "left"), "front")
        below = F.col("children").isNull() if depth >= levels else F.lit(False)
        done = below | F.coalesce(F.col("bottom"), F.lit(False))
        arrived.append(met.filter(done).select("s", "r", "subroot", "path", "digits", "children"))
        going = met.filter(~done)
        if going.isEmpty():
            break
        kids = F.transform(
            F.sequence(F.lit(0), (F.octet_length("children") / F.lit(SIZE)).cast("int") - F.lit(1)),
            lambda j: F.struct(
                j.alias("j"),
                F.substring(F.col("children"), j * F.lit(SIZE) + F.lit(1), F.lit(SIZE)).alias("digest"),
                F.concat(
                    F.substring(F.col("children"), F.lit(1), j * F.lit(SIZE)),
                    F.substring(F.col("children"), (j + F.lit(1)) * F.lit(SIZE) + F.lit(1), F.octet_length("children")),
                ).alias("others"),
            ),
        )
        split = going.select("s", "r", "subroot", "path", "digits", F.explode(kids).alias("kid"))
        digit = F.col("kid.j")
        front = split.select(
            F.col("kid.digest").alias("digest"),
            (F.col("s") * FANOUT + digit if depth < levels else F.col("s")).alias("s"),
            (F.col("r") * FANOUT + digit if depth >= levels else F.col("r")).alias("r"),
            "subroot",
            F.concat("path", F.array("kid.others")).alias("path"),
            F.concat("digits", F.array(digit)).alias("digits"),
        )
        depth += 1
    out = arrived[0]
    for a in arrived[1:]:
        out = out.unionByName(a)
    return out


def sha(digests: bytes) -> bytes:
    return hashlib.sha256(digests.hex().encode()).digest()


def folded(leaf: bytes, segments: list[bytes], digits: list[int]) -> bytes:
    """The root that a leaf and the digests beside its way up, lowest first, give."""
    for others, j in zip(segments, digits):
        leaf = sha(others[: SIZE * j] + leaf + others[SIZE * j :])
    return leaf


def prove(leaves: list[bytes], path: list[bytes], digits: list[int], children: bytes | None, own: list[int]) -> tuple[list, list]:
    """For leaves at places ``own`` of one node: the digests of their proofs, and the roots they fold to."""
    path, digits = [bytes(p) for p in reversed(path)], list(reversed(digits))
    above = b"".join(path)
    proofs, roots = [], []
    for leaf, j in zip(leaves, own):
        low = [] if children is None else [children[: SIZE * j] + children[SIZE * (j + 1) :]]
        proofs.append(sha(b"".join(low) + above).hex())
        roots.append(folded(bytes(leaf), low + path, ([] if children is None else [j]) + digits).hex())
    return proofs, roots


def merkle_manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row, digests as hexadecimal.

    A leaf is the digest of a row's ``fields``. Each source's leaves, by id, and the
    sources' roots, null first and then by their bytes, are hashed in runs of FANOUT
    until one node is left. ``proof_sha256`` is the digest of a leaf's proof: the other
    nodes of its run, level by level up to the root. ``folded_root`` is what leaf and
    proof give, where ``tampered`` is true with the text's A-Z lower-cased, and
    ``verified`` says whether it is the root.

    Nulls in any field are told apart from empty values; rows with a null id come first
    in their source, rows of one id go by digest, and repeated rows are leaves of their
    own. A null text stays null when tampered with. Texts of any length are hashed
    whole. Extra columns are ignored. An empty table gives an empty table.
    """
    values = [column(f) for f in fields]
    lowered = [F.translate(column(f), UPPER, LOWER) if f == text_col else column(f) for f in fields]
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select(
        column(id_col).alias("id"),
        column(source_col).alias("source"),
        leaf_digest(values).alias("leaf"),
        F.when(hit, leaf_digest(lowered)).alias("changed"),
    )
    spark = docs.sparkSession
    rows = checkpointed(ranked(leaves), "leaves")
    records, subroots, _ = climb(rows.select("s", F.col("r").alias("i"), "n", F.col("leaf").alias("digest")), True)
    subroots = checkpointed(subroots, "subroots")
    sources = subroots.count()
    tree = subroots.select(F.lit(0).cast("bigint").alias("s"), F.col("s").alias("i"), F.lit(sources).cast("bigint").alias("n"), "digest")
    upper, top, levels = climb(tree, False)
    root = top.first()
    schema = docs.select(column(id_col)).schema[0].dataType.simpleString()
    if root is None:
        return spark.createDataFrame(
            [], f"`{id_col}` {schema}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    everything = [*records, *upper]
    table = everything[0] if everything else spark.createDataFrame([], "digest binary, children binary, bottom boolean")
    for r in everything[1:]:
        table = table.unionByName(r)
    # by content: a node that occurs again has the same record
    once = [F.first(c).alias(c) for c in ("children", "bottom")]
    table = checkpointed(table.groupBy("digest").agg(*once, F.count("*").alias("times")), "records")
    nodes = table.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("t")).first().t
    arrived = descend(spark, bytes(root.digest), table, levels, nodes)

    asked = F.sort_array(F.collect_list(F.struct("r", "id", "leaf", "changed")))
    runs = rows.groupBy("s", F.shiftright("r", BITS).alias("run")).agg(asked.alias("asked"))
    met = runs.join(arrived.withColumnRenamed("r", "run"), ["s", "run"])

    @F.pandas_udf("proofs array<string>, roots array<string>")
    def proved(asked: pd.Series, path: pd.Series, digits: pd.Series, children: pd.Series) -> pd.DataFrame:
        out = [prove(list(a), p, d, c, [i % FANOUT for i in range(len(a))]) for a, p, d, c in zip(asked, path, digits, children)]
        return pd.DataFrame(out, columns=["proofs", "roots"])

    tried = F.transform("asked", lambda a: F.coalesce(a.changed, a.leaf))
    met = met.select("asked", "subroot", proved(tried, "path", "digits", "children").alias("p"))
    each = F.transform(
        "asked", lambda a, i: F.struct(a.alias("a"), F.get("p.proofs", i).alias("proof"), F.get("p.roots", i).alias("folded"))
    )
    flat = met.select("subroot", F.explode(each).alias("x"))
    whole = F.lit(bytes(root.digest).hex())
    return flat.select(
        F.col("x.a.id").alias(id_col),
        hexed(F.col("x.a.leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        whole.alias("root"),
        F.col("x.proof").alias("proof_sha256"),
        F.col("x.folded").alias("folded_root"),
        (F.col("x.folded") == whole).alias("verified"),
    )
