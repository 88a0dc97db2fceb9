"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells, one for each combination of source, language and
topic that occurs. The cells' token weights are raked to the margins' targets in turn,
and each document is kept with its cell's calibrated probability. All of it is
DataFrame functions; the cells are few beside the documents and stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import attach, column, packed, unpacked
from burnish.session import checkpointed

#: Characters that are no white space, in runs: the words that weigh a document.
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by what a text holds; the first that fits. Null text is prose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("license") | low.contains("copyright"), "legal")
        .when(low.contains(" | "), "tabular")
        .when(low.contains("@") | low.contains("http"), "contact")
        .otherwise("prose")
    )


def unit_hash(value: Column, seed: int) -> Column:
    """A number in [0, 1) from a value, the same in every run."""
    h = F.md5(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame,
    margins: dict[str, Column] | None = None,
    targets: dict[str, DataFrame] | None = None,
    temper: float = 0.85,
    rounds: int = 20,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut_every: int = 4,
    window_cells: int = 100_000,
) -> DataFrame:
    """All rows and columns, with mix_tokens, mix_weight, mix_probability and mix_kept.

    ``margins`` names the marginals (default: source, lang and topic_of the text).
    ``targets`` has, by margin, a table (value string, share double) of wanted token
    shares; a value it lacks gets share 0, shares are normalised, and where rounds
    cannot meet all of them the last margin is met exactly. Margins without a table aim
    at natural shares to the power ``temper``. ``mix_weight`` is the raked weight of one
    token of the document, 1 where it is as frequent as wanted; ``mix_probability`` is
    the weight over the largest one, so expected tokens have exactly the raked shares,
    and a row is kept if a hash of its id falls below it.

    Null and empty margin values are one value, ''. Null and empty texts have no tokens;
    cells without a token have weight and probability 0. Repeated rows count each and
    share their fate, as do null ids. Extra columns pass through; columns named like the
    new ones are replaced. An empty table gives an empty table. Up to ``window_cells``
    cells are raked in windows; more are summed by grouping and get the sums by attach.
    """
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(column(text_col))}
    targets = targets or {}
    new = ("mix_tokens", "mix_weight", "mix_probability", "mix_kept")
    names = [f"_m{i}" for i in range(len(margins))]
    values = [F.coalesce(m.cast("string"), F.lit("")) for m in margins.values()]
    tokens = F.regexp_count(F.coalesce(column(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    marked = docs.select(
        packed(docs).alias("_row"),
        column(id_col).alias("_id"),
        tokens.alias("_tokens"),
        F.to_json(F.array(*values)).alias("_cell"),
        *[v.alias(n) for v, n in zip(values, names)],
    )
    cells = marked.groupBy("_cell", *names).agg(F.sum("_tokens").alias("_tokens"), F.count("*").alias("_n"))
    cells = checkpointed(cells, "cells")
    sums = cells.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    total = max(sums.t, 1)
    for name, margin in zip(names, margins):
        # only cells with tokens can be raked; the others stay out of all shares
        natural = cells.filter("_tokens > 0").groupBy(name).agg((F.sum("_tokens") / F.lit(total)).alias("_natural"))
        if margin in targets:
            wanted = targets[margin].select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(name), F.col("share").cast("double").alias("_share"))
            wanted = natural.join(wanted, name, "left").select(name, F.coalesce("_share", F.lit(0.0)).alias("_share"))
        else:
            wanted = natural.select(name, F.pow("_natural", F.lit(temper)).alias("_share"))
        wanted = checkpointed(wanted, "targets")
        whole = wanted.agg(F.sum("_share").alias("s")).first().s or 1.0
        cells = cells.join(wanted.select(name, (F.col("_share") / F.lit(whole)).alias(f"{name}_target")), name, "left")
    raked = checkpointed(cells.filter("_tokens > 0").withColumn("_w", F.col("_tokens") / F.lit(total)), "cells")
    n_cells = raked.count()
    few = n_cells <= window_cells
    for r in range(rounds):
        for name in names:
            if few:
                now = F.sum("_w").over(Window.partitionBy(name))
            else:  # a window would bring all cells of a value to one task
                by_value = raked.groupBy(name).agg(F.sum("_w").alias("_now"), F.count("*").alias("_k"))
                raked, now = attach(raked, checkpointed(by_value, "sums"), name, "_k", n_cells), F.col("_now")
            raked = raked.withColumn("_w", F.when(now > 0, F.col("_w") * F.col(f"{name}_target") / now).otherwise(0.0))
            if not few:
                raked = checkpointed(raked.drop("_now", "_k"), "raked")
        if few and ((r + 1) % cut_every == 0 or r + 1 == rounds):
            raked = checkpointed(raked, "raked")
    weighed = raked.select("_cell", "_n", (F.col("_w") * F.lit(total) / F.col("_tokens")).alias("mix_weight"))
    most = weighed.agg(F.max("mix_weight").alias("m")).first().m or 1.0
    joined = attach(marked, weighed, "_cell", "_n", sums.n, "left")
    weight = F.coalesce("mix_weight", F.lit(0.0))
    chance = weight / F.lit(most)
    values = (F.col("_tokens"), weight, chance, unit_hash(F.col("_id"), seed) < chance)
    return joined.select(*unpacked(joined, "_row", dict(zip(new, values))))
