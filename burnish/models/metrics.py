"""Evaluation of a (label, prediction[, score]) DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from burnish.session import checkpointed


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _pairs(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def classification(df: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by class size; 0 if undefined.

    One shuffle of class pairs; the rest works on their counts.
    """
    n = F.col("n")
    right = F.when(F.col("label") == F.col("prediction"), n).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = _pairs(df).select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), right.alias("hit"), n.alias("support"), zero.alias("named")),
                F.struct(F.col("prediction").alias("class"), zero.alias("hit"), zero.alias("support"), n.alias("named")),
            )
        )
    )
    c = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("named").alias("named")
    )
    hit, support, named = F.col("hit"), F.col("support"), F.col("named")

    def weighted(x: Column) -> Column:
        return _ratio(F.sum(support * x), F.sum(support))

    return c.agg(
        _ratio(F.sum(hit), F.sum(support)).alias("accuracy"),
        weighted(_ratio(hit, named)).alias("precision"),
        weighted(_ratio(hit, support)).alias("recall"),
        weighted(_ratio(2 * hit, support + named)).alias("f1"),
    )


def confusion(df: DataFrame, zeros: bool = True, labels: list | None = None) -> DataFrame:
    """Rows for pairs of classes, with how many rows each has.

    ``zeros`` adds every pair that does not occur, of classes that do: the square of the
    classes. Without, there are as many rows at most as predictions, however many classes
    there are. ``labels`` keeps the pairs of some true classes, with their zeros if asked.
    """
    counts = _pairs(df)
    mine = F.lit(True) if labels is None else F.col("label").isin(*labels)
    if not zeros:
        return counts.filter(mine).select("label", "prediction", "n")
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c"))
    every = classes.agg(F.sort_array(F.collect_set("c"))).scalar()  # one entry per class
    known = classes.distinct().select(F.col("c").alias("label")).filter(mine)
    grid = known.select("label", F.explode(every).alias("prediction"))
    filled = grid.join(counts.filter(mine), ["label", "prediction"], "left")
    return filled.select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list) -> DataFrame:
    """One row per true class, one column per predicted class."""
    wide = _pairs(df).groupBy("label").pivot("prediction", classes).agg(F.sum("n"))
    return wide.na.fill(0)


def _roc_steps(df: DataFrame) -> DataFrame:
    """Distinct scores with the positives and negatives at or above each.

    Scores are counted first, so ties are one point. The points are dealt out by ranges
    of the score that hold about as many points each and written once; running totals
    are taken within a range and shifted by the totals of higher ranges, so no task
    sees the whole curve, however the scores are spread.
    """
    points = df.groupBy(F.col("score").cast("double").alias("score")).agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("n"),
    )
    points = checkpointed(points.repartitionByRange(F.desc("score")).withColumn("_cell", F.spark_partition_id()), "roc")
    cells = points.groupBy("_cell").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = cells.select(
        "_cell",
        F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.sum("_p").over(whole).alias("_pos"),
        F.sum("_n").over(whole).alias("_neg"),
    )
    upto = Window.partitionBy("_cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumn("tp", F.sum("p").over(upto)).withColumn("fp", F.sum("n").over(upto))
    run = run.join(F.broadcast(shifts), "_cell")
    return run.select(
        "score", "p", "n", (F.col("tp") + F.col("_p0")).alias("tp"), (F.col("fp") + F.col("_n0")).alias("fp"),
        F.col("_pos").alias("pos"), F.col("_neg").alias("neg"),
    )


def roc_curve(df: DataFrame) -> DataFrame:
    """A point for every distinct score, and the one at (0, 0) before them (null score)."""
    steps = _roc_steps(df).select(
        "score", _ratio(F.col("fp"), F.col("neg")).alias("fpr"), _ratio(F.col("tp"), F.col("pos")).alias("tpr")
    )
    start = df.agg(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return steps.unionByName(start)


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the curve: for each step, its negatives times the mean height."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return _roc_steps(df).agg(_ratio(area, F.max("pos") * F.max("neg")).alias("auc"))


def regression(df: DataFrame) -> DataFrame:
    """Mean squared error, mean absolute error and R squared in one pass."""
    miss = F.col("label") - F.col("prediction")
    return df.agg(
        F.avg(miss * miss).alias("mse"),
        F.avg(F.abs(miss)).alias("mae"),
        (1 - F.try_divide(F.sum(miss * miss), F.var_pop("label") * F.count("*"))).alias("r2"),
    )


def actual_vs_predicted(df: DataFrame) -> DataFrame:
    """The pairs, with the range of the line on which both are equal."""
    ends = df.agg(
        F.struct(
            F.least(F.min("label"), F.min("prediction")).alias("lo"),
            F.greatest(F.max("label"), F.max("prediction")).alias("hi"),
        )
    ).scalar()
    return df.select(
        F.col("label").alias("actual"),
        F.col("prediction").alias("predicted"),
        ends.getField("lo").alias("line_from"),
        ends.getField("hi").alias("line_to"),
    )
