"""Run-length tables and rank over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from ..plans.order import BUCKET, following, numbered, prefix_sum


def starts(df: DataFrame, column: str, key: str = "i") -> DataFrame:
    """(start, c): where a maximal run of equal symbols begins."""
    pairs = following(df.select(F.col(key).alias("k"), F.col(column).alias("c")), 2, column="c")
    inner = pairs.where("x1 is not null and x1 <> x0").select((F.col("k") + 1).alias("start"), F.col("x1").alias("c"))
    return inner.unionByName(pairs.where("k = 0").select(F.col("k").alias("start"), F.col("x0").alias("c")))


def runs(df: DataFrame, column: str, n: int, key: str = "i") -> DataFrame:
    """(c, start, len, fp, cum): fp counts the symbols before the run in (symbol, position) order, cum those equal to c."""
    heads, _ = numbered(starts(df, column, key), ["start"], "k")
    lengths = following(heads, 2, column="start").select("c", "start", (F.coalesce("x1", F.lit(n)) - F.col("x0")).alias("len"))
    placed, _ = prefix_sum(lengths, ["c", "start"], "len", "fp")
    base = placed.groupBy("c").agg(F.min("fp").alias("base"))
    return cut(placed.join(base, "c").select("c", "start", "len", "fp", (F.col("fp") - F.col("base")).alias("cum")))


def count_runs(df: DataFrame, column: str, key: str = "i") -> int:
    return starts(df, column, key).count()


def totals(run_table: DataFrame) -> DataFrame:
    """(c, n_runs, total)"""
    return run_table.groupBy("c").agg(F.count("*").alias("n_runs"), F.sum("len").alias("total"))


def rank(run_table: DataFrame, probes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """probes(c, i, ...) with ``rank``: occurrences of c before position i.

    An as-of join in DataFrame operations: runs and probes meet inside buckets of positions, and each
    bucket of a symbol is handed the last run that began before it.
    """
    keys = probes.select("c", "i").distinct()
    run = F.struct("start", "len", "cum")
    placed = run_table.select("c", F.col("start").alias("at"), F.expr(f"start div {bucket}").alias("b"), F.lit(0).alias("probe"), run.alias("run"))
    asked = keys.select("c", F.col("i").alias("at"), F.expr(f"i div {bucket}").alias("b"), F.lit(1).alias("probe"), F.lit(None).cast("struct<start:bigint,len:bigint,cum:bigint>").alias("run"))
    both = placed.unionByName(asked)
    tops = both.groupBy("c", "b").agg(F.max("run").alias("top"))
    carried = tops.select("c", "b", F.last("top", ignorenulls=True).over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("run")).where("run is not null")
    rows = both.unionByName(carried.select("c", F.lit(-1).cast("long").alias("at"), "b", F.lit(0).alias("probe"), "run"))
    # a run that begins at i itself doesn't count: probes sort before it
    w = Window.partitionBy("c", "b").orderBy("at", F.desc("probe")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("run", F.last("run", ignorenulls=True).over(w)).where("probe = 1")
    value = F.coalesce(F.col("run.cum") + F.least(F.col("run.len"), F.col("at") - F.col("run.start")), F.lit(0)).cast("long")
    return probes.join(found.select("c", F.col("at").alias("i"), value.alias("rank")), ["c", "i"])
