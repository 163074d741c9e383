"""Order-dependent state of event logs as window expressions. Every order must end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.plans.lineage import cut

Names = list[str]


def _order(by: Names) -> list[Column]:
    return [F.col(c) for c in by]


def before(partition: Names, by: Names):
    """Frame of all rows before the current one."""
    return Window.partitionBy(*partition).orderBy(*_order(by)).rowsBetween(Window.unboundedPreceding, -1)


def until(partition: Names, by: Names):
    """Frame of all rows up to the current one."""
    return Window.partitionBy(*partition).orderBy(*_order(by)).rowsBetween(Window.unboundedPreceding, 0)


def prefix_sum(value: Column, partition: Names, by: Names) -> Column:
    """Sum over earlier rows, 0 for the first; a null adds nothing."""
    return F.coalesce(F.sum(value).over(before(partition, by)), F.lit(0))


def last_event(value: Column, partition: Names, by: Names) -> Column:
    """The latest non-null value of an earlier row, null if there is none."""
    return F.last(value, ignorenulls=True).over(before(partition, by))


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums over all rows in an order, the current row included, without a window over the whole table.

    Rows are range-partitioned and summed inside the ranges; the sums of the ranges before, one row a range, are added. The
    ranges are drawn from a sample, so they are written once. The order should end in a unique key.
    """
    values = {f"__v_{name}": F.coalesce(value, F.lit(0)) for name, value in sums.items()}
    spread = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).withColumns(values)
    inner = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(spread.withColumns({name: F.sum(f"__v_{name}").over(inner) for name in sums}))
    ranges = rows.groupBy("__p").agg(*(F.sum(f"__v_{name}").alias(f"__o_{name}") for name in sums))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__p", *(F.coalesce(F.sum(f"__o_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in sums))
    joined = rows.join(F.broadcast(offsets), "__p")  # one row a range
    return joined.withColumns({name: F.col(name) + F.col(f"__o_{name}") for name in sums}).drop("__p", *values, *(f"__o_{name}" for name in sums))


def row_index(df: DataFrame, by: list[str | Column], name: str = "row") -> DataFrame:
    """Numbers rows from 0 in a total order, at any size."""
    numbered = global_prefix(df, [F.col(c) if isinstance(c, str) else c for c in by], {name: F.lit(1)})
    return numbered.withColumn(name, F.col(name) - 1)


def global_average_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """Adds the rank from 1 of a score over all rows, equal scores sharing the mean of their places; a null score gets null.

    Different scores are counted first, so a tie of any size is one row on its way to the ranking.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    ranks = global_prefix(counts, [F.col(score)], {"__t": F.col("__c")}).select(score, (F.col("__t") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, score, "left")


def sessions(df: DataFrame, partition: Names, clock: str, by: Names, gap: float, name: str = "session") -> DataFrame:
    """Numbers sessions from 0: a row more than gap after the one before begins a new one. A gap of exactly `gap` does not."""
    w = Window.partitionBy(*partition).orderBy(*_order(by))
    new = F.coalesce((F.col(clock) - F.lag(clock).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(until(partition, by))).drop("__new")


def inversion_segments(df: DataFrame, partition: Names, by: Names, value: str, name: str = "segment") -> DataFrame:
    """Numbers runs of non-decreasing values from 0: a value below the one before begins a new run."""
    w = Window.partitionBy(*partition).orderBy(*_order(by))
    drop = F.coalesce((F.col(value) < F.lag(value).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__drop", drop).withColumn(name, F.sum("__drop").over(until(partition, by))).drop("__drop")


def drawdown(df: DataFrame, partition: Names, by: Names, value: str) -> DataFrame:
    """(partition, max_drawdown, max_runup) of the running sum, which starts from 0."""
    run = df.withColumn("__sum", F.sum(value).over(until(partition, by)))
    high, low = F.greatest(F.lit(0), F.max("__sum").over(until(partition, by))), F.least(F.lit(0), F.min("__sum").over(until(partition, by)))
    run = run.withColumn("__down", high - F.col("__sum")).withColumn("__up", F.col("__sum") - low)
    return run.groupBy(*partition).agg(F.max("__down").alias("max_drawdown"), F.max("__up").alias("max_runup"))


def after_trigger(df: DataFrame, partition: Names, by: Names, trigger: Column, rows: int, name: str) -> DataFrame:
    """True for the rows that follow a triggering one within `rows` places."""
    w = Window.partitionBy(*partition).orderBy(*_order(by)).rowsBetween(-rows, -1)
    return df.withColumn(name, F.coalesce(F.max(trigger.cast("int")).over(w), F.lit(0)) == 1)


def lineup_changes(members: DataFrame, partition: str, seq: str, member: str) -> DataFrame:
    """(partition, seq, member, change): who joined or left against the step before; seq counts up by 1 without gaps.

    Of a first step all members joined; after the last nobody leaves.
    """
    now = members.select(partition, seq, member)
    ends = now.groupBy(partition).agg(F.max(seq).alias("__end"))
    was = now.withColumn(seq, F.col(seq) + 1)
    joined = now.join(was, [partition, seq, member], "left_anti").withColumn("change", F.lit("joined"))
    left = was.join(now, [partition, seq, member], "left_anti").join(ends, partition).filter(F.col(seq) <= F.col("__end")).drop("__end").withColumn("change", F.lit("left"))
    return joined.unionByName(left)
