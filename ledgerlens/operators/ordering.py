"""Order-carrying helpers: a distributed dense index and take-until-null.

Spark has no implicit row order, so tables whose order is meaning carry an
explicit ordinal. A global ``row_number()`` without a partition key moves every
row into one task; ``dense_index`` instead cuts the ordering into ranges, numbers
the rows of each range, and adds the number of rows of all ranges before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Ranges of the last ordering key are this number squared; a range is numbered by one task.
INDEX_FANOUT = 32


def dense_index(df: DataFrame, order_by: list[str], name: str = "idx", start: int = 0,
                fanout: int = INDEX_FANOUT) -> DataFrame:
    """Add a dense 0-based (or ``start``-based) index following ``order_by``.

    ``order_by`` must be a total order (ties make the index arbitrary among
    them) that ends in a number; keys before it must have few values (such as the
    number of a part of a union). The last key is cut into ``fanout ** 2`` ranges
    of about equal size at quantiles of the data, which are a scalar subquery:
    nothing runs when this is called, and nothing is written. Rows are numbered
    within (leading keys, range); offsets come from the table of range sizes,
    whose rows are bounded by the leading keys times the ranges. NULL keys sort first.
    """
    *lead, last = order_by
    n = fanout * fanout
    cut = [F.percentile_approx(F.col(last), [i / n for i in range(step, n, step)], 10 * n).alias(as_)
           for step, as_ in ((fanout, "coarse"), (1, "fine"))]
    # the range is found in two steps of ``fanout`` comparisons; cuts repeat where a value is frequent
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(last)))
    ranged = (df.withColumn("_cuts", df.agg(F.struct(*cut)).scalar())
              .withColumn("_coarse", F.coalesce(below(F.col("_cuts.coarse")), F.lit(0)))
              .withColumn("_range", F.when(F.col(last).isNull(), F.lit(-1)).otherwise(
                  F.col("_coarse") * fanout
                  + below(F.slice("_cuts.fine", F.col("_coarse") * fanout + 1, F.lit(fanout)))))
              .drop("_cuts", "_coarse"))
    keys = [*lead, "_range"]
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.coalesce(
        F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(last))
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)]
    numbered = ranged.withColumn("_place", place).join(offsets, functools.reduce(lambda x, y: x & y, same))
    return numbered.select(*df.columns, (F.col("_off") + F.col("_place") + F.lit(start - 1)).cast("long").alias(name))


def take_until_null(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """P5: rows in ``ordinal`` order up to (not including) the first NULL ``key``.

    The stop position is one global ``min`` (a single value, joined as a
    scalar subquery), so the filter runs in parallel on every partition.
    """
    stop = df.filter(F.col(key).isNull()).agg(F.min(ordinal).alias("_stop")).scalar()
    # One subquery: with no NULL key the comparison is NULL and every row is kept.
    return df.filter(F.coalesce(F.col(ordinal) < stop, F.lit(True)))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition, for CPU-heavy per-row work behind a scan with very few splits.

    The caller says so: with ``partitions`` unset the input is left as it is. Results never depend on it.
    """
    return df.repartition(partitions) if partitions else df


def running_sum_before(df: DataFrame, group: str, order: str, value: str, name: str,
                       chunk: int = 4096) -> DataFrame:
    """Per group, the sum of ``value`` over all earlier rows (by integer ``order``), 0 for the first.

    Skew-safe: rows are cut into chunks of ``chunk`` consecutive order values,
    so no window spans more than one chunk even when one group holds a third
    of all rows. Chunk totals are a partial aggregate, chunk offsets a window
    over the small chunk table, and the within-chunk running sum a window per
    (group, chunk). ``order`` must be an integer (e.g. a turn number). NULL
    groups are one group, and rows of NULL order come first in theirs.
    """
    with_chunk = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    totals = with_chunk.groupBy(group, "_chunk").agg(F.sum(value).alias("_ct"))
    w_chunks = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_og"), F.col("_chunk").alias("_oc"),
                            F.coalesce(F.sum("_ct").over(w_chunks), F.lit(0)).alias("_off"))
    w_rows = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = with_chunk.withColumn("_in", F.coalesce(F.sum(value).over(w_rows), F.lit(0)))
    return (inner.join(offsets, F.col(group).eqNullSafe(F.col("_og")) & F.col("_chunk").eqNullSafe(F.col("_oc")))
            .withColumn(name, (F.col("_off") + F.col("_in")).cast("long"))
            .drop("_chunk", "_in", "_off", "_og", "_oc"))
