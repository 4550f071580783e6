"""Document assembly: ordered parts to text (S6), table to text (S7), union with a
fresh index (U1) and running context (W4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordering import dense_index


def _ordered_listagg(text: str, order: list[str], sep: str) -> Column:
    order_sql = ", ".join(f"`{c}`" for c in order)
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg(`{text}`, '{sep_sql}') WITHIN GROUP (ORDER BY {order_sql})")


def document_text(df: DataFrame, group: list[str], order: list[str], text: str = "text",
                  trailing_newline: bool = False) -> DataFrame:
    """Ordered parts of each document joined by newlines.

    ``trailing_newline`` gives the "newline after every part" form; otherwise
    newlines only separate parts. One group per document, so a group is as
    large as one document.
    """
    joined = _ordered_listagg(text, order, "\n")
    out = F.concat(joined, F.lit("\n")) if trailing_newline else joined
    return df.groupBy(*group).agg(out.alias("text"))


def cells_text(*cols: str) -> Column:
    """Non-null cells of a row, each followed by one space (row-major flattening)."""
    return F.concat_ws("", *[F.concat(F.col(c).cast("string"), F.lit(" ")) for c in cols])


def table_text(df: DataFrame, group: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Flatten each group's rows to text, cells row-major, a space after each."""
    with_row = df.withColumn("_row_text", cells_text(*cols))
    return with_row.groupBy(*group).agg(_ordered_listagg("_row_text", order, "").alias("text"))


def union_renumber(parts: list[tuple[str, DataFrame]], ordinal: str = "ordinal",
                   name: str = "idx") -> DataFrame:
    """Union by column name (missing columns NULL) with a fresh 0-based index.

    The index follows (part position, ordinal) and is computed by the
    distributed ``dense_index`` rather than a single-partition window.
    """
    tagged = [df.withColumn("source", F.lit(src)).withColumn("_part", F.lit(i))
              for i, (src, df) in enumerate(parts)]
    unioned = tagged[0]
    for df in tagged[1:]:
        unioned = unioned.unionByName(df, allowMissingColumns=True)
    return dense_index(unioned, ["_part", ordinal], name=name).drop("_part")


def _before_chunks(chunks: DataFrame, group: str, fan: int, levels: int) -> DataFrame:
    """(group, _chunk, _before, _sum_before) of the wanted chunks: text and sum of all earlier chunks of the group.

    ``chunks`` holds (group, _chunk, _text, _sum, _wanted). ``fan`` consecutive chunks have one parent, whose text is
    theirs; what stands before a chunk is what stands before its parent and its earlier siblings.
    """
    def earlier(*keys):
        w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return [F.concat_ws("", F.collect_list("_text").over(w)).alias("_before"),
                F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_sum_before")]
    if levels == 1:
        return chunks.select(group, "_chunk", "_wanted", *earlier(group)).where("_wanted").drop("_wanted")
    placed = chunks.withColumn("_up", F.floor(F.col("_chunk") / F.lit(fan)).cast("long"))
    parents = placed.groupBy(group, "_up").agg(
        F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _chunk)").alias("_text"), F.sum("_sum").alias("_sum"),
        F.bool_or("_wanted").alias("_wanted")).withColumnRenamed("_up", "_chunk")
    above = _before_chunks(parents, group, fan, levels - 1).select(
        F.col(group).alias("_ag"), F.col("_chunk").alias("_ac"), F.col("_before").alias("_above"), F.col("_sum_before").alias("_sum_above"))
    here = placed.select(group, "_chunk", "_up", "_wanted", *earlier(group, "_up")).where("_wanted")
    return here.join(above, F.col(group).eqNullSafe(F.col("_ag")) & F.col("_up").eqNullSafe(F.col("_ac"))).select(
        group, "_chunk", F.concat("_above", "_before").alias("_before"), (F.col("_sum_above") + F.col("_sum_before")).alias("_sum_before"))


def running_context(df: DataFrame, group: str, order: str, piece: Column, name: str = "context",
                    wanted: Column | None = None, chunk: int = 256, fan: int = 64, levels: int = 2,
                    count: Column | None = None, count_name: str = "count_before") -> DataFrame:
    """For each row, the concatenation of the pieces of all earlier rows in its group.

    ``order`` is an integer (a turn number). A prefix scan of several levels: a group is cut in chunks of ``chunk``
    consecutive order values, ``fan`` chunks make one of the next level, and so on; with two levels a window spans a
    chunk of rows, ``fan`` chunks, or the parents of a group, each parent the text of ``chunk * fan`` order values. So
    a group with a third of all rows is spread over many tasks at each level. What stands before a chunk is put
    together for chunks with ``wanted`` rows only, and the context for those rows only; as it holds all earlier text,
    its size is that of the output asked for. The first row sees the empty string.

    ``count`` (a number per row, not NULL) is summed over all earlier rows into ``count_name`` on the same way.
    """
    cut = (df.withColumn("_piece", piece).withColumn("_count", F.lit(0) if count is None else count)
           .withColumn("_is_wanted", F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False)))
           .withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long")))
    chunks = cut.groupBy(group, "_chunk").agg(
        F.expr(f"listagg(_piece, '') WITHIN GROUP (ORDER BY `{order}`)").alias("_text"), F.sum("_count").alias("_sum"),
        F.bool_or("_is_wanted").alias("_wanted"))
    before = _before_chunks(chunks, group, fan, levels).withColumnsRenamed({group: "_og", "_chunk": "_oc"})
    inside = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = (cut.withColumn("_inside", F.concat_ws("", F.collect_list("_piece").over(inside)))
            .withColumn("_sum_inside", F.coalesce(F.sum("_count").over(inside), F.lit(0))).where("_is_wanted"))
    out = (rows.join(before, F.col(group).eqNullSafe(F.col("_og")) & F.col("_chunk").eqNullSafe(F.col("_oc")))
           .withColumn(name, F.concat("_before", "_inside")))
    if count is not None:
        out = out.withColumn(count_name, (F.col("_sum_before") + F.col("_sum_inside")).cast("long"))
    return out.drop("_piece", "_count", "_is_wanted", "_chunk", "_inside", "_sum_inside", "_og", "_oc", "_before", "_sum_before")
