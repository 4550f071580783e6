"""Line dedup over a corpus, in DataFrame functions only.

Lines become two 64-bit hashes of their key (128 bits together). The occurrences are range-partitioned on (hash,
document) with a secondary sort by position, so that a line that a third of all documents hold is spread over many
ranges, and each range streams the first occurrence of a line in each document. Counts of documents are combined per
range before they are shuffled. The result is a bitmap per document, 64 lines to a number, and no text.

Cases: a NULL or empty text is one empty line, which has no key and stays (NULL text stays NULL in the rewritten
documents); a document is its (doc_id, text), so that repeated rows count once and get the same bitmap; NULL ids are
documents too; an empty table gives no rows; further columns of any
name pass through ``deduplicate_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, document_key, stored

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep_first: bool = False) -> DataFrame:
    """(_doc, _text_hash, dropped): bit ``i mod 64`` of ``dropped[i div 64]`` is set if line ``i`` goes.

    Lines go whose key has ``min_chars`` code points and is found in ``min_docs`` documents; with ``keep_first`` the
    first occurrence by (document, position) stays. Documents that lose no line have no row.
    """
    line = (docs.select(*document_key(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
            .select("_doc", "_text_hash", "pos", line_key(F.col("line")).alias("key"))
            .where(F.length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"),
                    "_doc", "_text_hash", "pos"))
    line = stored(line, "lines")  # texts are split once, not again for the range bounds and for the join
    ranged = (line.repartitionByRange("h1", "h2", "_doc", "_text_hash")
              .sortWithinPartitions("h1", "h2", "_doc", "_text_hash", "pos"))
    first = ranged.groupBy("h1", "h2", "_doc", "_text_hash").agg(F.min("pos").alias("pos"))
    common = (first.groupBy("h1", "h2")
              .agg(F.count("*").alias("docs"), F.min(F.struct("_doc", "_text_hash", "pos")).alias("first_at"))
              .where(F.col("docs") >= min_docs).select("h1", "h2", "first_at"))
    # as a table of its own, so that Spark may split the partitions of a line that very many documents hold
    gone = line.join(stored(common, "common_lines"), ["h1", "h2"])
    if keep_first:
        gone = gone.where(F.struct("_doc", "_text_hash", "pos") != F.col("first_at"))
    word = (gone.groupBy("_doc", "_text_hash", F.expr("pos div 64").cast("int").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits")))
    return (word.groupBy("_doc", "_text_hash")
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
                 F.max("word").alias("last"))
            .select("_doc", "_text_hash",
                    F.expr("transform(sequence(0, last), w -> coalesce(try_element_at(words, w), 0L))")
                    .alias("dropped")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): ``row`` holds all columns of ``docs``, ``kept_text`` is NULL for NULL."""
    out = docs.select(F.struct("*").alias("row"), *document_key()).join(bitmaps, ["_doc", "_text_hash"], "left")
    out = out.withColumn("lines", _lines(F.col("row")["text"]))
    # past the end of the bitmap, and without one, every line is kept
    out = out.withColumn("kept", F.expr("""
        CASE WHEN dropped IS NULL THEN lines ELSE filter(lines, (l, i) ->
            (shiftright(coalesce(get(dropped, i div 64), 0L), i % 64) & 1L) = 0L) END"""))
    return out.select("row", F.when(F.col("row")["text"].isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
                      F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def deduplicate_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      keep_first: bool = False) -> DataFrame:
    """``docs`` with the common lines taken out of ``text`` and ``n_chars`` set to match; columns as before."""
    out = apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_chars, keep_first))
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
