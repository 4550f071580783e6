"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Patterns of fixed kinds give the base spans. Further candidates are long mixed tokens; each is hashed, and its distinct
repositories (documents) and owners (sources) are counted over the whole corpus. A candidate that many owners copy is an
example; one that stays with few owners looks live and becomes a span of the kind ``live``, in however many of their
documents it is. Counts are combined per
task before they are shuffled, first per (hash, owner), so that no candidate, however common, is gathered in one task.

A text is cut by marking every match with a character that the patterns cannot match; the lengths of the parts give
the positions in code points.

Cases: a NULL or empty text has no span; a NULL owner counts as one owner of its own; repeated rows count as one
repository; a document is its (doc_id, text); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_key, stored

#: Fixed patterns: kind, pattern, and the least length of a match (of its group 2 for ``assign``).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run that starts with AKIA, kept from 16 characters on
HEX = "[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "live"]

#: Candidates: long tokens of letters, digits and the characters of common encodings ...
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: ... with a digit, a letter, and this many distinct characters.
MIN_DISTINCT = 10
#: A candidate found with at most so many owners looks live; with more it is an example.
MAX_OWNERS = 2

_MARK, _OTHER = "\ue000", "\ue001"


_SPAN = "array<struct<start:int,end:int,value:string>>"
#: Parts whose spans are gathered at once; an even number, as every second part is a match.
_STEP = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block_spans(parts: Column) -> Column:
    """(at, found) of some parts, the first of which is no match: their length, and the matches from there."""
    none = F.expr(f"cast(array() AS {_SPAN})")
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"), (s["i"] + 1).alias("i"),
            F.when(s["i"] % 2 == 1, F.array_append(s["found"], F.struct(
                s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"), p.alias("value"))))
            .otherwise(s["found"]).alias("found")),
        lambda s: F.struct(s["at"].alias("at"), s["found"].alias("found")))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches of ``pattern``, leftmost and non-overlapping.

    Spans are gathered block by block and the blocks moved to their places, as an array that grows by one match at a time
    would be copied for each.
    """
    # the mark itself in a text becomes another character that no pattern matches; positions stay
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")

    def placed(blocks: Column) -> Column:
        starts = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<int>)").alias("starts")),
            lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")),
            lambda s: s["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["found"], lambda s: F.struct(
            (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))

    def of(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _STEP).cast("int")),
                             lambda k: _block_spans(F.slice(parts, k * _STEP + 1, F.lit(_STEP))))
        return _let(blocks, placed)

    return _let(F.split(marked, _MARK), lambda parts: F.when(F.size(parts) > 1, of(parts)).otherwise(
        F.expr(f"cast(array() AS {_SPAN})")))


def _kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base spans of each kind, and the candidates with a 128-bit hash of their value."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    out = (docs.select(*document_key(), F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"),
                       text.alias("text"))
           .withColumn("assign", F.filter(_spans(F.col("text"), ASSIGN), lambda s: F.length(
               F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_CHARS))
           .withColumn("access", _spans(F.col("text"), ACCESS))
           .withColumn("hex", _spans(F.col("text"), HEX))
           .withColumn("candidate", F.filter(_spans(F.col("text"), CANDIDATE), lambda s: (
               s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
               & (F.size(F.array_distinct(F.split(s["value"], ""))) >= MIN_DISTINCT)))))
    return out.select("_doc", "_text_hash", "doc_id", "owner",
                      _kind(F.col("assign"), 0).alias("assign"), _kind(F.col("access"), 1).alias("access"),
                      _kind(F.col("hex"), 2).alias("hex"),
                      F.transform("candidate", lambda s: F.struct(
                          s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h1"),
                          F.xxhash64(F.lit("value"), s["value"]).alias("h2"))).alias("candidate"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(h1, h2, repositories, owners) of every candidate value."""
    held = scanned.select("_doc", "_text_hash", F.coalesce("owner", F.lit("")).alias("owner"),
                          F.col("owner").isNull().alias("unowned"), F.explode("candidate").alias("c"))
    repository = (held.select("c.h1", "c.h2", "owner", "unowned", "_doc", "_text_hash").distinct())
    per_owner = repository.groupBy("h1", "h2", "owner", "unowned").agg(F.count("*").alias("n"))
    return per_owner.groupBy("h1", "h2").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row of ``docs``: arrays of base spans, ``live`` spans, and the number of ``examples``."""
    scanned = stored(scan(docs), "scanned")
    owned = ownership(scanned).withColumn("is_live", F.col("owners") <= max_owners)
    # as a table of its own, so that Spark may split the partitions of a value that very many documents hold
    owned = stored(owned, "owned")
    found = (scanned.select("_doc", "_text_hash", F.explode("candidate").alias("c")).distinct()
             .select("_doc", "_text_hash", "c.start", "c.end", "c.h1", "c.h2").join(owned, ["h1", "h2"])
             .groupBy("_doc", "_text_hash")
             .agg(F.collect_list(F.when(F.col("is_live"), F.struct("start", F.lit(3).alias("kind"), "end"))).alias("live"),
                  F.count_if(~F.col("is_live")).alias("n_examples")))
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)")
    return (scanned.join(found, ["_doc", "_text_hash"], "left")
            .withColumn("live", F.coalesce("live", none))
            .withColumn("n_examples", F.coalesce("n_examples", F.lit(0)).cast("long")))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans per document."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, "live")).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_examples")
