"""Text scalar functions (F1, F2, F5, F6, F7, F9, F10) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode "word" and "space" classes of the analysed code's regex engine, spelled
# out so that Java regex (Spark) and RE2 (the SQL oracle) agree character for character.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
# A URL runs from the scheme over the characters ! $..._ a-z (the source pattern's
# character class is a range from '$' to '_', which already holds digits, capitals,
# '%', parentheses, ',', '.', '/', ':' and '@').
URL_PATTERN = r"https?://[!$-_a-z]+"
# F1 in one pass: keep a URL (group 1), delete any other run of non-word, non-space
# characters. A URL starts with a letter, so no deleted run can swallow its start.
CLEAN_PATTERN = rf"({URL_PATTERN})|[^{WORD_CLASS}{SPACE_CLASS}]+"
PUNCT_RUN_PATTERN = rf"[^{WORD_CLASS}{SPACE_CLASS}]+"
# a token is a run of word characters or a single other visible character.
TOKEN_PATTERN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]"
WORD_PATTERN = rf"[{WORD_CLASS}]+"


def clean_text(c: Column) -> Column:
    """drop punctuation except inside URLs, delete newlines/tabs, collapse 5+ spaces.

    Newlines and tabs are deleted, not replaced, so words on both sides fuse,
    as in the original cleanup. URLs never contain spaces, tabs or newlines,
    so keeping them in place is the same as masking and restoring them.
    """
    # Texts without a scheme separator cannot hold a URL: a plain class deletion
    # is several times cheaper than trying the URL branch at every position.
    kept = F.when(F.instr(c, "://") > 0, F.regexp_replace(c, CLEAN_PATTERN, "$1")).otherwise(
        F.regexp_replace(c, PUNCT_RUN_PATTERN, ""))
    no_breaks = F.regexp_replace(kept, r"[\n\t]+", "")
    return F.regexp_replace(no_breaks, " {5,}", " ")


def newline_to_space(c: Column) -> Column:
    """every newline becomes one space."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def token_count(c: Column) -> Column:
    """count word runs and single punctuation marks.

    Counts add up over pieces joined at whitespace, so a running sum of piece
    counts equals the count of the joined text (what budget packing relies on).
    NULL text counts 0 tokens.
    """
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def words(c: Column) -> Column:
    """Lower-cased word runs of a text, as an array (duplicates kept)."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), 0)


def money(c: Column) -> Column:
    """``$1,234.50``; the value is fixed to two decimals before formatting. NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string("$%,.2f", c.cast("decimal(20,2)").cast("double")))


def row_text(*cols: Column | str) -> Column:
    """Non-null cells of a row as strings, joined by single spaces."""
    return F.concat_ws(" ", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
                              for x in cols])


def int_from_text(c: Column) -> Column:
    """integer from text; raises on junk under ANSI mode like the original ``int()``."""
    return F.trim(c).cast("int")


_MONTH_YEAR = r"((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})"


def period_months(title: Column, inclusive: bool = True) -> Column:
    """months implied by a title such as ``August 2017 to August 2018``.

    The two ``Month yyyy`` dates are extracted and differenced; ``inclusive``
    counts both end months (13 for the example), otherwise 12. NULL when the
    title does not hold two dates.
    """
    first = F.try_to_timestamp(F.regexp_extract(title, _MONTH_YEAR, 1), F.lit("MMMM yyyy"))
    last = F.try_to_timestamp(
        F.regexp_extract(title, rf"{_MONTH_YEAR}.*?{_MONTH_YEAR}", 2), F.lit("MMMM yyyy"))
    diff = F.months_between(last, first).cast("int")
    return (diff + F.lit(1 if inclusive else 0)).cast("int")


def month_year_title(start: Column, end: Column) -> Column:
    """``January 1995 to August 2001`` from two timestamps."""
    return F.concat(F.date_format(start, "MMMM yyyy"), F.lit(" to "), F.date_format(end, "MMMM yyyy"))


def parse_timestamp(c: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """Text to timestamp. ``strict`` raises on a bad value (ANSI ``to_timestamp``),
    like the original parser; otherwise a bad value becomes NULL (for quarantine)."""
    if strict:
        return F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
