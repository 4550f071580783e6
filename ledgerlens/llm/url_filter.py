"""URL filter by a weighted vocabulary.

One Aho-Corasick automaton finds every term of the vocabulary in the lower-cased URL; a hit counts if no letter or
digit stands beside it. One strict term, or soft terms whose distinct weights add up to the limit, reject the URL.
Rules of the site's owner (host and path prefix) come first; of those that fit, the longest wins.

Cases: a NULL URL and one without ``://`` have empty host and path and are judged by the vocabulary alone (NULL: as an
empty URL); ties of rule length go to the rule that sorts first; repeated rows are judged alike; an empty table gives
no rows; further columns stay, and columns of the names that are added are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (host, path prefix, verdict)
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: One of these rejects a URL.
STRICT_TERMS = ["adultvideo", "betting", "casino", "escort", "hentai", "phishing", "porn", "pornhub", "sportsbook",
                "viagra", "warez", "webcamsex", "xxx"]
#: Weights of terms that reject a URL together with others.
SOFT_TERMS = {"adult": 1, "ads": 1, "bet": 1, "bets": 1, "bonus": 1, "cam": 1, "cheap": 1, "cracked": 1, "discount": 1,
              "farm": 1, "free": 1, "gamble": 1, "hot": 1, "keygen": 1, "loan": 1, "payday": 1, "pharmacy": 1, "pill": 1,
              "pills": 1, "poker": 1, "promo": 1, "sex": 1, "slots": 1, "spam": 1, "torrent": 1, "track": 1, "win": 1,
              "x": 1}
#: Weight of distinct soft terms that rejects.
SOFT_LIMIT = 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host is the URL's or a parent domain and whose path is a prefix."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in reversed(rules):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def _automaton(strict: list[str], soft: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in [*soft.items(), *((t, None) for t in strict)]:
        found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def term_counts(url: Column, strict: list[str] | None = None, soft: dict[str, float] | None = None) -> Column:
    """A column (strict, soft, weight): distinct strict and soft terms of the URL, and the weight of the soft ones."""
    strict, soft = STRICT_TERMS if strict is None else strict, SOFT_TERMS if soft is None else soft

    @F.pandas_udf("strict long, soft long, weight double")
    def count(urls: pd.Series) -> pd.DataFrame:
        automaton, rows = _automaton(strict, soft), []
        for u in urls:
            u = u or ""
            hits: dict[str, float | None] = {}
            for last, (term, weight) in automaton.iter(u) if len(automaton) else ():
                first = last - len(term) + 1
                if not (first and _in_word(u[first - 1])) and not (last + 1 < len(u) and _in_word(u[last + 1])):
                    hits[term] = weight
            weights = [w for w in hits.values() if w is not None]
            rows.append((len(hits) - len(weights), len(weights), float(sum(weights))))
        return pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return count(ascii_lower(url))


def _in_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge(pages: DataFrame, limit: float = SOFT_LIMIT, rules=None, strict=None, soft=None) -> DataFrame:
    """``pages`` with host, path, rule (NULL if none fits), verdict, n_strict, n_soft and soft_weight."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("_terms", term_counts(F.col("url"), strict, soft))
    rejected = (F.col("_terms.strict") > 0) | (F.col("_terms.weight") >= limit)
    return (out.withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(ruled, F.when(rejected, "block").otherwise("allow")))
            .withColumn("n_strict", F.col("_terms.strict")).withColumn("n_soft", F.col("_terms.soft"))
            .withColumn("soft_weight", F.col("_terms.weight")).drop("_terms"))
