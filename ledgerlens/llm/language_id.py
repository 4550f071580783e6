"""Language identification by multilingual mixture inference.

A text is a bag of letter trigrams (with word edges), drawn from a mixture of languages whose trigram distributions are
counted over all training texts. Expectation-maximisation estimates the proportions of the languages in each text; the
language set is the one of the nested sets of the largest proportions with the best penalised log-likelihood, and the
prediction is the language of the set with the largest proportion.

The counts hold ``2**FEATURE_BITS`` numbers per language however much text is read, which bounds what is sent to the
driver and broadcast.

Cases: a NULL text, an empty one and one without letters is ``und`` with score 0; texts of NULL language are never
learned from; without any training text every text is ``und``; ties go to the language that sorts first; repeated rows
and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNDETERMINED = "und"
FEATURE_BITS = 15
SMOOTHING = 0.5
EM_STEPS = 12
#: Log-likelihood that a further language must add, as a multiple of the log of the number of trigrams.
PENALTY = 4.0
#: Least proportion of a language that is considered for the set.
MIN_SHARE = 0.02
#: Letters handled at once.
BLOCK = 1 << 20

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigram_features(text: str | None) -> np.ndarray:
    """Feature number of every letter trigram of a whole text, in order; none if it has no letter."""
    low = (text or "").lower().encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(low, np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64) if len(codes) else codes.astype(np.uint64)
    if not codes.any():
        return np.zeros(0, np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = np.concatenate([[np.uint64(0)], codes[keep], [np.uint64(0)]])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    h = (a[inner] * np.uint64(1 << 42)) ^ (b[inner] * np.uint64(1 << 21)) ^ c[inner]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) summed over all texts of ``docs`` (text, lang) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = trigram_features(text.as_py())
                if len(f):
                    by_lang.setdefault(lang, []).append(f)
            for lang, parts in by_lang.items():
                n = np.bincount(np.concatenate(parts), minlength=1 << FEATURE_BITS)
                held[lang] = held[lang] + n if lang in held else n
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(n[at].astype(np.int64))], names=["lang", "feature", "n"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    return (rows.mapInArrow(run, "lang string, feature int, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the probability of each trigram feature in each."""

    langs: list[str]
    prob: np.ndarray  # (features, languages)

    def infer(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """Predicted language, its proportion, the language set and the proportions in it."""
        feature = trigram_features(text)
        if not len(feature) or not self.langs:
            return UNDETERMINED, 0.0, [], []
        feature, n = np.unique(feature, return_counts=True)
        p, total = self.prob[feature], int(n.sum())
        share = _mix(p, n, total)[0]
        order = [k for k in np.argsort(-share, kind="stable") if share[k] >= MIN_SHARE] or [int(share.argmax())]
        best = None
        for size in range(1, len(order) + 1):
            chosen = order[:size]
            inner, fit = _mix(p[:, chosen], n, total)
            value = fit - PENALTY * np.log(total + 1) * (size - 1)
            if best is None or value > best[0]:
                best = (value, chosen, inner)
        _, chosen, inner = best
        top = min(range(len(chosen)), key=lambda i: (-inner[i], self.langs[chosen[i]]))
        return (self.langs[chosen[top]], min(1.0, float(inner[top])), [self.langs[k] for k in chosen],
                [float(x) for x in inner])


def _mix(p: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    if len(share) > 1:
        for _ in range(EM_STEPS):
            share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def learn(docs: DataFrame) -> LanguageModel:
    """The model of all training texts (text, lang); the driver receives the summed counts only."""
    rows = (trigram_counts(docs).groupBy("lang")
            .agg(F.collect_list("feature").alias("feature"), F.collect_list("n").alias("n")).collect())
    rows = sorted(rows, key=lambda r: r["lang"])
    count = np.zeros((1 << FEATURE_BITS, len(rows)))
    for k, r in enumerate(rows):
        count[r["feature"], k] = r["n"]
    count += SMOOTHING
    return LanguageModel([r["lang"] for r in rows], count / count.sum(axis=0, keepdims=True))


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """A column (lang, share, langs, shares) of a text column."""
    sent = spark.sparkContext.broadcast((model.langs, model.prob))

    @F.pandas_udf("lang string, share double, langs array<string>, shares array<double>")
    def infer(texts: pd.Series) -> pd.DataFrame:
        own = LanguageModel(*sent.value)
        return pd.DataFrame([own.infer(t) for t in texts], columns=["lang", "share", "langs", "shares"])

    return infer(text.cast("string"))
