"""Batch model operators: embedding (M1), completion with fallback (M4), section
requests (M7) and usage cost (A10).

External models are *injected*: a provider is a picklable factory returning an
object with ``complete(prompts) -> list[(content, prompt_tokens, completion_tokens)]``
or ``embed(texts) -> list[list[float]]``. It is created once per partition and
called once per Arrow batch (section writing: once per section).
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD_PATTERN, clean_text
from ..session import ship_package, written_once
from ..sources.sheets import located

COMPLETION_FIELDS = [
    T.StructField("content", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
]


def complete_batch(df: DataFrame, id_col: str, prompt_col: str, primary: Callable[[], object],
                   fallback: Callable[[], object] | None = None) -> DataFrame:
    """M4: answer every prompt, primary provider first, fallback on failure.

    A whole Arrow batch goes to the primary in one call. A call that fails is
    cut in halves, so that a bad prompt costs a few calls and its neighbours are
    still answered in large ones; a single prompt that fails goes to the
    fallback. A row that fails on both gets its error text and NULL content.
    Filter rows *before* this operator: a ``when`` around it would not skip the calls.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *COMPLETION_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prim, fb = primary(), fallback() if fallback is not None else None
        for pdf in batches:
            answers = _answers(["" if p is None else p for p in pdf[prompt_col].tolist()], prim, fb)
            yield pd.DataFrame([(i, *a) for i, a in zip(pdf[id_col].tolist(), answers)], columns=schema.names)

    return df.select(F.col(id_col), F.col(prompt_col)).mapInPandas(run, schema)


_STORED = T.StructType([T.StructField("key", T.StringType()), *COMPLETION_FIELDS])


def complete_once(df: DataFrame, id_col: str, prompt_col: str, primary: Callable[[], object],
                  fallback: Callable[[], object] | None, store: str) -> DataFrame:
    """M4 with a content-addressed store of answers: a request that has been answered is never asked, or paid, again.

    A request is known by the SHA-256 of its prompt (NULL: the empty prompt); equal prompts are one request. Requests with
    an answer in ``store`` (a folder on storage that all tasks reach) are left out by an anti-join. The others are asked
    in Arrow batches in order of their hashes, and each batch's answers are put into the store, under the hash of its
    requests, before the next batch is asked. So a task that is retried, or a job that is run again after a failure,
    asks only what has no answer yet. Failed requests are returned with their error and not stored.
    Returns (id, content, provider, prompt_tokens, completion_tokens, error) per row of ``df``.
    """
    spark = df.sparkSession
    ship_package(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(store)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(prompt_col), F.lit("")).alias("prompt")).withColumn(
        "key", F.sha2(F.col("prompt").cast("binary"), 256))
    known = lambda: spark.read.schema(_STORED).parquet(store).dropDuplicates(["key"])
    todo = (rows.groupBy("key").agg(F.any_value("prompt").alias("prompt"))
            .join(known().select("key"), "key", "left_anti").sortWithinPartitions("key"))
    kinds = pa.schema([("key", pa.string()), ("content", pa.string()), ("provider", pa.string()), ("prompt_tokens", pa.int64()),
                       ("completion_tokens", pa.int64()), ("error", pa.string())])

    def place(folder: str, asked: dict[str, str]) -> str:
        return f"{folder}/{hashlib.sha256(''.join(asked).encode()).hexdigest()}.parquet"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prim, fb = primary(), fallback() if fallback is not None else None
        fs, folder = located(store.rstrip("/"))
        for pdf in batches:
            asked = dict(zip(pdf["key"].tolist(), pdf["prompt"].tolist()))
            at = place(folder, asked)
            while asked and fs.get_file_info(at).type != pafs.FileType.NotFound:  # of an earlier attempt of this task
                for key in pq.read_table(at, columns=["key"], filesystem=fs).column(0).to_pylist():
                    asked.pop(key, None)
                at = place(folder, asked)
            found = [(k, *a) for k, a in zip(asked, _answers(list(asked.values()), prim, fb))]
            done = [dict(zip(kinds.names, r)) for r in found if r[-1] is None]
            if done:
                hidden = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    pq.write_table(pa.Table.from_pylist(done, kinds), out)
                fs.move(hidden, at)
            yield pd.DataFrame([r for r in found if r[-1] is not None], columns=_STORED.names)

    failed = written_once(todo.mapInPandas(ask, _STORED), "failed")
    answers = known().join(failed.select("key"), "key", "left_anti").unionByName(failed)
    return rows.select("id", "key").join(answers, "key").drop("key")


def _answers(prompts: list[str], prim, fb) -> list[tuple]:
    """(content, provider, prompt tokens, completion tokens, error) per prompt."""
    try:
        return [(c, prim.name, pt, ct, None) for c, pt, ct in prim.complete(prompts)] if prompts else []
    except Exception as e:  # noqa: BLE001 - provider errors are data here
        if len(prompts) > 1:
            half = len(prompts) // 2
            return _answers(prompts[:half], prim, fb) + _answers(prompts[half:], prim, fb)
        error = e
    if fb is not None:
        try:
            return [(c, fb.name, pt, ct, None) for c, pt, ct in fb.complete(prompts)]
        except Exception as e:  # noqa: BLE001
            error = e
    return [(None, None, None, None, f"{type(error).__name__}: {error}")]


def embed_hashing(df: DataFrame, text_col: str, dims: int = 256, out: str = "embedding") -> DataFrame:
    """M1 offline default: clean (F1), tokenize, hash term counts, L2-normalise.

    Entirely JVM-side Spark ML transformers; the vector becomes ``array<double>``. A NULL text is an empty one.
    """
    cleaned = df.withColumn("_clean", F.lower(clean_text(F.coalesce(F.col(text_col), F.lit("")))))
    tok = RegexTokenizer(inputCol="_clean", outputCol="_tokens", pattern=WORD_PATTERN, gaps=False,
                         toLowercase=False)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims)
    norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
    vec = norm.transform(tf.transform(tok.transform(cleaned)))
    return vec.withColumn(out, vector_to_array(F.col("_vec"))).drop("_clean", "_tokens", "_tf", "_vec")


def embed_with_provider(df: DataFrame, id_col: str, text_col: str, provider: Callable[[], object],
                        out: str = "embedding") -> DataFrame:
    """M1 with an injected embedding provider, one call per Arrow batch."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])

    ship_package(df.sparkSession)

    def run(batches):
        p = provider()
        for pdf in batches:
            vecs = p.embed(pdf[text_col].fillna("").tolist())
            yield pd.DataFrame({id_col: pdf[id_col], out: vecs})

    return df.select(id_col, clean_text(F.col(text_col)).alias(text_col)).mapInPandas(run, schema)


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """A10: tokens and cost per model; prices are per 1,000 tokens, keyed by model.

    Prices become exact decimals per token, so costs sum without rounding
    drift; a model without a price gets a NULL cost.
    """
    per_token = prices.select(
        "model",
        (F.col("prompt_price").cast("decimal(19,10)") / F.lit(1000)).cast("decimal(19,13)").alias("_pp"),
        (F.col("completion_price").cast("decimal(19,10)") / F.lit(1000)).cast("decimal(19,13)").alias("_cp"))
    totals = usage.groupBy("model").agg(F.count(F.lit(1)).alias("requests"),
                                        F.sum("prompt_tokens").alias("prompt_tokens"),
                                        F.sum("completion_tokens").alias("completion_tokens"))
    # No broadcast hint: the price list is a parameter table, so the planner
    # broadcasts it from its measured size when small and shuffles otherwise.
    joined = totals.join(per_token, "model", "left")
    # decimal(18,0) x decimal(19,13) stays within 38 digits, so no scale is lost.
    cost = (F.col("prompt_tokens").cast("decimal(18,0)") * F.col("_pp")
            + F.col("completion_tokens").cast("decimal(18,0)") * F.col("_cp"))
    return joined.select("model", "requests", "prompt_tokens", "completion_tokens",
                         cost.cast("double").alias("cost"))


def section_request(instruction: Column, previous_text: Column, tables_text: Column, prompt: Column) -> Column:
    """M7: the system text of one section request: instruction, earlier sections, data tables."""
    return F.concat(instruction, F.lit("\nSections written so far:\n"), previous_text,
                    F.lit("\nData tables:\n"), tables_text, F.lit("\nTask: "), prompt)


REPORT_SCHEMA = T.StructType([
    T.StructField("report_id", T.LongType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("label", T.StringType()),
    *COMPLETION_FIELDS,
])


def write_reports(sections: DataFrame, instruction: str, tables_text: Column, primary: Callable[[], object],
                  fallback: Callable[[], object] | None = None) -> DataFrame:
    """M7: write every report section by section, each request seeing the text so far.

    ``sections``: (report_id, ordinal, label, prompt). Inside a report the
    sections are sequential (section n's request carries sections 1..n-1 as
    generated); different reports run in parallel. A task streams its reports in
    order with one provider and holds the text of one report so far.
    ``tables_text`` (e.g. a scalar subquery of the flattened result tables)
    is attached to every section row.
    """
    ship_package(sections.sparkSession)
    rows = (sections.select("report_id", "ordinal", "label", "prompt", tables_text.alias("tables_text"))
            .repartition("report_id").sortWithinPartitions("report_id", "ordinal"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prim, fb = primary(), fallback() if fallback is not None else None
        report, previous = None, ""
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.report_id != report:
                    report, previous = r.report_id, ""
                request = (f"{instruction}\nSections written so far:\n{previous}\nData tables:\n{r.tables_text}"
                           f"\nTask: {r.prompt}")
                answer = _answers([request], prim, fb)[0]
                out.append((r.report_id, r.ordinal, r.label, *answer))
                previous += f"{r.label}: {answer[0] or ''}\n"
            yield pd.DataFrame(out, columns=REPORT_SCHEMA.names)

    return rows.mapInPandas(run, REPORT_SCHEMA)
