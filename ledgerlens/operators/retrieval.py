"""Similarity ranking and retrieval: top-k (T1, T2, W2, J4), long-form vectors (M2),
token-budget packing (W3), retrieval prompts (M3), relevance gate (M5),
extractive context (M6) and chat messages (F8)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .. import fixed_values as FV
from ..functions.text import token_count, words
from ..session import broadcast_checked, ship_package, written_once

# Query vectors up to this size are sent to every task (their size is measured first); beyond it, query and corpus
# blocks meet in groups of bounded size. Both ways score with the same tiles.
MAX_BROADCAST_BYTES = 64 << 20
# Vectors scored at once: a tile of corpus rows by a tile of queries, whose scores take TILE_ROWS * TILE_QUERIES * 8 bytes.
TILE_ROWS = 4096
TILE_QUERIES = 1024
# Target size of one corpus block on the blocked way.
GROUP_BYTES = 64 << 20
# Decimals of a float64 product that do not depend on the order of its sums; the shown similarity has fewer.
RANK_DECIMALS = 12
SIM_DECIMALS = 6

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


# ---------------------------------------------------------------------------
# Scores and exact top-k of tiles (numpy inside Arrow batches)
# ---------------------------------------------------------------------------

def cosine_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """cosine similarity of every row to every query; nan for a zero vector."""
    def unit(m):
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)
    return unit(rows) @ unit(queries).T


def _matrix(vec_col: pa.Array, dims: int) -> np.ndarray:
    """(n x dims) float64 matrix of a list<number> column; rows that are NULL, hold a NULL or have another length are nan."""
    if isinstance(vec_col, pa.ChunkedArray):
        vec_col = vec_col.combine_chunks()
    offsets = vec_col.offsets.to_numpy().astype(np.int64)
    fits = (np.diff(offsets) == dims) & ~vec_col.is_null().to_numpy(zero_copy_only=False)
    values = vec_col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(vec_col), dims), np.nan)
    out[fits] = values[offsets[:-1][fits][:, None] + np.arange(dims)]
    return out


def _top_of_tiles(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, scorer: Scorer):
    """(query number, id, score) of the k best of these rows per query, tile by tile.

    Order: score descending, NULL last, then id. Rows with the k-th best score are all kept within a tile and cut by
    id after it, so the result is exact; nothing is carried from tile to tile.
    """
    for r in range(0, len(rows), TILE_ROWS):
        part, part_ids = rows[r:r + TILE_ROWS], ids[r:r + TILE_ROWS]
        for q in range(0, len(queries), TILE_QUERIES):
            score = scorer(part, queries[q:q + TILE_QUERIES])
            key = -np.round(score, RANK_DECIMALS)
            key[np.isnan(key)] = np.inf
            if len(part) > k:
                kth = np.partition(key, k - 1, axis=0)[k - 1]
                at, query = np.nonzero(key <= kth[None, :])
            else:
                at, query = np.divmod(np.arange(key.size), key.shape[1])
            order = np.lexsort((part_ids[at], key[at, query], query))
            at, query = at[order], query[order]
            keep = np.arange(len(query)) - np.searchsorted(query, query) < k
            at, query = at[keep], query[keep]
            yield query + q, part_ids[at], -key[at, query]


def _batches(tops, qids: list, qid_type: pa.DataType):
    for query, ids, score in tops:
        shown = pa.array(score, pa.float64(), mask=np.isinf(score))
        yield pa.RecordBatch.from_arrays(
            [pa.array([qids[j] for j in query.tolist()], type=qid_type), pa.array(ids, pa.int64()), shown],
            names=["qid", "id", "similarity"])


def similarity_candidates(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str = "vec_id",
                          corpus_vec: str = "embedding", query_id: str = "qid", query_vec: str = "qvec",
                          max_broadcast_bytes: int = MAX_BROADCAST_BYTES, blocks: int | None = None,
                          scorer: Scorer = cosine_scores) -> DataFrame:
    """(qid, id, similarity) rows holding, per query, at least the global top-k.

    Vectors have the dimension of the longest query; any other length, and a NULL among the values, scores NULL.
    ``scorer`` takes (rows, queries) as matrices and returns their scores, larger being better.

    The queries (their byte size is measured first) are sent to every task, which scores each Arrow batch in
    tiles, so that its memory is the batch, the queries and one tile, whatever the number of queries. Queries too
    large for that are cut in blocks, as is the corpus, and every (query block, corpus block) is one group of bounded
    size. At most k rows per query and tile reach the shuffle, where a partial limit cuts them again.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    qid_field = queries.schema[query_id]
    qid_arrow = _arrow_type(qid_field.dataType)
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("qvec"))
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(corpus_vec).cast("array<double>").alias("vec"))
    out_schema = T.StructType([T.StructField("qid", qid_field.dataType), T.StructField("id", T.LongType()),
                               T.StructField("similarity", T.DoubleType())])
    # Written once for the size check and its use: the queries may be an aggregate over a large table.
    q = written_once(q, "queries")
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("qvec")).alias("cells"),
                  F.max(F.size("qvec")).alias("dims")).first()
    n_queries, cells, dims = (int(stats[x] or 0) for x in ("n", "cells", "dims"))
    if n_queries == 0:
        return spark.createDataFrame([], out_schema)
    if cells * 8 <= max_broadcast_bytes and blocks is None:
        held = q.toArrow()
        sent = spark.sparkContext.broadcast((held.column("qid").to_pylist(), _matrix(held.column("qvec"), dims)))

        def kernel(batches):
            qids, qmat = sent.value
            for b in batches:
                tops = _top_of_tiles(_matrix(b.column(1), dims), b.column(0).to_numpy(), qmat, k, scorer)
                yield from _batches(tops, qids, qid_arrow)

        return c.where("id IS NOT NULL").mapInArrow(kernel, out_schema)
    q_blocks = blocks or max(2, -(-cells * 8 // max(1, max_broadcast_bytes)))
    c_blocks = max(2, spark.sparkContext.defaultParallelism, -(-c.count() * max(1, dims) * 8 // GROUP_BYTES))
    return _blocked_candidates(c, q, k, out_schema, qid_arrow, q_blocks, c_blocks, dims, scorer)


def _blocked_candidates(c: DataFrame, q: DataFrame, k: int, out_schema: T.StructType, qid_arrow: pa.DataType,
                        q_blocks: int, c_blocks: int, dims: int, scorer: Scorer) -> DataFrame:
    """Query x corpus scoring without a broadcast.

    Each query is copied to every corpus block and each corpus row to every query block; one group per pair of
    blocks scores its pair. No group grows with the data; the copies are the other side's number of blocks.
    """
    qb = (q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int"))
          .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    cb = (c.where("id IS NOT NULL").withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int"))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
        tops = _top_of_tiles(_matrix(rows.column("vec"), dims), rows.column("id").to_numpy(),
                             _matrix(queries.column("qvec"), dims), k, scorer)
        found = list(_batches(tops, queries.column("qid").to_pylist(), qid_arrow))
        return pa.Table.from_batches(found, pa.schema([("qid", qid_arrow), ("id", pa.int64()),
                                                       ("similarity", pa.float64())]))

    return qb.groupBy("qb", "cb").cogroup(cb.groupBy("qb", "cb")).applyInArrow(pair, out_schema)


def _arrow_type(dt: T.DataType) -> pa.DataType:
    mapping = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
               T.ShortType: pa.int16(), T.DoubleType: pa.float64()}
    for cls, at in mapping.items():
        if isinstance(dt, cls):
            return at
    raise TypeError(f"unsupported query id type {dt}")


def top_k_similar(corpus: DataFrame, queries: DataFrame, k: int = FV.DEFAULT_TOP_N, **kw) -> DataFrame:
    """W2 + J4 + F3: the k most similar corpus rows per query, ``rank`` 1..k.

    Ranked at full precision, shown with six decimals; ties go to the lower id;
    zero or NULL vectors score NULL and rank last. The final ranking is a
    ``row_number`` window filtered to ``<= k``, which Spark plans with a
    partial ``WindowGroupLimit`` before its shuffle.
    """
    cand = similarity_candidates(corpus, queries, k, **kw)
    w = Window.partitionBy("qid").orderBy(F.col("similarity").desc_nulls_last(), F.col("id").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("similarity", F.round("similarity", SIM_DECIMALS)))


def top_n_single(corpus: DataFrame, query: DataFrame, n: int = FV.DEFAULT_TOP_N, **kw) -> DataFrame:
    """One query, its n best rows in rank order (a global ``TakeOrderedAndProject``)."""
    cand = similarity_candidates(corpus, query, n, **kw)
    return (cand.orderBy(F.col("similarity").desc_nulls_last(), F.col("id").asc()).limit(n)
            .select("qid", "id", F.round("similarity", SIM_DECIMALS).alias("similarity")))


#: Bytes of a row of a ranking: query, id, similarity, rank, and the row itself.
RANKED_ROW_BYTES = 64


def with_texts(ranked: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """The ranking with the rows of ``texts`` joined on ``key``.

    The ranking holds at most k rows per query. It is written once and counted; a small one is broadcast, so that the
    texts are read where they are and never shuffled, and a large one is joined as the planner sees fit.
    """
    fixed = written_once(ranked, "ranked")
    return texts.join(broadcast_checked(fixed, fixed.count() * RANKED_ROW_BYTES), key)


def relatedness_text(sim: Column) -> Column:
    """A similarity shown with three decimals (half up), e.g. ``0.732``."""
    return sim.cast("decimal(10,6)").cast("decimal(10,3)").cast("string")


def vector_long(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """M2: one row per (id, dimension, value)."""
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double"))


# ---------------------------------------------------------------------------
# Budget packing and prompt assembly
# ---------------------------------------------------------------------------

DEFAULT_INTRO = ("Below are excerpts from a document collection, best match first, and then a question. "
                 "Answer from the excerpts where they cover it and name the gap where they do not.")
DEFAULT_OPEN = "\n\n<excerpt>\n"
DEFAULT_CLOSE = "\n</excerpt>"
DEFAULT_QUESTION_PREFIX = "\n\nThe question is: "


def wrap_passage(text: Column, open_: str = DEFAULT_OPEN, close: str = DEFAULT_CLOSE) -> Column:
    """A passage inside its wrapper."""
    return F.concat(F.lit(open_), text, F.lit(close))


def pack_to_budget(ranked: DataFrame, group: str, rank: str, tokens: str, budget: Column | int,
                   name: str = "cum_tokens") -> DataFrame:
    """Keep rows in rank order while the running token sum stays within the budget.

    Token counts are non-negative, so the running sum only grows: filtering
    on it keeps exactly the prefix before the first overflow (a later row
    that would fit is not reached, as with the original ``break``).
    """
    w = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    b = budget if isinstance(budget, Column) else F.lit(budget)
    return ranked.withColumn(name, F.sum(tokens).over(w)).filter(F.col(name) <= b)


def context_pack(ranked: DataFrame, questions: DataFrame, budget: int = FV.DEFAULT_TOKEN_BUDGET,
                 intro: str = DEFAULT_INTRO, question_prefix: str = DEFAULT_QUESTION_PREFIX) -> DataFrame:
    """W3 over ranked passages ``(qid, rank, id, text)`` with questions ``(qid, question)``.

    Each passage costs the tokens of its wrapped form; the fixed part is the
    introduction plus the question line.
    """
    fixed = questions.select(
        "qid", (token_count(F.lit(intro)) + token_count(F.concat(F.lit(question_prefix), F.col("question"))))
        .alias("fixed_tokens"))
    costed = ranked.withColumn("tokens", token_count(wrap_passage(F.col("text")))).join(fixed, "qid")
    return pack_to_budget(costed, "qid", "rank", "tokens", F.lit(budget) - F.col("fixed_tokens"))


def retrieval_prompt(packed: DataFrame, questions: DataFrame, intro: str = DEFAULT_INTRO,
                     question_prefix: str = DEFAULT_QUESTION_PREFIX) -> DataFrame:
    """M3: introduction + packed passages in rank order + question, per question.

    A question with no passage that fits still gets a prompt.
    """
    bodies = (packed.withColumn("_wrapped", wrap_passage(F.col("text")))
              .groupBy("qid").agg(F.expr("listagg(_wrapped, '') WITHIN GROUP (ORDER BY rank)").alias("_body"),
                                  F.count(F.lit(1)).alias("n_passages")))
    return (questions.join(bodies, "qid", "left")
            .select("qid", "question",
                    F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
                    F.concat(F.lit(intro), F.coalesce("_body", F.lit("")), F.lit(question_prefix),
                             F.col("question")).alias("prompt")))


def relevance_gate(best: DataFrame, prompts: DataFrame, threshold: float,
                   reduced: DataFrame | None = None) -> DataFrame:
    """M5: a question is on topic when its best similarity reaches ``threshold``.

    On-topic questions get the full context (``prompts``); off-topic ones get
    the reduced context (``reduced``, e.g. a prompt packed to a smaller
    budget) when one is given, else an empty one. The expensive branch can be
    filtered on ``relevant`` before any model call.
    """
    top = best.filter(F.col("rank") == 1).select("qid", F.col("similarity").alias("top_similarity"))
    relevant = F.coalesce(F.col("top_similarity") >= F.lit(threshold), F.lit(False))
    joined = prompts.join(top, "qid", "left")
    fallback = F.lit("")
    if reduced is not None:
        joined = joined.join(reduced.select("qid", F.col("prompt").alias("_reduced")), "qid", "left")
        fallback = F.coalesce(F.col("_reduced"), F.lit(""))
    return joined.select("qid", "top_similarity", relevant.alias("relevant"),
                         F.when(relevant, F.col("prompt")).otherwise(fallback).alias("context"))


def extractive_context(questions: DataFrame, texts: DataFrame, key: str,
                       budget: int = FV.SUMMARY_TOKEN_TARGET) -> DataFrame:
    """M6: reduce each key's texts to the lines sharing the most words with its question.

    ``questions``: (key, question); ``texts``: (key, ordinal, text). Lines are
    scored by the number of distinct words shared with the question
    (``array_intersect`` after an equi-join on the key, no pairing of lines
    with each other), ranked best first (ties: earlier line first), packed
    to ``budget`` tokens, and emitted in their original order. Lines with no
    shared word are dropped; a question without any line keeps its row, with an empty context. A partial top-k caps each group's ranking at
    ``budget`` lines (every kept line costs at least one token) before the
    per-group window.
    """
    qwords = questions.select(key, F.array_distinct(words(F.col("question"))).alias("_qw"))
    scored = (texts.join(qwords, key)
              .select(key, "ordinal", "_qw", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
              .withColumn("score", F.size(F.array_intersect(F.array_distinct(words(F.col("line"))), F.col("_qw"))))
              .filter(F.col("score") > 0)
              .withColumn("tokens", token_count(F.col("line"))))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "ordinal", "line_no")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= budget)
    kept = pack_to_budget(ranked, key, "rank", "tokens", budget)
    found = (kept.groupBy(key)
             .agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY ordinal, line_no)").alias("context"),
                  F.count(F.lit(1)).alias("n_lines"), F.max("cum_tokens").alias("tokens")))
    return questions.select(key).join(found, key, "left").select(
        key, F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def chat_messages(system: Column, user: Column) -> Column:
    """F8: the ordered message list (system, user) of one request."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
