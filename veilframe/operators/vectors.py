"""Exact vector search, and upkeep of vectors by fingerprint."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.sources.scratch import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, different lengths, a zero norm or no number."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(fine, F.nanvl(dot(a, b) / norms, F.lit(0.0))), F.lit(0.0))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(key, score)`` of the ``k`` nearest; ties by key. The vector column alone is scanned, and each task keeps ``k`` rows."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(vector), literal).alias("score")).orderBy(F.desc("score"), key).limit(k)


def top_k_by(vectors: DataFrame, queries: DataFrame, k: int, by: str, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(by, key, score)``: of each group the ``k`` rows nearest to its query; ``queries(by, query)`` has a row a group."""
    scored = vectors.join(queries, by).select(by, key, cosine(F.col(vector), F.col("query")).alias("score"))
    return scored.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), key))).where(F.col("_n") <= k).drop("_n")


def stale_embeddings(state: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, outcome)``: embed (new or other content or model), current, or sweep (document gone)."""
    s = state.select(F.col(key).alias("s_key"), F.col("sha").alias("s_sha"), F.col("model").alias("s_model"))
    joined = docs.select(key, "sha", "model").join(s, F.col(key) == F.col("s_key"), "full_outer")
    outcome = F.when(F.col(key).isNull(), "sweep").when((F.col("sha") == F.col("s_sha")) & (F.col("model") == F.col("s_model")), "current").otherwise("embed")
    return joined.select(F.coalesce(key, "s_key").alias(key), outcome.alias("outcome"))


class Busy(RuntimeError):
    """A model's answer that it may be asked again, after ``retry_after`` seconds if it says so."""

    def __init__(self, message: str = "busy", retry_after: float | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after

    def __reduce__(self):  # noqa: ANN204
        return type(self), (str(self), self.retry_after)


#: Tries of a batch, seconds before the second one (doubled for each further one), and the most that a model may make us wait.
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 0.5, 30.0
TRANSIENT = (Busy, TimeoutError, ConnectionError)


def ask(model: Callable[[list[str]], list[list[float]]], texts: list[str], wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """A model's vectors for some texts.

    It is asked three times where the failure may pass (``TRANSIENT``), after waiting as long as it says (30 seconds at most) or half a second, then one. Other
    errors are raised at once, and so is an answer with another number of vectors.
    """
    for attempt in range(TRIES):
        try:
            found = model(texts)
        except TRANSIENT as e:
            if attempt == TRIES - 1:
                raise
            asked = getattr(e, "retry_after", None)
            wait(min(FIRST_WAIT * 2**attempt if asked is None else max(asked, 0.0), LONGEST_WAIT))
        else:
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
    raise AssertionError


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "chunk", batch: int = 64, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds ``vector`` by a caller's model, a batch at a time, as ``ask`` does."""
    ship(chunks.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", vector array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from veilframe.operators.vectors import ask as vectors_of

        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.assign(vector=vectors_of(model, part[text].tolist(), wait))

    return chunks.mapInPandas(run, schema)


def commit_embeddings(state: DataFrame, vectors: DataFrame, fresh: DataFrame, docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(state, vectors)`` after an embedding run: ``fresh(key, sha, model, ...)`` counts only for documents whose hash is still that one.

    Documents that are gone are swept from both tables, and a document's old rows go when its new ones come.
    """
    now = docs.select(F.col(key).alias("_key"), F.col("sha").alias("_sha"))
    good = fresh.join(now, (F.col(key) == F.col("_key")) & (F.col("sha") == F.col("_sha")), "left_semi")
    done = good.select(key, "sha", "model").distinct()
    alive = lambda rows: rows.join(now, F.col(key) == F.col("_key"), "left_semi").join(done.select(key), key, "left_anti")
    return alive(state).unionByName(done.select(state.columns)), alive(vectors).unionByName(good.select(vectors.columns))


def search_gate(state: DataFrame, docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """One row: how many documents have no vectors, vectors of another content, or of another model, and whether a search may go ahead."""
    s = state.select(F.col(key).alias("_key"), F.col("sha").alias("_sha"), F.col("model").alias("_model"))
    j = docs.select(key, "sha").join(s, F.col(key) == F.col("_key"), "left")
    n = lambda c, name: F.count_if(c).alias(name)
    counted = j.agg(n(F.col("_key").isNull(), "n_missing"), n(F.col("_key").isNotNull() & (F.col("_sha") != F.col("sha")), "n_stale"), n(F.col("_key").isNotNull() & (F.col("_model") != model), "n_other_model"))
    return counted.withColumn("usable", (F.col("n_missing") == 0) & (F.col("n_stale") == 0) & (F.col("n_other_model") == 0))


def semantic_search(chunks: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id") -> DataFrame:
    """``(key, score, preview)``: vectors are scored first, texts fetched for the winners only (``k`` rows, so their side may be broadcast).

    A preview is the first line that is not blank, 160 characters of it.
    """
    best = top_k(chunks, query, k, "vector", key)
    first = F.element_at(F.filter(F.split("chunk", "\n"), lambda x: F.trim(x) != ""), 1)
    texts = chunks.select(key, "chunk").join(F.broadcast(best), key)
    return texts.select(key, "score", F.coalesce(F.substring(F.trim(first), 1, 160), F.lit("")).alias("preview"))
