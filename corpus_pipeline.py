"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

toxicity -> near-dedup -> personal data -> source mix -> byte-level BPE

A stage takes ``(spark, docs, sf_dir)``, ``docs`` with the columns ``doc_id, text, lang, source`` and any others, and returns a frame; all but the last one return the
columns of ``docs``. Whatever other columns are named, they pass through; names that begin with ``__`` are the stages' own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, mixing, pii, simhash, toxicity
from veilframe.llm.shared import materialize, table
from veilframe.sources.scratch import remove, scratch_space, written_by

TOKENIZER = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is 0.5 or more go.

    Null and empty texts score as an unknown word, which is far below unless most labelled rows are toxic. Equal texts score the same, so repeated rows go or stay together; very long texts
    are scored whole. Without labels nothing goes; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(docs, model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies by SimHash the row with the smallest id stays (null ids last).

    Null texts, empty ones and those without words are one group. Rows that repeat in id and text count as one. Of a group without ids the row with the smallest
    hash of its text stays. Very long texts are fingerprinted whole; an empty table stays empty.
    """
    return simhash.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts become kind names in brackets; ``n_chars``, where there is such a column, follows.

    Null texts stay null, with a null ``n_chars``. Every row stays, repeated ones and those without ids too; equal texts become equal; a very long text is redacted whole.
    """
    clean = docs.withColumn("text", pii.redacted(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, up to three times.

    Rows without words (null, empty, white space) are never taken. A null source is the last one. Ties go by id and text, so a rerun takes the same rows; rows that repeat count each, and a very
    long one counts by its words as any other. An empty table stays empty.
    """
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text in place of it: ``ids``, ``n_tokens`` and ``exact`` (whether decoding gives the text back), beside the other columns.

    Null and empty texts have no ids. A row for each row, repeated ones and those without ids too. Columns of ``docs`` that are named like a result are left out.
    """
    shared = bpe.load(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return bpe.encode_table(docs, shared, keep=tuple(c for c in docs.columns if c not in ("text", "ids", "n_tokens", "exact")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Trained models, components and dynamic programming are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole of ``documents``. Of what they write on the way only the last stage's table is left."""
    docs, before = table(spark, sf_dir, "documents"), set()
    for name, stage in STAGES:
        with scratch_space(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.pop()  # the stage's own table, which was made last
        remove(spark, before)
        before = written_by(docs) if docs.inputFiles() else set()
    return docs
