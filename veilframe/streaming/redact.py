"""Streams: stateless redaction line by line, and incremental index passes over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.functions.matcher import Term
from veilframe.operators.render import replace_longest, replace_terms


def redact_lines(lines: DataFrame, pairs: list[tuple[str, str]], terms: list[Term] | None = None, text: str = "value") -> DataFrame:
    """A stream (or table) of lines with exact patterns and terms replaced; it keeps no state, so rows appear as they come."""
    clean = lines.withColumn(text, replace_longest(F.col(text), pairs))
    return clean.withColumn(text, replace_terms(clean, terms, text)) if terms else clean


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream as Parquet, exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(changes: DataFrame, one_pass: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs an index pass on each micro-batch of changed documents. A pass must be idempotent by its batch number."""
    return changes.writeStream.foreachBatch(one_pass).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_index(changes: DataFrame, state_root: str, terms: list[Term], checkpoint: str, salt: str = "", key: str = "doc_id") -> StreamingQuery:
    """Keeps a versioned index state at ``state_root`` up to date with a stream of documents ``(key, text)``; a null text removes a document.

    Each micro-batch is one index pass over the documents in it. The batch number is the state's version, so a batch that is run again after a failure finds its version
    written and changes nothing.
    """
    from veilframe.operators import incremental, indexing
    from veilframe.sources.corpus import current_version, read_snapshot, write_snapshot

    def one(batch: DataFrame, number: int) -> None:
        version = current_version(batch.sparkSession, state_root)
        if version is not None and version >= number:
            return
        # of several rows of a document in a batch the largest text counts, whatever their order
        latest = batch.groupBy(key).agg(F.max("text").alias("text"))
        listing = latest.where("text is not null").select(key, F.lit(0).cast("long").alias("mtime"), F.octet_length("text").cast("long").alias("length"))
        state = indexing.empty_state(listing, key) if version is None else read_snapshot(batch.sparkSession, state_root)
        touched = state.join(latest.select(key), key, "left_semi")
        done = indexing.index_workspace(touched, listing, lambda due: latest.join(due, key, "left_semi"), terms, salt, key=key)
        write_snapshot(incremental.merge(state, done.state, latest.select(key), key), state_root, number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
