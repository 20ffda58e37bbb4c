"""Chunks of lines, chunks of bytes, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.functions.text import lines
from veilframe.sources.scratch import materialize, ship


def line_chunks(docs: DataFrame, size: int = 60, overlap: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, chunk_index, start_line, end_line, chunk)``: windows of lines, each beginning ``size - overlap`` after the one before."""
    size = max(size, 1)
    step = size - min(overlap, size - 1)
    cut = docs.select(key, lines(F.col(text)).alias("ls")).where(F.size("ls") > 0)
    last = F.ceil(F.greatest(F.size("ls") - size, F.lit(0)) / step).cast("int")
    each = cut.select(key, "ls", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    start = F.col("i") * step
    return each.select(key, F.col("i").cast("long").alias("chunk_index"), (start + 1).cast("long").alias("start_line"), F.least(start + size, F.size("ls")).cast("long").alias("end_line"), F.array_join(F.slice("ls", start + 1, F.lit(size)), "\n").alias("chunk"))


def byte_ranges(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(first line, line after the last, first line of its own)`` of chunks of about ``target`` bytes of whole lines."""
    out, start, own = [], 0, 0
    while start < len(sizes):
        end, total = start, 0
        while end < len(sizes) and (end == start or total + sizes[end] <= target):
            total += sizes[end]
            end += 1
            if total >= target:
                break
        out.append((start, end, own))
        if end == len(sizes):
            break
        own, start = end, end - min(overlap, (end - start) // 2)
    return out


def byte_chunks(docs: DataFrame, target: int, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, chunk_index, start_line, end_line, core_start_line, chunk)``: a chunk's start depends on the one before, hence Arrow."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<chunk_index:long,start_line:long,end_line:long,core_start_line:long,chunk:string>>")
    def cut(bodies: pd.Series) -> pd.Series:
        from veilframe.operators.chunks import byte_ranges as ranges

        out = []
        for b in bodies:
            rows = (b or "").split("\n")
            rows = [r + "\n" for r in rows[:-1]] + ([rows[-1]] if rows[-1] else [])
            found = ranges([len(r.encode()) for r in rows], target, overlap) if rows else [(0, 1, 0)]
            out.append([{"chunk_index": i, "start_line": a + 1, "end_line": z, "core_start_line": o + 1, "chunk": "".join(rows[a:z])} for i, (a, z, o) in enumerate(found)])
        return pd.Series(out, dtype="object")

    return docs.select(key, F.explode(cut(F.col(text))).alias("c")).select(key, "c.*")


def numbered(rows: DataFrame, by: Column, *order: str) -> DataFrame:
    """Adds ``number``: each row's place in its group by order, from 0. A group of any size is spread over tasks.

    Rows are dealt out by ranges of group and order and ranked within each range; what earlier ranges hold of a group is added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__by", by).repartitionByRange(n, "__by", *order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    counts = dealt.groupBy("__by", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__by").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each group and range, at most as many a group as there are ranges
    start = counts.select(F.col("__by").alias("__b"), F.col("__range").alias("__r"), before.alias("__before"))
    local = dealt.withColumn("__local", F.row_number().over(W.partitionBy("__by", "__range").orderBy(*order)) - 1)
    joined = local.join(start, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn("number", (F.col("__local") + F.col("__before")).cast("long")).drop("__by", "__range", "__b", "__r", "__before", "__local")


def batches(rows: DataFrame, size: int, by: Column, *order: str) -> DataFrame:
    """Adds ``batch``: rows of each group in order, ``size`` at a time."""
    return numbered(rows, by, *order).withColumn("batch", F.floor(F.col("number") / size).cast("long")).drop("number")
