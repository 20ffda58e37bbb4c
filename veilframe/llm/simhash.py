"""SimHash near-duplicate detection by Golay-code fuzzy hashing (operator 6).

A text's fingerprint has 64 bits: bit ``b`` is set if more than half of the XXH64 values (seed 42) of its
3-word shingles have it. Two fingerprints link if at most 3 bits differ.

Candidate search decodes instead of masking. A fingerprint is cut into segments of 21, 21 and 22 bits, each
padded with zeros to the 23 bits of the perfect binary Golay code. Every 23-bit vector lies within distance 3 of
exactly one codeword, so with a bit changed it lies within distance 4 of that same codeword. A segment thus
has one *home* codeword, and one or six *near* ones (all within distance 4): of two segments that differ in one bit at most, each one's
home is near the other.

Three errors over three segments either leave one segment without an error and another with one at most (3+0+0, 2+1+0 and less), or
they are one in each (1+1+1). So linked fingerprints agree in one of seven keys: a segment as it is (21 or 22 bits) with
a codeword of another (12 bits), for six ordered pairs; or the codewords of all three (36 bits). One side of the join has home
codewords, seven keys a fingerprint, the other all near ones, about 180. Among fingerprints that are alike by chance only, a key brings together one pair
in 2^33 and more, at a sixth to a thirtieth for each home key's near ones. The join's residual condition verifies the distance.
Equal fingerprints are one class before the join, so copies never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.graph import connected_components
from veilframe.llm.shared import materialize, ship

SEED = 42
SHINGLE = 3
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GENERATOR = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Which segment a key holds as it is, and of which it holds a codeword.
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
#: Bits below a key's number, and of a codeword's index.
KEY_BITS, WORD_BITS = 36, 12


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(64, np.int64)
    array = np.array(hashes, dtype=">u8")
    for at in range(0, len(array), 1 << 16):  # bounded memory for very long texts
        part = array[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(array)).view(">u8")[0])


def remainders(x: np.ndarray) -> np.ndarray:
    """Syndromes: the remainder of each 23-bit vector by the generator polynomial."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


class Golay:
    """Syndrome decoder: for each of 2048 syndromes the error patterns of weight up to 4, the lightest first."""

    def __init__(self) -> None:
        weights = {w: [] for w in range(5)}
        bits = [1 << i for i in range(23)]
        weights[0] = [0]
        for w in range(1, 5):
            weights[w] = sorted({p | b for p in weights[w - 1] for b in bits if not p & b})
        self.low = remainders(np.arange(1 << 12))
        self.high = remainders(np.arange(1 << 11) << 12)
        self.patterns = np.zeros((2048, 6), np.int64)
        self.count = np.zeros(2048, np.int64)
        for w in range(5):
            errors = np.array(weights[w], np.int64)
            for s, e in zip(self.syndrome(errors).tolist(), errors.tolist(), strict=True):
                self.patterns[s, self.count[s]] = e
                self.count[s] += 1

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices within distance 4, home first, as an (n, 6) matrix, and how many each row has."""
        s = self.syndrome(x)
        return (x[:, None] ^ self.patterns[s]) >> 11, self.count[s]


_golay: Golay | None = None


def codewords(prints: np.ndarray) -> list[list[np.ndarray]]:
    """Of each fingerprint the indices of the near codewords of its three segments, home first."""
    global _golay
    _golay = _golay or Golay()
    prints = prints.astype(np.uint64)
    found = [_golay.near(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    return [[x[i, : n[i]].astype(np.int32) for x, n in found] for i in range(len(prints))]


def _segment(fp: Column, k: int) -> Column:
    at, n = SEGMENTS[k]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def keys(fp: Column, near: Column, home_only: bool) -> Column:
    """``array<long>``: the seven keys with home codewords, or all keys with near ones, of ``fp`` and its ``near`` codewords."""
    words = [F.transform(F.slice(near[k], 1, 1) if home_only else near[k], lambda w: w.cast("long")) for k in range(3)]

    def pair_keys(number: int, i: int, j: int) -> Column:
        head = F.shiftleft(_segment(fp, i), WORD_BITS).bitwiseOR(F.lit(number << KEY_BITS).cast("long"))
        return F.transform(words[j], lambda w: head.bitwiseOR(w))

    made = [pair_keys(number, i, j) for number, (i, j) in enumerate(PAIRS)]
    start = F.lit(len(PAIRS) << KEY_BITS).cast("long")
    pair = F.flatten(F.transform(words[0], lambda x: F.transform(words[1], lambda y: start.bitwiseOR(F.shiftleft(x, 2 * WORD_BITS)).bitwiseOR(F.shiftleft(y, WORD_BITS)))))
    made.append(F.flatten(F.transform(pair, lambda xy: F.transform(words[2], lambda z: xy.bitwiseOR(z)))))
    return F.concat(*made)


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, extra..., fp long)`` for each row; narrow, no shuffle."""
    ship(docs.sparkSession)
    kept = [id_col, *extra]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilframe.llm.simhash import fingerprint as one

        for batch in batches:
            texts = batch.column(len(kept))
            fp = np.fromiter((one(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(fp)], [*kept, "fp"])

    chosen = docs.select(*kept, F.col(text).alias("__sim_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*kept).schema) + ", fp long"
    return chosen.mapInArrow(compute, schema)


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(a, b)`` with ``a < b`` for all distinct fingerprints that differ in at most ``max_bits`` (3 or fewer) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the segments bear three errors at most")
    ship(prints.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from veilframe.llm import simhash

        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                fp = pdf["fp"].to_numpy()[at : at + 4096]
                yield pd.DataFrame({"fp": fp, "near": simhash.codewords(fp)})

    # a row of the decoded table becomes about 190 keys, so it is dealt out before
    dealt = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    decoded = materialize(dealt.mapInPandas(decode, "fp long, near array<array<int>>"), "golay-words")
    index = decoded.select(F.col("fp").alias("a"), F.explode(keys(F.col("fp"), F.col("near"), True)).alias("key"))
    probe = decoded.select(F.col("fp").alias("b"), F.explode(keys(F.col("fp"), F.col("near"), False)).alias("key"))
    near_enough = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (F.col("a") != F.col("b"))
    found = index.join(probe, (index["key"] == probe["key"]) & near_enough)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct ``fp`` of ``prints(id_col, fp)``.

    ``root`` is the smallest fingerprint of the component. ``component_id`` is the smallest id of the component; null only if all its ids are null. An empty table
    gives an empty one. Equal fingerprints, that of texts without words included, are always together.
    """
    classes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-classes")
    edges = materialize(links(classes, max_bits), "simhash-links")
    roots = connected_components(edges)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, fp (long), component_id. Null texts count as empty."""
    prints = materialize(fingerprints(docs, text, id_col), "simhash-prints")
    classes = near_duplicates(prints, id_col, max_bits)
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the one with the smallest id (null ids last).

    Rows that repeat in id and text count as one row. Only ids and hashes are shuffled by component; the texts
    meet the winners in one join by id.
    """
    tagged = docs.withColumn("__sim_hash", F.xxhash64(F.col(text)))
    prints = materialize(fingerprints(tagged, text, id_col, ("__sim_hash",)), "simhash-prints")
    classes = near_duplicates(prints, id_col)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__sim_hash").alias("h")))
    winners = prints.join(classes, "fp").groupBy("root").agg(first.alias("w"))
    winners = materialize(winners.select(F.col("w.id").alias("__sim_id"), F.col("w.h").alias("__sim_h")), "simhash-winners")
    on = F.col(id_col).eqNullSafe(F.col("__sim_id")) & (F.col("__sim_hash") == F.col("__sim_h"))
    kept = tagged.join(winners, on).drop("__sim_id", "__sim_h")
    repeated = materialize(prints.groupBy(id_col, "__sim_hash").count().where("count > 1").select(F.col(id_col).alias("__sim_rid"), F.col("__sim_hash").alias("__sim_rh")), "simhash-repeats")
    again = F.col(id_col).eqNullSafe(F.col("__sim_rid")) & (F.col("__sim_hash") == F.col("__sim_rh"))
    if repeated.isEmpty():
        return kept.drop("__sim_hash")
    once = kept.join(repeated, again, "left_anti")
    return once.unionByName(kept.join(repeated, again, "left_semi").dropDuplicates([id_col, "__sim_hash"])).drop("__sim_hash")
