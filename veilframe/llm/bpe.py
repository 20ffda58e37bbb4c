"""Byte-level BPE encoding and decoding over padded numpy matrices (operator 3).

A text is cut into pieces by the tokenizer's pattern and each piece is encoded by itself. Pieces that a worker has not
met lately are put, by length, into padded matrices of byte ids. In each round every row of a matrix merges its
leftmost pair of minimum rank; as each row loses exactly one element, compaction is one boolean selection that
drops a column. Ranks of pairs come from an open-addressing hash table in numpy. Rows without a
mergeable pair leave the matrix. Pieces beyond ``MATRIX_BYTES`` are merged with a heap, which takes the same merges in the
same order, because a matrix would take quadratic time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import ship

NONE = np.iinfo(np.int32).max
#: Longest piece that goes into a matrix.
MATRIX_BYTES = 512
#: Elements of a matrix, and pieces that a worker remembers; both bound memory and change no result.
MATRIX_CELLS = 1 << 19
REMEMBERED = 200_000
#: Characters of text that are encoded together.
GROUP_CHARS = 1_500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """``(left id, right id) -> rank`` for every way to cut a token in two tokens; linear probing, all in numpy."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left << 32 | right
        slots, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(waiting):
            free = self.keys[slots[waiting]] < 0
            self.keys[slots[waiting[free]]] = keys[waiting[free]]  # of several that want a slot the last one gets it
            placed = self.keys[slots[waiting]] == keys[waiting]
            self.values[slots[waiting[placed]]] = rank[waiting[placed]]
            waiting = waiting[~placed]
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(waiting))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, ``NONE`` where no token is made of the two or an id is negative (padding)."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NONE)
        todo = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return np.where((left < 0) | (right < 0), NONE, out)


class Encoder:
    """Encodes and decodes with one rank file and one pattern; remembers pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.pattern = regex.compile(pattern)
        # only of the published pattern is it known where a space begins a match
        self.space_led = pattern == public_tokenizers.PATTERN
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = {r: t for t, r in ranks.items()}
        size = max(self.token_bytes) + 1
        self.lengths = np.array([len(self.token_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(size)), np.uint8)
        self.known: dict[str, bytes] = {}

    # -- pieces -----------------------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, as the bytes of int32. A piece that is a token itself is that token."""
        out: list[bytes | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = self.ranks[p].to_bytes(4, sys.byteorder)
            elif len(p) > MATRIX_BYTES:
                out[i] = self._merge_heap(p).tobytes()
            else:
                buckets.setdefault(max(4, -(-len(p) // 4) * 4), []).append(i)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                rows = members[at : at + step]
                for i, ids in zip(rows, self._merge_matrix([pieces[i] for i in rows], width), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width)[None, :] < size[:, None], self.byte_id[raw], -1).astype(np.int32)
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1).astype(np.int32)
        rows, done = np.arange(n), [None] * n
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            lines = np.arange(len(rows))
            best = ranks[lines, at] if ranks.shape[1] else np.full(len(rows), NONE)
            ended = best == NONE
            if ended.any():
                over = ids[ended]
                real = over >= 0
                flat, edge = over[real].tobytes(), 0
                for k, n_ids in zip(rows[ended].tolist(), real.sum(axis=1).tolist(), strict=True):
                    done[k] = flat[edge : edge + 4 * n_ids]
                    edge += 4 * n_ids
                ids, ranks, rows, at, best = ids[~ended], ranks[~ended], rows[~ended], at[~ended], best[~ended]
                lines = np.arange(len(rows))
                if not len(rows):
                    break
            ids[lines, at] = best
            keep = np.ones(ids.shape, bool)
            keep[lines, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[lines, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)  # the merged pair's column is gone: at-1 and at now touch the new token
            for column, ok in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                k, c = lines[ok], column[ok]
                ranks[k, c] = self.pairs.look_up(ids[k, c], ids[k, c + 1])
        return done

    def _merge_heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        starting = self.pairs.look_up(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(starting[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(starting != NONE).tolist()]
        heapq.heapify(heap)
        merged: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in merged:
                merged[a, b] = self.ranks.get(self.token_bytes[a] + self.token_bytes[b], int(NONE))
            return merged[a, b]

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(r, ids[after[i]])) != NONE:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := rank(ids[before[i]], r)) != NONE:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    # -- texts ------------------------------------------------------------------------------------------------

    _odd_space = regex.compile(r"\s |^ ?\Z| \s| \Z")

    def chunks(self, text: str) -> list[str]:
        """Stretches of the text that may be encoded one by one.

        A single space between characters that are not white space always begins a match of the published pattern: the matches
        that may hold a space hold it in front or within white space. A text whose spaces are all such is cut
        there, so that most chunks are words; any other text, and any text by another pattern, is cut into the pattern's matches at once.
        """
        if not self.space_led or self._odd_space.search(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def matches(self, text: str) -> list[str]:
        """The pattern's matches; what it does not match is left out, as the library does."""
        return [m[0] for m in self.pattern.finditer(text)]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Token ids of whole texts, as int32 arrays, in their order; null texts count as empty.

        Texts are taken in groups of about ``GROUP_CHARS`` characters, so that what is new in a group goes through the matrices together.
        """
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self.chunks(t) if t else [] for t in texts]
        missing = set().union(*cut).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known, missing = {}, set().union(*cut)
        if missing:
            self._learn(missing)
        for chunks in cut:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32)

    def _learn(self, chunks: set[str]) -> None:
        whole, cut = [], {}
        for c in chunks:
            # a space and letters are one match of the published pattern; below U+0590 all versions of Unicode agree on letters
            word = c[1:] if c[0] == " " else c
            if self.space_led and word.isalpha() and (word.isascii() or max(word) < "\u0590"):
                whole.append(c)
            else:
                cut[c] = [p.encode("utf-8", "surrogatepass") for p in self.matches(c)]
        self.known.update(zip(whole, self.encode_pieces([c.encode("utf-8", "surrogatepass") for c in whole]), strict=True))
        different = list({p for own in cut.values() for p in own})
        ids = dict(zip(different, self.encode_pieces(different), strict=True))
        for c, own in cut.items():
            self.known[c] = ids[own[0]] if len(own) == 1 else b"".join(map(ids.__getitem__, own))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        out = []
        for at in range(0, len(ids), 1 << 18):  # bounded memory for very long texts
            part = ids[at : at + (1 << 18)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            if len(part):
                out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.starts[part] - ends + lengths, lengths)].tobytes())
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """This process's encoder for a rank file."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(rank_file), pattern)
    return _encoders[key]


def load(spark: SparkSession, path: str, pattern: str):  # noqa: ANN201
    """The rank file, read by the driver and broadcast: its size is fixed by the vocabulary (under 1 MB for 50,000)."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encoded(docs: DataFrame, shared, text: str = "text") -> Column:  # noqa: ANN001
    """A column with the token ids (``array<int>``) of whole texts."""

    @F.pandas_udf("array<int>")
    def ids(bodies: pd.Series) -> pd.Series:
        from veilframe.llm.bpe import encoder as get

        return pd.Series(list(get(*shared.value).encode_batch(bodies)), dtype="object")

    return ids(F.col(text))


def decoded(ids: Column, shared) -> Column:  # noqa: ANN001
    """A binary column with the bytes of token ids; null ids give null."""

    @F.pandas_udf("binary")
    def raw(rows: pd.Series) -> pd.Series:
        from veilframe.llm.bpe import encoder as get

        own = get(*shared.value)
        return pd.Series([None if r is None else own.decode(np.asarray(r, np.int64)) for r in rows], dtype="object")

    return raw(ids)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``GROUP_CHARS`` bytes; a longer text is a range by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > GROUP_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _map_texts(docs: DataFrame, shared, text: str, keep: tuple[str, ...], results: str, build) -> DataFrame:  # noqa: ANN001
    """The kept columns and what ``build(encoder, texts, token ids)`` gives, a few megabytes of text at a time.

    Only a slice of an Arrow batch is ever held as Python objects, and its result leaves before the next one is made.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilframe.llm import bpe

        own = bpe.encoder(*shared.value)
        for batch in batches:
            for a, b in bpe._slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                texts = part.column(len(keep)).to_pylist()
                made = build(own, texts, list(own.encode_batch(texts)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made.values()], [*keep, *made])

    chosen = docs.select(*keep, F.col(text).alias("__bpe_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema)
    return chosen.mapInArrow(run, f"{schema}, {results}" if keep else results)


def round_trip(docs: DataFrame, shared, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: ANN001
    """The kept columns with ``n_tokens``, and digests of the ids as little-endian uint32 and of the bytes decoded from them.

    A row for each row. Null and empty texts have no ids and the digests of no bytes. Special tokens' strings are ordinary text. Repeated rows and null ids stay as they are; a very
    long text is one row's work, in time near its length (pieces over ``MATRIX_BYTES`` take a heap). An empty table gives an empty one. Columns that are not kept are not read; kept ones must not be named like a result.
    """

    def build(own: Encoder, texts: list[str | None], ids: list[np.ndarray]) -> dict[str, pa.Array]:
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return {"n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": pa.array([digest(i.astype("<u4").tobytes()) for i in ids], pa.string()), "decoded_sha256": pa.array([digest(own.decode(i)) for i in ids], pa.string())}

    return _map_texts(docs, shared, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", build)


def encode_table(docs: DataFrame, shared, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: ANN001
    """The kept columns with ``ids``, ``n_tokens``, and ``exact``: whether decoding gives the text's bytes back. Null texts count as empty."""

    def build(own: Encoder, texts: list[str | None], ids: list[np.ndarray]) -> dict[str, pa.Array]:
        lengths = [len(i) for i in ids]
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        exact = [own.decode(i) == (t or "").encode("utf-8", "surrogatepass") for t, i in zip(texts, ids, strict=True)]
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), "n_tokens": pa.array(lengths, pa.int64()), "exact": pa.array(exact, pa.bool_())}

    return _map_texts(docs, shared, text, keep, "ids array<int>, n_tokens long, exact boolean", build)
