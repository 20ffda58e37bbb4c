import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import bpe, queries

DATA = open(public_tokenizers.path(queries.TOKENIZER), "rb").read()
OWN = bpe.Encoder(bpe.read_ranks(DATA), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(DATA), special_tokens={})


def encode(text):
    return next(OWN.encode_batch([text])).tolist()


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "é", "ß", "中", "🙂", "1", "23", ".", "!?", "<|endoftext|>", "\x1c", "\x85", " ", " ", "'", "I"]), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_same_ids_as_the_library(text):
    ids = encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decode(np.array(ids, np.int64)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 700, " " * 2000 + "x", "\n" * 900, "." * 1500, "the" * 900, "é" * 600, "0" * 800])
def test_long_pieces(text):
    assert encode(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"[a-z]+ ?|(?:[^a-z])", r"\p{L}+|\p{N}{1,3}|\s+|[^\s\p{L}\p{N}]+"])
def test_other_patterns(pattern):
    own = bpe.Encoder(bpe.read_ranks(DATA), pattern)
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=bpe.read_ranks(DATA), special_tokens={})
    texts = ["the quick brown fox", "a b  c\n d 1234 é", " lead", "trail ", ""]
    assert [x.tolist() for x in own.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_forgetful_worker_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 10)
    small = bpe.Encoder(bpe.read_ranks(DATA), public_tokenizers.PATTERN)
    texts = [f"word{i} other{i % 3} and more" for i in range(30)] + [None, ""]
    assert [x.tolist() for x in small.encode_batch(texts)] == [LIBRARY.encode_ordinary(t or "") for t in texts]


def test_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "no id"), (-3, "long " * 50_000)], "doc_id long, text string")
    every = docs.unionByName(odd)
    shared = bpe.load(spark, public_tokenizers.path(queries.TOKENIZER), public_tokenizers.PATTERN)
    digests = sorted(map(tuple, bpe.round_trip(every, shared, keep=("doc_id", "text")).collect()), key=str)
    table = bpe.encode_table(every, shared, keep=("doc_id", "text"))
    rows = sorted(table.withColumn("back", bpe.decoded(table["ids"], shared)).collect(), key=lambda r: str((r.doc_id, r.text)))
    assert len(rows) == len(digests) == every.count()
    for r, d in zip(rows, sorted(digests, key=lambda d: str(d[:2])), strict=True):
        ids, raw = LIBRARY.encode_ordinary(r.text or ""), (r.text or "").encode()
        assert r.ids == ids and r.n_tokens == len(ids) and r.exact and bytes(r.back) == raw
        assert d == (r.doc_id, r.text, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
    assert [x.ids for x in odd.select(bpe.encoded(odd, shared).alias("ids")).collect()][:2] == [[], []]
    assert queries.op3_byte_bpe(spark, sf_dir).count() == docs.count()
    assert every.limit(0).select(bpe.encoded(every, shared)).count() == 0
