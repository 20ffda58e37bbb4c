import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import queries, simhash


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs):
    """Smallest id reachable of each (id, print)."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in pairs:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [least.get(find(p)) for _, p in pairs]


@given(st.text(alphabet="abC \t\nÉß .", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_every_vector_has_one_home_and_all_codewords_within_four():
    golay = simhash.Golay()
    words = np.arange(1 << 12)
    codewords = (words << 11) ^ golay.syndrome(words << 11)
    assert (golay.syndrome(codewords) == 0).all()
    x = np.random.default_rng(1).integers(0, 1 << 23, 300)
    near, count = golay.near(x)
    distance = np.bitwise_count(codewords[None, :] ^ x[:, None])
    for row, n, d in zip(near, count, distance, strict=True):
        assert sorted(row[:n].tolist()) == np.flatnonzero(d <= 4).tolist()
        assert d[row[0]] == d.min() <= 3


def test_linked_fingerprints_share_a_key(spark):
    """Every way that up to three errors fall on the segments, on random fingerprints; and few others share one."""
    rng, rows = np.random.default_rng(11), []
    for i in range(2500):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        if i % 5:
            cuts = [rng.choice(np.arange(at, at + n), 1)[0] for at, n in simhash.SEGMENTS] if i % 5 == 1 else rng.choice(64, int(rng.integers(0, 4)), replace=False)
            for b in cuts:
                y ^= 1 << int(b)
        else:
            y = int(rng.integers(0, 2**64, dtype=np.uint64))
        words = simhash.codewords(np.array([x, y], np.uint64))
        rows.append((i, *(v - (v >> 63 << 64) for v in (x, y)), *([w.tolist() for w in own] for own in words)))
    frame = spark.createDataFrame(rows, "i int, x long, y long, nx array<array<int>>, ny array<array<int>>")
    shares = lambda a, na, b, nb: F.arrays_overlap(simhash.keys(F.col(a), F.col(na), True), simhash.keys(F.col(b), F.col(nb), False))
    got = frame.select("i", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("d"), F.size(simhash.keys(F.col("x"), F.col("nx"), True)).alias("n"), shares("x", "nx", "y", "ny").alias("one"), shares("y", "ny", "x", "nx").alias("other")).collect()
    assert all(r.n == 7 for r in got)
    assert all(r.one and r.other for r in got if r.d <= 3) and sum(r.d == 3 for r in got) > 800
    assert not any(r.one or r.other for r in got if r.d > 8)


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    prints = [int(v) for v in rng.integers(0, 2**63, 40)]
    for p in prints[:10]:  # chains, stars and repeats
        q = p
        for step in range(6):
            for b in rng.choice(64, 1 + step % 3, replace=False).tolist():
                q ^= 1 << b
            prints.append(q)
    prints += prints[:15] + [0, 0, 1, 7, 2**64 - 1]
    pairs = [(i * 3 % 101 + 5 if i % 9 else None, p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame([(d, p - (p >> 63 << 64)) for d, p in pairs], "doc_id long, fp long")
    classes = {r.fp % 2**64: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert [classes[p] for _, p in pairs] == brute(pairs)


def test_rows_of_all_sorts(spark):
    base = " ".join(f"word{i}" for i in range(80))
    texts = [base, base, base + " more", None, "", " \n\t", "one", "one", "two words", base.upper(), "x " * 30_000]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)] + [(0, base, "a", 1), (None, "alone in the world", "b", 2)], "doc_id long, text string, fp string, component_id int")
    got = simhash.simhash_groups(docs).collect()
    pairs = [(r.doc_id, r.fp % 2**64) for r in got]
    assert [r.component_id for r in got] == brute(pairs)
    assert sorted(p for _, p in pairs) == sorted(plain_print(r.text) for r in docs.collect())
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({r.component_id for r in got}) and {r.doc_id for r in rows} == {r.component_id for r in got}
    nobody = spark.createDataFrame([(None, base), (None, base + " end"), (None, base)], "doc_id long, text string")
    linked = (plain_print(base) ^ plain_print(base + " end")).bit_count() <= 3
    assert simhash.keep_first(nobody).count() == (1 if linked else 2)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    got = queries.op6_simhash_golay(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pairs = [(r.doc_id, int(r.fingerprint, 16)) for r in got]
    assert all(p == plain_print(text[d]) for d, p in pairs) and len(pairs) == len(text)
    assert [r.component_id for r in got] == brute(pairs)
