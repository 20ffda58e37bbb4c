"""Every core query against its SQL on the small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = core.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert len(set(columns)) == len(columns)
    if name not in core.ORACLE_SQL:
        assert got
        return
    found = con.sql(core.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200


def test_proposals_on_texts_with_marks_of_comments(spark, tmp_path):
    """Against the SQL: documents are prose, so what follows ``#`` or ``//`` in them counts."""
    texts = ["# the heading", "see https://host/the", "a // der # the", "/* der */", "#der\nder", "no mark", "##"]
    rows = [(20 * n + s, text, "en", f"src{s}", len(text)) for n, text in enumerate(texts) for s in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(core.ORACLE_SQL["proposal_validation"].replace("FROM documents)", f"FROM '{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    assert len(want) == len(rows) and {r[1] for r in want} >= {"allowlisted", "already mapped"}
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.reason, r.flag)) for r in core.QUERIES["proposal_validation"](spark, str(tmp_path)).collect())
