"""The workspace operators on small inputs of all sorts."""

import random
import re
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import matcher as M
from veilframe.functions import text as T
from veilframe.operators import aliasing, chunks, diffs, graph, incremental, indexing, patching, paths, policy, render, review, search, symbols, transactions, vectors, verify
from veilframe.sources import corpus, scratch
from veilframe.streaming import redact

TERMS = [M.Term("Northwind", "northwind", "PlainDock", "dictionary"), M.Term("zephyr", "zephyr", "sym_01", "denylist")]
PLAN = M.Matcher(TERMS)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


# -- corpus -----------------------------------------------------------------------------------------------------------


def test_hidden_files_skipped_directories_and_ignore_files(spark, tmp_path):
    """Against the version control program's own verdicts."""
    root = tmp_path / "in"
    rules = {"": "*.log\n!keep.log\nbuild/\n/only_here.txt\ndocs/**/draft?.md\n# no rule\n[ab].tmp\n\\#odd\n", "src": "local.*\n!local.rs\n"}
    names = ["a.log", "keep.log", "src/b.log", "build/x.txt", "src/build/y.txt", "only_here.txt", "src/only_here.txt", "docs/draft1.md", "docs/x/y/draft2.md", "docs/final.md", "a.tmp", "c.tmp", "#odd", "src/local.rs", "src/local.py", "local.py", ".env.d/q", "_hidden", ".dot", "node_modules/p.js", "src/target/z.o", "src/m.rs", "builder"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    for folder, text in rules.items():
        (root / folder / ".gitignore").write_text(text)
    found = corpus.read_ignore_rules(spark, str(root))
    listed = {r.path for r in corpus.discover(spark, str(root), rules=found).collect()}
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    said = subprocess.run(["git", "-C", str(root), "check-ignore", "--no-index", "--stdin"], input="\n".join(names), capture_output=True, text=True).stdout.split("\n")
    expected = {n for n in names if n not in said and not set(n.split("/")[:-1]) & set(corpus.SKIPPED_DIRECTORIES)}
    assert listed - {".gitignore", "src/.gitignore"} == expected
    assert {".dot", "_hidden", ".env.d/q"} <= listed
    assert not {r.path for r in corpus.discover(spark, str(root), hidden=False).collect()} & {".dot", "_hidden", ".env.d/q"}
    read = {r.path: r.text for r in corpus.read_corpus(spark, str(root), rules=found).collect()}
    assert read.keys() == {n for n in expected if not n.startswith((".", "_"))} and read["src/m.rs"] == "src/m.rs"


def test_snapshots_by_expected_version(spark, tmp_path):
    root = str(tmp_path / "s")
    assert corpus.current_version(spark, root) is None
    assert corpus.write_if_changed(spark.range(5), root) and not corpus.write_if_changed(spark.range(5).repartition(3), root)
    assert corpus.write_if_changed(spark.range(6), root) and corpus.current_version(spark, root) == 1
    with pytest.raises(corpus.VersionConflict):
        corpus.write_snapshot(spark.range(1), root, 2, expected=0)
    corpus.write_snapshot(spark.range(7), root, 2, expected=1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        corpus.write_snapshot(spark.range(9), root, 2)
    assert corpus.read_snapshot(spark, root).count() == 7


def test_scratch_tables_go_with_their_space(spark):
    with scratch.scratch_space(spark) as outer:
        kept = scratch.materialize(spark.range(3), "outer")
        with scratch.scratch_space(spark) as made:
            inner = scratch.materialize(spark.range(4), "inner")
            saved = scratch.materialize(spark.range(5), "saved")
            made.remove(next(p for p in made if "/saved-" in p))
            where = [scratch.written_by(x) for x in (kept, inner, saved)]
        assert saved.count() == 5 and kept.count() == 3
        with pytest.raises(Exception, match="(?i)not.*exist"):
            inner.count()
        assert len(outer) == 3 and all(len(w) == 1 for w in where)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        saved.count()


# -- index ------------------------------------------------------------------------------------------------------------


def test_index_passes_read_and_render_only_what_they_must(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('Northwind ', id) AS text")
    listing = docs.selectExpr("doc_id", "10L AS mtime", "CAST(octet_length(text) AS long) AS length")
    asked = []

    def reader(texts):
        def read(due):
            asked.append(due.count())
            return texts.join(due, "doc_id", "left_semi")

        return read

    first = indexing.index_workspace(indexing.empty_state(listing), listing, reader(docs), TERMS)
    state = spark.createDataFrame(first.state.collect(), first.state.schema)
    counts = lambda p: {r.outcome: r.n for r in p.counts().collect()}
    assert counts(first) == {"new": 60}
    assert counts(indexing.index_workspace(state, listing, reader(docs), TERMS)) == {"unchanged": 60}
    later = listing.withColumn("mtime", F.when(F.col("doc_id") < 7, 11).otherwise(F.when(F.col("doc_id") == 9, 0).otherwise(10)).cast("long"))
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 3, "zephyr").when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("text")))
    second = indexing.index_workspace(state, later.where("doc_id <> 50"), reader(edited), TERMS)
    assert counts(second) == {"unchanged": 51, "touched": 6, "changed": 1, "unreadable": 1, "removed": 1}
    rows = {r.doc_id: r for r in second.state.collect()}
    assert len(rows) == 59 and rows[3].rendered == "sym_01" and rows[4].rendered == "PlainDock 4" and rows[5].mtime == 11 and rows[4].mtime == 10
    assert counts(indexing.index_workspace(state, listing, reader(docs), TERMS, salt="other")) == {"changed": 60}
    assert asked == [60, 0, 8, 60]
    gone = indexing.index_workspace(state, listing.limit(0), reader(docs), TERMS)
    assert counts(gone) == {"removed": 60} and gone.state.count() == 0
    assert indexing.is_current(state, listing, TERMS).first().current and not indexing.is_current(state, listing, TERMS, "other").first().current


def test_protected_names_by_set_and_by_join(spark, monkeypatch):
    docs = frame(spark, "doc_id long, text string", (1, "Northwind northwindX zephyr"), (2, None), (2, "northwindX"), (None, ""))
    names = frame(spark, "name string", ("northwindX",), ("zephyr",), ("unused",))
    expected = [r.map.rendered if r.map else None for r in render.render(docs, TERMS, protected=frozenset({"northwindX", "zephyr"})).orderBy("doc_id", "text").collect()]
    assert expected == ["", "PlainDock northwindX zephyr", None, "northwindX"] or None in expected
    few = [r.map.rendered if r.map else None for r in render.render(docs, TERMS, protected=names).orderBy("doc_id", "text").collect()]
    monkeypatch.setattr(render, "SHIELD_ROWS", 1)
    many = render.render(docs, TERMS, protected=names)
    assert few == expected == [r.map.rendered if r.map else None for r in many.orderBy("doc_id", "text").collect()] and many.columns == ["doc_id", "text", "map"]


def test_placed_renders_and_their_faults(spark):
    docs = frame(spark, "doc_id long, text string", (1, "héllo world"), (2, "abc"), (3, None), (4, "plain"))
    given = frame(spark, "doc_id long, start long, end long, replacement string, policy_source string", (1, 7, 12, "you", "a"), (1, 0, 6, "Hi", "b"), (2, 0, 2, "x", "a"), (2, 1, 3, "y", "a"))
    made = {r.doc_id: r.map for r in render.render_placed(docs, given).collect()}
    assert made[1].rendered == "Hi you" and [r.policy_source for r in made[1].replacements] == ["b", "a"] and made[2] is None and made[3] is None and made[4].rendered == "plain"
    cut = frame(spark, given.schema, (1, 2, 3, "x", "a"), (1, 5, 99, "x", "a"), (2, 0, 1, "a\nb", "a"))
    assert {(r.doc_id, r.fault) for r in render.placement_faults(docs, cut).collect()} == {(1, "no whole characters"), (1, "out of bounds"), (2, "line end")}


# -- patches ------------------------------------------------------------------------------------------------------------


def planned(text, edited, language="text"):
    shown, replacements, spans = PLAN.render(text, language)
    hunks = diffs.parse_patch(diffs.make_patch(shown, edited, "f"))[0]["hunks"]
    return patching.plan_modify(text, shown, spans, replacements, hunks, tuple(TERMS), language)


def test_plans_of_changes():
    assert planned("a\nNorthwind x\nb\n", "a\nPlainDock x\nuse PlainDock and sym_01\nb\n")[0] == "a\nNorthwind x\nuse Northwind and zephyr\nb\n"
    assert planned("Northwind x\nb\n", "PlainDock xy\nb\n")[0] == "Northwind xy\nb\n"
    assert planned("Northwind x\nb\n", "b\n")[0] == "b\n"  # a line goes with its replacement
    for text, edited, language, reason in (
        ("Northwind x\n", "PlainDocc x\n", "text", "touch a replacement"),
        ("a\n", "a\ndef PlainDock():\n", "text", "declared anew"),
        ("a\n", "a\nNorthwind\n", "text", "does not give the patched"),
        ("a\n", 'a\nx = "PlainDock"\n', "python", "would hold"),
        ("a\n", "a\n# PlainDock\n", "python", "would hold"),
    ):
        with pytest.raises(diffs.BadPatch, match=reason):
            planned(text, edited, language)
    several = [*TERMS, M.Term("southwind", "southwind", "Plain_Dock", "dictionary")]
    back, originals = patching.reverse_terms(several)
    with pytest.raises(diffs.BadPatch, match="several terms"):
        patching.turn_back(b"PlainDock", 0, b"PlainDock", "text", M.Matcher(list(back)), M.Matcher(several), originals)


lines = st.lists(st.lists(st.sampled_from(["Northwind", "zephyr", "alpha", "ZEPHYR_1", "north", "é", "call(Northwind)", ""]), max_size=4).map(" ".join), min_size=1, max_size=8)


@given(lines, st.booleans(), st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["add", "cut", "tail"]), st.sampled_from(["plain", "use PlainDock here", "sym_01 = 3", "x"])), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_what_is_planned_renders_as_patched(rows, ended, changes):
    text = "\n".join(rows) + "\n" * ended
    new = PLAN.replace(text).split("\n")
    for at, what, word in changes:
        k = at % len(new)
        if what == "add":
            new.insert(k, word)
        elif what == "cut" and len(new) > 1:
            new.pop(k)
        else:
            new[k] += f" {word}"
    edited = "\n".join(new)
    if not diffs.make_patch(PLAN.replace(text), edited, "f"):
        return
    try:
        after, shown = planned(text, edited)
    except diffs.BadPatch:
        return
    assert PLAN.replace(after) == shown and shown.rstrip("\n") == edited.rstrip("\n")


def workspace(spark):
    docs = frame(spark, "doc_id long, path string, projected string, text string", (1, "a/Northwind.txt", "a/PlainDock.txt", "one Northwind\ntwo\n"), (2, "b.txt", "b.txt", "x\n"), (3, "c.txt", "c.txt", "drift\n"))
    listing = docs.selectExpr("doc_id", "1L AS mtime", "CAST(octet_length(text) AS long) AS length")
    state = indexing.index_workspace(indexing.empty_state(listing), listing, lambda due: docs.join(due, "doc_id", "left_semi"), TERMS).state
    joined = docs.join(state.select("doc_id", "rendered", "input_hash", "rendered_hash", "map"), "doc_id")
    return joined.withColumn("text", F.when(F.col("doc_id") == 3, "drifted\n").otherwise(F.col("text")))


def test_plan_commit_and_recover(spark, tmp_path):
    tracked = workspace(spark)
    patches = frame(
        spark,
        "patch string",
        ("--- a/a/PlainDock.txt\n+++ b/a/PlainDock.txt\n@@ -1,2 +1,3 @@\n one PlainDock\n two\n+three sym_01\n",),
        ("--- a/b.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n",),
        ("--- /dev/null\n+++ b/new.txt\n@@ -0,0 +1 @@\n+PlainDock\n",),
        ("--- a/c.txt\n+++ b/c.txt\n@@ -1 +1 @@\n-drift\n+x\n",),
        ("--- /dev/null\n+++ b/b.txt\n@@ -0,0 +1 @@\n+again\n",),
        ("--- a/none.txt\n+++ b/none.txt\n@@ -1 +1 @@\n-a\n+b\n",),
        ("no patch at all\n--- a/x\nbroken",),
    )
    plan = patching.plan_patches(patches, tracked, TERMS).cache()
    rows = {(r.projected, r.op): r for r in plan.collect()}
    good = {k: r.after for k, r in rows.items() if r.status == "planned"}
    assert good == {("a/PlainDock.txt", "modify"): "one Northwind\ntwo\nthree zephyr\n", ("b.txt", "delete"): None, ("new.txt", "create"): "Northwind\n"}
    assert "changed since" in rows["c.txt", "modify"].reason and "exists" in rows["b.txt", "create"].reason and "not tracked" in rows["none.txt", "modify"].reason and rows[None, None].reason
    docs = tracked.select("path", "text")
    assert patching.commit_plan(docs, plan).collect() == docs.collect()
    fine = plan.where("status = 'planned'")
    after = {r.path: r.text for r in patching.commit_plan(docs, fine).collect()}
    assert after == {"a/Northwind.txt": "one Northwind\ntwo\nthree zephyr\n", "c.txt": "drifted\n", "new.txt": "Northwind\n"}
    root = str(tmp_path / "journal")
    patching.append_journal(patching.journal_entry(fine, "e1", 1), root)
    journal = spark.read.parquet(root)
    assert journal.count() == 3
    # interrupted after the deletion and the creation
    half = frame(spark, "path string, text string", ("a/Northwind.txt", "one Northwind\ntwo\n"), ("c.txt", "drifted\n"), ("new.txt", "Northwind\n"))
    back, ended = patching.recover(half, journal, 2)
    assert {r.path: r.text for r in back.collect()} == {r.path: r.text for r in docs.collect()}
    assert [(r.id, r.status) for r in ended.collect()] == [("e1", "rolled-back")]
    patching.append_journal(ended, root)
    again = patching.recover(half, spark.read.parquet(root), 3)
    assert again[1].count() == 0 and {r.path for r in again[0].collect()} == {"a/Northwind.txt", "c.txt", "new.txt"}
    assert {r.path: r["count"] for r in patching.rename_word(tracked, "b.txt", "x", "y").collect()} == {"b.txt": 1}
    handed = frame(spark, "projected string, rendered_after string", ("b.txt", "x\nPlainDock\n"))
    assert [r.after for r in patching.plan_render(tracked, handed, TERMS).collect()] == ["x\nNorthwind\n"]


def test_transactions_by_revision(spark):
    docs = frame(spark, "doc_id long, text string", (1, "abc"), (2, "xyz"))
    edits = frame(spark, "doc_id long, start long, end long, replacement string", (1, 0, 1, "A"))
    control, ledger = frame(spark, "revision long", (4,)), frame(spark, "id string, status string, base_revision long, committed_revision long")
    seen = transactions.preview(docs, edits)
    with pytest.raises(transactions.StaleRevision):
        transactions.commit_transaction(docs, control, ledger, seen, "t", 3)
    with pytest.raises(transactions.StaleRevision):
        transactions.commit_transaction(docs.withColumn("text", F.lit("other")), control, ledger, seen, "t", 4)
    after, moved, entries = transactions.commit_transaction(docs, control, ledger, seen, "t", 4)
    assert {r.text for r in after.collect()} == {"Abc", "xyz"} and moved.first().revision == 5 and entries.first().committed_revision == 5
    assert transactions.commit_transaction(after, moved, entries, seen, "t", 4)[0] is after
    clash = transactions.preview(docs, edits.union(frame(spark, edits.schema, (1, 0, 2, "B"))))
    same, still, noted = transactions.commit_transaction(docs, control, ledger, clash, "u", 4)
    assert same is docs and still.first().revision == 4 and noted.first().status == "conflict"
    journal = frame(spark, "id string, at long, status string", *((f"e{i}", 1, "applied" if i % 3 else "applying") for i in range(9)))
    assert {r.id for r in transactions.prune(journal, 2).collect()} == {"e0", "e3", "e6", "e7", "e8"} and {r.id for r in transactions.in_flight(journal).collect()} == {"e0", "e3", "e6"}
    assert transactions.require_revision(1, 1) == 2
    nodes = frame(spark, "node_id string, doc_id long, start long, end long", ("n", 1, 1, 2))
    places = frame(spark, "symbol_id string, doc_id long, start long, end long", ("s", 2, 0, 1), ("s", 1, 2, 3))
    intents = frame(spark, "kind string, node_id string, symbol_id string, text string", ("replace", "n", None, "Q"), ("insert-after", "n", None, "+"), ("insert-before", "n", None, "-"), ("rename", None, "s", "z"))
    assert {tuple(r) for r in transactions.intent_ranges(intents, nodes, places).collect()} == {(1, 1, 2, "Q"), (1, 2, 2, "+"), (1, 1, 1, "-"), (2, 0, 1, "z"), (1, 2, 3, "z")}


# -- symbols ------------------------------------------------------------------------------------------------------------


def test_resolution_by_kind_qualifier_arity_and_types(spark):
    decl = "doc_id long, symbol_id string, name string, scope array<long>, at long, kind string, labels array<string>, owner_type string, min_arity int, max_arity int, parameter_types array<string>"
    declarations = frame(
        spark,
        decl,
        (1, "f0", "f", [], 1, "function", ["ns"], None, 0, 0, []),
        (1, "f1i", "f", [], 2, "function", ["ns"], None, 1, 1, ["int"]),
        (1, "f1s", "f", [], 3, "function", ["ns"], None, 1, 1, ["str"]),
        (1, "fv", "f", [], 4, "value", [], None, None, None, None),
        (1, "inner", "f", [7], 5, "function", ["ns", "c"], None, 0, None, None),
        (1, "m1", "go", [8], 6, "method", ["A"], "A", 0, 0, None),
        (1, "m2", "go", [9], 7, "method", ["B"], "B", 0, 0, None),
        (2, "far", "f", [], 1, "function", [], None, 0, None, None),
    )
    ref = "doc_id long, ref_id string, name string, scope array<long>, at long, kinds array<string>, qualifier array<string>, enclosing_type string, receiver_type string, arity int, argument_types array<string>"
    none = (None,) * 6
    references = frame(
        spark,
        ref,
        (1, "plain", "f", [], 50, *none),
        (1, "kind", "f", [], 50, ["value"], None, None, None, None, None),
        (1, "arity0", "f", [], 50, ["function"], None, None, None, 0, None),
        (1, "typed", "f", [], 50, ["function"], None, None, None, 1, ["str"]),
        (1, "untyped", "f", [], 2, ["function"], None, None, None, 1, ["float"]),
        (1, "deep", "f", [7, 1], 50, *none),
        (1, "no arity fits", "f", [7, 1], 50, ["function"], None, None, None, 9, None),
        (1, "qualified", "f", [], 50, None, ["c"], None, None, None, None),
        (1, "long qualifier", "f", [], 50, None, ["a", "b", "ns"], None, None, None, None),
        (1, "member", "go", [], 50, None, None, None, "B", 0, None),
        (1, "own", "go", [], 50, None, None, "A", None, None, None),
        (1, "hidden", "go", [], 50, *none),
        (1, "unknown", "nothing", [], 50, *none),
        (3, "elsewhere", "f", [], 50, *none),
    )
    got = {r.ref_id: r.symbol_id if r.role == "bound" else r.role for r in symbols.resolve(references, declarations).collect()}
    assert got == {"plain": "fv", "kind": "fv", "arity0": "f0", "typed": "f1s", "untyped": "f1i", "deep": "inner", "no arity fits": "inner", "qualified": "inner", "long qualifier": "external", "member": "m2", "own": "m1", "hidden": "external", "unknown": "external", "elsewhere": "external"}
    twice = frame(spark, "doc_id long, symbol_id string, name string, scope array<long>, at long", (1, "a", "f", [], 9), (1, "b", "f", [], 9))
    assert symbols.resolve(frame(spark, "doc_id long, ref_id string, name string, scope array<long>, at long", (1, "r", "f", [], 10)), twice).first().role == "unresolved"


def test_alias_upkeep(spark):
    known = frame(spark, "symbol_id string, doc_id long, node_id string, name string, origin string", *((f"s{i}", i // 2, f"n{i}", f"name{i}", "owned") for i in range(6)))
    links = frame(spark, "canonical string, linked string", ("s0", "s1"), ("s1", "s2"))
    assert {(r.symbol_id, r.other_id) for r in aliasing.equivalents(links, known.where("symbol_id IN ('s0', 's5')")).collect()} == {("s0", "s0"), ("s0", "s1"), ("s0", "s2"), ("s5", "s5")}
    aliases = frame(spark, "symbol_id string, original string, alias string, status string, source string, confidence double, revision long", ("s4", "name4", "kept", "accepted", "review", 1.0, 1))
    lexical = frame(spark, "original_text string, sanitized_text string", ("z", "lex"))
    asked = frame(spark, "symbol_id string, alias string, source string, confidence double", ("s0", "fresh", "review", 0.9), ("s5", "fresh", "review", 0.95), ("s3", "KEPT", "review", 1.0), ("s4", "lex", "review", 1.0))
    after, judged = aliasing.accept_aliases(asked, known, aliases, links, lexical, 2)
    assert {(r.symbol_id, r.alias) for r in after.collect()} == {("s4", "kept"), ("s5", "fresh")}
    reasons = {r.symbol_id: r.reason for r in judged.collect()}
    assert reasons["s5"] is None and "better" in reasons["s0"] and "another original" in reasons["s3"] and reasons["s4"]
    spread, _ = aliasing.accept_aliases(asked.where("symbol_id = 's0'"), known, aliases, links, lexical, 2)
    assert {r.symbol_id for r in spread.where("alias = 'fresh'").collect()} == {"s0", "s1", "s2"}
    shared = frame(spark, "symbol_id string, alias string, original string, source string, confidence double, revision long, status string", ("a", "X", "one", "policy", 0.1, 9, "accepted"), ("b", "x", "two", "review", 0.9, 1, "accepted"), ("c", "y", "one", "review", 0.5, 1, "accepted"))
    assert {r.symbol_id: r.winner for r in review.quarantine(shared).collect()} == {"a": True, "b": False, "c": True}
    assert [(r.alias_norm, r.n) for r in symbols.alias_conflicts(shared).collect()] == [("x", 2)]
    ids = frame(spark, "a string, b string", ("p", "q")).select(symbols.stable_id("sym", "a", "b").alias("i")).first().i
    assert re.fullmatch("sym_[0-9a-f]{16}", ids)
    control = frame(spark, "revision long", (3,))
    moved, tables = aliasing.replace_documents(control, {"symbols": known}, {"symbols": known.where("symbol_id = 's0'")}, frame(spark, "doc_id long", (0,), (1,)), 3)
    assert moved.first().revision == 4 and {r.symbol_id for r in tables["symbols"].collect()} == {"s0", "s4", "s5"}
    with pytest.raises(transactions.StaleRevision):
        aliasing.replace_documents(control, {}, {}, frame(spark, "doc_id long"), 2)


def test_stale_bindings_cascade(spark):
    documents = frame(spark, "doc_id long, content_hash string", (1, "h1"), (2, "new"))
    bindings = frame(spark, "symbol_id string, doc_id long, start long, end long, name string, content_hash string", ("a", 1, 0, 1, "x", "h1"), ("a2", 2, 5, 6, "y", "h2"), ("b", 1, 3, 4, "z", "h1"))
    assert {r.symbol_id for r in symbols.stale_groups(bindings, documents).collect()} == {"a2"}
    links = frame(spark, "canonical string, linked string", ("a", "a2"))
    occurrences = frame(spark, "doc_id long, start long, end long, name string, symbol_id string, role string", (1, 0, 1, "x", "a", "reference"), (1, 3, 4, "z", None, "unresolved"), (2, 5, 6, "y", "a2", "reference"), (1, 8, 9, "w", "d", "declaration"))
    aliases = frame(spark, "symbol_id string, status string", ("a", "accepted"), ("b", "accepted"), ("a2", "stale"))
    done = aliasing.reapply_bindings(occurrences, bindings, links, documents, aliases, aliases.withColumn("status", F.lit("open")))
    assert {(r.start, r.symbol_id, r.role) for r in done["occurrences"].collect()} == {(0, None, "unresolved"), (3, "b", "reference"), (5, None, "unresolved"), (8, "d", "declaration")}
    assert {(r.symbol_id, r.status) for r in done["aliases"].collect()} == {("a", "stale"), ("a2", "stale"), ("b", "accepted")}
    assert {(r.symbol_id, r.status) for r in done["proposals"].collect()} == {("a", "stale"), ("a2", "stale"), ("b", "open")}
    assert done["links"].count() == 0 and [r.symbol_id for r in done["bindings"].collect()] == ["b"]


def test_symbol_index_checks(spark):
    documents = frame(spark, "doc_id long", (1,))
    nodes = frame(spark, "node_id string, parent_id string, doc_id long, start long, end long", ("n1", None, 1, 0, 9), ("n2", "n1", 1, 1, 2))
    known = frame(spark, "symbol_id string, doc_id long, node_id string", ("s1", 1, "n2"))
    uses = frame(spark, "doc_id long, start long, end long, node_id string, symbol_id string, role string", (1, 1, 2, "n2", "s1", "declaration"))
    aliases = frame(spark, "symbol_id string, original string, alias string, status string", ("s1", "one", "x", "accepted"))
    assert verify.verify_symbols(known, uses, nodes, documents, aliases).count() == 0
    bad_nodes = nodes.union(frame(spark, nodes.schema, ("n2", "gone", 2, 8, 12), ("n3", "n1", 1, 5, 99)))
    bad_uses = uses.union(frame(spark, uses.schema, (1, 4, 3, "n9", "s9", "reference"), (1, 6, 7, "n2", "s1", "unresolved")))
    bad_aliases = aliases.union(frame(spark, aliases.schema, ("s8", "two", "X", "accepted")))
    found = {(r.check, r.key) for r in verify.verify_symbols(known.union(frame(spark, known.schema, ("s2", 3, "n7"))), bad_uses, bad_nodes, documents, bad_aliases).collect()}
    assert found >= {("duplicate key", "n2"), ("without document", "n2"), ("without document", "s2"), ("without parent", "n2"), ("without node", "s2"), ("without node", "1:4:3"), ("without symbol", "1:4:3"), ("without symbol", "s8"), ("role", "1:6:7"), ("undeclared", "s2"), ("range", "1:4:3"), ("outside its parent", "n3"), ("shared alias", "x")}


def test_reach_in_graphs(spark):
    chain = frame(spark, "a long, b long", *((i, i + 1) for i in range(60)), (100, 101))
    assert {r.node for r in graph.component_of(chain, frame(spark, "node long", (30,), (500,))).collect()} == set(range(61)) | {500}
    circle = frame(spark, "a long, b long", (1, 2), (2, 3), (3, 1), (3, 4), (9, 9))
    assert {(r.start, r.node) for r in graph.closures(circle, frame(spark, "node long", (1,), (4,), (9,))).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (9, 9)}
    tree = frame(spark, "node_id long, parent_id long", *((i, i - 1 if i else None) for i in range(90)))
    up = graph.ancestors(tree, tree.where("node_id = 89"))
    assert up.count() == 90 and up.agg(F.max("depth")).first()[0] == 89 and graph.ancestors(tree, tree.where("node_id = 89"), 3).count() == 4
    with pytest.raises(ValueError, match="circle"):
        graph.ancestors(frame(spark, "node_id long, parent_id long", (1, 2), (2, 1)), frame(spark, "node_id long", (1,)))


# -- review, vectors, streams -------------------------------------------------------------------------------------------


def test_comments_do_not_count_as_occurrences(spark):
    docs = frame(spark, "doc_id long, text string, language string", (1, "x = 1  # shadow\n", "python"), (2, "shadow = 1  # shadow\n", "python"), (3, "shadow // x", "rust"))
    offers = frame(spark, "doc_id long, original_text string, sanitized_text string, category string, confidence double", *((i, "shadow", "neutral", "identifier", 0.9) for i in (1, 2, 3)))
    none = frame(spark, "raw string")
    terms = policy.term_table(policy.entries(spark, [("dictionary", "other", "thing")]), "s")
    got = {r.doc_id: r.reason for r in review.validate(offers, docs, terms, none, none.withColumnRenamed("raw", "name")).collect()}
    assert got == {1: "original stands in comments only", 2: None, 3: None}


def test_embedding_waits_and_gives_up(spark):
    chunk = frame(spark, "chunk_id long, chunk string", *((i, f"c{i}") for i in range(3)))

    class Model:
        def __init__(self, fail, error):
            self.fail, self.error, self.calls = fail, error, 0

        def __call__(self, texts):
            self.calls += 1
            if self.calls <= self.fail:
                raise self.error
            return [[float(len(t))] for t in texts]

    assert vectors.embed(chunk.coalesce(1), Model(2, vectors.Busy("busy", 0.01)), wait=lambda s: None).count() == 3
    for model, error in ((Model(3, vectors.Busy()), "busy"), (Model(1, KeyError("bug")), "bug"), (lambda texts: [], "vectors for")):
        with pytest.raises(Exception, match=error):
            vectors.embed(chunk.coalesce(1), model, wait=lambda s: None).collect()
    waits = []
    busy = vectors.Busy("x", 99)
    assert busy.__reduce__()[1] == ("x", 99)
    run = lambda m: vectors.ask(m, ["t"], waits.append)
    assert run(Model(1, vectors.Busy("x", 99))) and waits[-1] == vectors.LONGEST_WAIT and run(Model(2, ConnectionError())) and waits[-2:] == [0.5, 1.0]


def test_numbers_within_hot_groups(spark):
    rows = spark.range(500).selectExpr("id", "IF(id % 10 = 0, CAST(id % 3 AS string), IF(id % 17 = 0, NULL, 'hot')) AS g")
    got = {}
    for r in chunks.numbered(rows, F.col("g"), "id").collect():
        got.setdefault(r.g, []).append((r.id, r.number))
    assert all([n for _, n in sorted(v)] == list(range(len(v))) for v in got.values()) and len(got) == 5
    assert chunks.batches(rows.limit(0), 3, F.col("g"), "id").count() == 0


def test_streamed_index(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()

    def deliver(number, *rows):
        frame(spark, "doc_id long, text string", *rows).coalesce(1).write.parquet(str(tmp_path / f"batch{number}"))
        for part in (tmp_path / f"batch{number}").glob("part-*.parquet"):
            part.rename(source / f"{number}-{part.name}")
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        redact.maintain_index(stream, root, TERMS, str(tmp_path / "cp")).awaitTermination(120)
        return {r.doc_id: r.rendered for r in corpus.read_snapshot(spark, root).collect()}

    assert deliver(0, (1, "Northwind"), (2, "plain")) == {1: "PlainDock", 2: "plain"}
    assert deliver(1, (2, "zephyr"), (3, "new"), (1, None)) == {2: "sym_01", 3: "new"}


def test_new_paths_must_be_neutral(spark):
    projected = paths.project_paths(frame(spark, "path string", ("Northwind/a.txt",)), TERMS)
    asked = frame(spark, "asked string", ("PlainDock/b.txt",), ("PlainDock/zephyr.txt",), ("free/c.txt",))
    assert {r.asked: r.real for r in paths.resolve_new(asked, paths.path_map(projected), terms=TERMS).collect()} == {"PlainDock/b.txt": "Northwind/b.txt", "PlainDock/zephyr.txt": None, "free/c.txt": "free/c.txt"}


def test_random_tables_are_numbered_the_same(spark):
    r = random.Random(2)
    rows = frame(spark, "k long, g string", *((i, r.choice("ab")) for i in range(60)))
    a = {x.k: x.batch for x in chunks.batches(rows, 7, F.col("g"), "k").collect()}
    assert a == {x.k: x.batch for x in chunks.batches(rows.repartition(5), 7, F.col("g"), "k").collect()}


def test_small_operators(spark):
    state = frame(spark, "path string, mtime long, length long", ("a", 1, 5), ("b", 2, 6), ("c", 0, 7))
    listing = frame(spark, "path string, mtime long, length long", ("a", 1, 5), ("b", 2, 9), ("c", 0, 7), ("d", 4, 1))
    assert {r.path for r in incremental.unread(listing, state).collect()} == {"b", "c", "d"}
    moved = incremental.touched(state, frame(spark, "path string, mtime long", ("a", 8), ("z", 1)), "path", ["mtime"])
    assert {(r.path, r.mtime, r.length) for r in moved.collect()} == {("a", 8, 5), ("b", 2, 6), ("c", 0, 7)}
    assert [r.path for r in search.list_documents(listing, "path", "[ad]").collect()] == ["a", "d"] and [r.path for r in search.list_documents(listing, "path").collect()] == ["a", "b", "c", "d"]
    ops = frame(spark, "old_path string, new_path string", ("/dev/null", "b/x"), ("a/x", "/dev/null"), ("a/x", "b/x"))
    assert [r.o for r in ops.select(diffs.file_operation().alias("o")).collect()] == ["create", "delete", "modify"]
    assert incremental.corpus_fingerprint(frame(spark, "doc_id string, fingerprint string", ("x", "1"), ("y", "2"))).count() == 1
    names = frame(spark, "a string, b string", ("readConfigFile", "configFileReader"), ("alpha", "beta"))
    assert [bool(r.x) for r in names.select(T.shares_owner(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]
    settings_ = frame(spark, "name string, value double", ("chunk_lines", float("nan")), ("chunk_overlap", 3.0))
    assert [(r.check, r.raw) for r in policy.setting_violations(settings_).collect()] == [("no number", "chunk_lines")]


def test_uses_meet_their_symbols_up_the_tree(spark):
    """By brute force over a deep tree whose uses and symbols share few names: no scratch table grows with pairs of them."""
    draw = random.Random(5)
    parent = {n: None if n % 100 == 0 else draw.choice((n - 1, n - 1, max(n - 3, n // 100 * 100))) for n in range(600)}
    known = [(n, n // 100 % 2, draw.choice("ab")) for n in range(600) if n % 3]
    used = [(draw.randrange(2), draw.randrange(600), draw.choice("abc"), draw.choice(("unresolved", "reference"))) for _ in range(400)] + [(0, None, "a", "unresolved"), (0, 5000, "a", "unresolved")]
    tops = [(n, n - n % 25) for n, _, _ in known if n % 7]
    below = set()
    for doc, node, name, role in used:
        while node is not None and role == "unresolved":
            below.add((doc, name, node))
            node = parent.get(node)
    top = dict(tops)
    expected = {n: n in top and (doc, name, top[n]) not in below for n, doc, name in known}
    assert set(expected.values()) == {True, False} and {True, False} <= {expected[n] for n in top}
    known = frame(spark, "symbol_id long, doc_id int, name string", *known)
    nodes, uses = frame(spark, "node_id long, parent_id long", *parent.items()), frame(spark, "doc_id int, node_id long, name string, role string", *used)
    none = frame(spark, "symbol_id long")
    with scratch.scratch_space(spark) as made:
        got = aliasing.complete_symbols(known, uses, nodes, frame(spark, "symbol_id long, node_id long", *tops), none, frame(spark, "canonical long, linked long"), none)
        assert {r.symbol_id: r.complete for r in got.collect()} == expected
        assert max(spark.read.parquet(p).count() for p in made) < 3_000 and len(made) < 30
    with pytest.raises(ValueError, match="circle"):
        graph.reached_above(frame(spark, "node_id long, parent_id long", (1, 2), (2, 1)), frame(spark, "node_id long, name string", (1, "a")))


def test_prose_has_no_comments(spark):
    docs = frame(spark, "doc_id long, text string, language string", *((i, "x # shadow", language) for i, language in enumerate(("plaintext", "markdown", "text", None, "python"))))
    offers = docs.select("doc_id", F.lit("shadow").alias("original_text"), F.lit("neutral").alias("sanitized_text"), F.lit("identifier").alias("category"), F.lit(0.9).alias("confidence"))
    none = frame(spark, "raw string")
    terms = policy.term_table(policy.entries(spark, [("dictionary", "other", "thing")]), "s")
    got = {r.doc_id: r.reason for r in review.validate(offers, docs, terms, none, none.withColumnRenamed("raw", "name")).collect()}
    assert got == {0: None, 1: None} | dict.fromkeys((2, 3, 4), "original stands in comments only")
