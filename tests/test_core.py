"""Properties of the core operators on small inputs of all sorts."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import matcher as M
from veilframe.functions import text as T
from veilframe.operators import chunks, diffs, graph, incremental, paths, policy, render, review, search, symbols, vectors, verify
from veilframe.sources import corpus
from veilframe.streaming import redact

TERMS = [M.Term(*t) for t in (("HarborMill", "harbormill", "PlainDock", "dictionary"), ("wrenlocke", "wrenlocke", "sym_01", "denylist"), ("aa", "aa", "b_b", "dictionary"), ("ba", "ba", "q", "dictionary"))]


def test_matcher_cases():
    m = M.Matcher(TERMS[:2])
    for a, b in {"HarborMill": "PlainDock", "HARBOR_MILL": "PLAINDOCK", "harborMillFactory": "PlainDockFactory", "harbormill": "plaindock", "x_Harbor_mill9": "x_PlainDock9", "Wrenlocke!": "Sym_01!", "wren locke": "wren locke", "é_harbormill_é": "é_plaindock_é"}.items():
        assert m.replace(a) == b, a
    assert M.Matcher([M.Term("self", "self", "own", "d")], frozenset({"myself"})).replace("self myself yourself") == "self myself yourown"
    assert M.Matcher([M.Term("self", "self", "own", "d")], exempt=False).replace("self") == "own"
    # each term is searched by itself first, so the second "aa" is lost to the overlap
    assert M.Matcher(TERMS).replace("baaa") == "qaa"


words = st.lists(st.sampled_from(["Harbor_Mill", "HARBORMILL", "wren", "locke", "_", "é", "\n", " ", "aa", "ba", "b", "9", "🙂", "//", '"', "'", "#", "/*", "*/"]), max_size=30).map("".join)


@given(words, st.sampled_from(["text", "python", "go", "c", "markdown", "rust"]))
@settings(max_examples=400, deadline=None)
def test_render_tiles_and_reverses(text, language):
    out, replacements, spans = M.Matcher(TERMS).render(text, language)
    raw, new = text.encode(), out.encode()
    at = shifted = 0
    back = b""
    for s in spans:
        assert (s["original_start"], s["sanitized_start"]) == (at, shifted)
        assert s["original_line_start"] == 1 + raw[:at].count(b"\n")
        at, shifted = s["original_end"], s["sanitized_end"]
        part = new[s["sanitized_start"] : s["sanitized_end"]]
        back += part if s["replacement_id"] is None else replacements[s["replacement_id"]]["original_text"].encode()
    assert (at, shifted, back) == (len(raw), len(new), raw) and out == M.Matcher(TERMS).replace(text)
    for r in replacements:
        assert raw[r["original_start"] : r["original_end"]].decode() == r["original_text"]


def scan(language, raw):
    """Strings and comments of a text by a plain walk over its bytes."""
    strings, i = [], 0
    quotes = {"rust": '"', "go": '"`', "typescript": "\"'`", "javascript": "\"'`", "json": '"'}.get(language, "\"'")
    while language not in ("markdown", "plaintext", "text") and i < len(raw):
        q = raw[i]
        if q not in quotes:
            i += 1
        elif language == "python" and raw[i : i + 3] == q * 3:
            end = raw.find(q * 3, i + 3)
            strings.append((i + 3, len(raw) if end < 0 else end))
            i = len(raw) if end < 0 else end + 3
        elif language == "go" and q == "`":
            end = raw.find(q, i + 1)
            strings.append((i + 1, len(raw) if end < 0 else end))
            i = (len(raw) if end < 0 else end) + 1
        else:
            j = i + 1
            while j < len(raw) and raw[j] != q and (raw[j] != "\n" or q == "`"):
                j += 1 + (raw[j] == "\\")
            if j < len(raw) and raw[j] == q:
                strings.append((i + 1, j))
                j += 1
            i = max(min(j, len(raw)), i + 1)
    return strings


@given(st.text(alphabet="ab\"'`\\\n#/* ", max_size=40), st.sampled_from(["python", "go", "rust", "javascript", "c", "text", "markdown"]))
@settings(max_examples=600, deadline=None)
def test_string_scanner(text, language):
    assert M.string_ranges(language, text.encode()) == scan(language, text)


def test_comments_and_names():
    code = 'import os  # from shadow\nx = "# no"\nfrom .local import thing\ndef f(): pass\n__all__ = 1\n'
    strings = M.string_ranges("python", code.encode())
    assert [code[a:b] for a, b in M.comment_ranges("python", code.encode(), strings)] == [" from shadow"]
    assert M.protected_names(code, "python") == {"os", "local", "thing", "__all__"}
    assert M.external_names(code, "python") == {"os", "shadow"}
    assert M.protected_names(code, "markdown") == set()
    assert M.masked_comments("a // b\nc", "rust") == "a //  \nc"
    assert M.external_names("#include <vector>\n#include \"own.h\"\nuse crate::x;\nextern int thing;", "c") == {"vector", "int", "thing"}


@given(st.text(alphabet="abé🙂", max_size=12), st.text(alphabet="abé🙂", max_size=12))
@settings(max_examples=300, deadline=None)
def test_changed_range(old, new):
    a, b = M.changed_range(old, new)
    raw, other = old.encode(), new.encode()
    assert 0 <= a <= b <= len(raw)
    assert other.startswith(raw[:a]) and other.endswith(raw[b:]) and len(other) >= a + len(raw) - b


def test_globs():
    table = [("*.rs", "src/a.rs", True), ("*.rs", "a.py", False), ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/x/a.rs", False), ("src/**/*.rs", "src/x/y/a.rs", True), ("src/**/*.rs", "src/a.rs", True), ("[ab]?.{py,rs}", "q/b1.py", True), ("[!a]x", "ax", False), ("**", "any", True), ("a.b", "aXb", False)]
    for pattern, path, expected in table:
        regex, whole = T.glob_regex(pattern)
        assert bool(re.search(regex, path if whole else path.rpartition("/")[2])) == expected, (pattern, path)
    with pytest.raises(ValueError, match="not closed"):
        T.glob_regex("[ab")


def test_text_functions(spark):
    rows = spark.createDataFrame([("a\r\nb\r\n", "HarborHTTPServer2_x", "./a//b/c.rs"), ("", "x", "../a"), ("one", "ABc", "/abs"), ("a\n\n", "", "node_modules/p.ts")], "t string, n string, p string")
    got = rows.select(T.lines(F.col("t")).alias("l"), T.dominant_eol(F.col("t")).alias("e"), T.identifier_tokens(F.col("n")).alias("k"), T.safe_path(F.col("p")).alias("s"), T.origin_of(F.col("p")).alias("o"), T.language_of(F.col("p")).alias("g"), T.is_run(F.col("n")).alias("r")).collect()
    assert [x.l for x in got] == [["a", "b"], [], ["one"], ["a", ""]] and got[0].e == "\r\n"
    assert got[0].k == ["harbor", "http", "server2", "x"] and got[2].k == ["a", "bc"]
    assert [x.s for x in got] == ["a/b/c.rs", None, None, "node_modules/p.ts"] and got[3].o == "dependency" and got[3].g == "typescript"
    assert [x.r for x in got] == [True, True, True, False]


def test_render_frames(spark):
    rows = [(1, "HarborMill and HARBOR_MILL é"), (2, None), (3, ""), (4, "nothing"), (4, "nothing"), (None, "wrenlocke")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = render.render(docs, TERMS)
    assert [tuple(r) for r in made.where("text is not null").select((render.reverse(made) == F.col("text")).alias("x")).distinct().collect()] == [(True,)]
    assert render.tiling_faults(made).count() == 0
    assert {(r.doc_id, r.term) for r in render.leaks(docs, TERMS, "text").collect()} == {(1, "HarborMill"), (None, "wrenlocke")}
    assert render.leaks(made.select("doc_id", "map.rendered"), TERMS[:2], "rendered").count() == 0
    one = made.where("doc_id = 1")
    spots = one.select(*(render.edit_conflicts(one, F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate([(1, 2), (9, 9), (9, 14), (0, 0), (3, 3)]))).first()
    assert list(spots) == [True, False, False, False, True]
    offsets = one.select(render.project_offset(F.lit(10)).alias("a"), render.project_offset(F.lit(3)).alias("b"), render.project_offset(F.lit(3), end=True).alias("c")).first()
    assert list(offsets) == [9, 0, 9]
    known = policy.term_table(policy.entries(spark, [("dictionary", "HarborMill", "PlainDock")]), "s")
    assert verify.verify_renders(made.where("doc_id = 1"), policy.collect_terms(known), known).count() == 0
    assert render.replace_longest(F.col("text"), []) is not None
    pairs = [("ab", "1"), ("abc", "2"), ("c", "3")]
    assert [r.x for r in spark.createDataFrame([("abcab\nc",), ("",), (None,)], "t string").select(render.replace_longest(F.col("t"), pairs).alias("x")).collect()] == ["21\n3", "", None]


def test_policies(spark):
    rows = [("dictionary", "Foo_Bar", "x1"), ("alias-registry", "foobar", "y2"), ("denylist", "baz", None), ("allowlist", "QUX", None), ("dictionary", "qux", "z")]
    got = {r.normalized: (r.replacement, r.policy_source) for r in policy.term_table(policy.entries(spark, rows), "s").collect()}
    assert got["foobar"] == ("y2", "alias-registry") and got["baz"][0].startswith("sym_") and "qux" not in got


def test_paths(spark):
    files = spark.createDataFrame([("harbormill/wrenlocke.rs",), ("harbormill/x.wrenlocke",), (".wrenlocke",)], "path string")
    projected = paths.project_paths(files, TERMS[:2])
    assert {r.projected for r in projected.collect()} == {"plaindock/sym_01.rs", "plaindock/x.wrenlocke", ".sym_01"}
    mapped = paths.path_map(projected)
    assert paths.path_collisions(mapped).count() == 0
    clash = paths.path_map(spark.createDataFrame([("a/X", "p/q"), ("b/y", "P/q")], "path string, projected string"))
    assert paths.path_collisions(clash).count() == 2
    asked = spark.createDataFrame([("plaindock/new/f.rs",), ("PlainDock/sym_01.rs",), ("plaindock/sym_01.rs/below",)], "asked string")
    assert {r.asked: r.real for r in paths.resolve_new(asked, mapped).collect()} == {"plaindock/new/f.rs": "harbormill/new/f.rs"}
    assert {r.asked: r.real for r in paths.resolve(asked, mapped).collect()}["PlainDock/sym_01.rs"] == "harbormill/wrenlocke.rs"


def test_incremental_rerun_and_single_edit(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    seen = []

    def made(d):
        seen.append(d.count())
        return d.select("doc_id", "fingerprint")

    printed = incremental.with_fingerprint(docs, "text")
    state, _ = incremental.index_pass(made(printed.limit(0)), printed, made)
    state = spark.createDataFrame(state.collect(), state.schema)
    incremental.index_pass(state, printed, made)
    edited = incremental.with_fingerprint(docs.withColumn("text", F.when(F.col("doc_id") == 7, "new").otherwise(F.col("text"))), "text")
    incremental.index_pass(state, edited, made)
    policy_changed = incremental.with_fingerprint(docs.withColumn("policy", F.lit("p2")), "text", "policy")
    incremental.index_pass(state, policy_changed, made)
    assert seen[1:] == [200, 0, 1, 200]
    gone = incremental.changes(state, printed.where("doc_id <> 3")).where("outcome = 'removed'")
    assert [r.doc_id for r in gone.collect()] == [3]


def test_search_and_chunks(spark):
    docs = spark.createDataFrame([(1, "é aa.aa\r\nb\naaaa"), (2, ""), (3, None), (4, "\\E \\Q \\E")], "doc_id long, text string")
    assert sorted((r.doc_id, r.line, r.column) for r in search.search(docs, "aa").collect()) == [(1, 1, 3), (1, 1, 6), (1, 3, 1), (1, 3, 3)]
    assert sorted((r.doc_id, r.line, r.column) for r in search.search(docs, "\\E").collect()) == [(4, 1, 1), (4, 1, 7)]
    capped = search.search_capped(docs, "aa", 3).collect()
    assert len(capped) == 3 and all(r.truncated for r in capped)
    ten = spark.createDataFrame([(1, "\n".join(map(str, range(10)))), (2, ""), (3, "one")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start_line, r.end_line) for r in chunks.line_chunks(ten, 4, 1).collect()) == [(1, 1, 4), (1, 4, 7), (1, 7, 10), (3, 1, 1)]
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 20))]
        found = chunks.byte_ranges(sizes, r.randint(1, 60), r.randint(0, 3))
        assert [i for a, b, o in found for i in range(o, b)] == list(range(len(sizes)))
    parts = chunks.byte_chunks(ten, 5, 0).where("doc_id = 1").orderBy("chunk_index").collect()
    assert "".join(p.chunk for p in parts) == "\n".join(map(str, range(10)))


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.score, 3)) for r in vectors.top_k(rows, [1, 0], 4).collect()] == [(1, 1.0), (6, 1.0), (3, 0.707), (2, 0.0)]
    made = vectors.embed(spark.createDataFrame([(i, f"c{i}") for i in range(5)], "chunk_id long, chunk string"), lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert made.count() == 5 and [float(x) for x in made.first().vector] == [2.0, 1.0]


def test_graphs(spark):
    r = random.Random(3)
    edges = {tuple(sorted((r.randint(0, 60), r.randint(0, 60)))) for _ in range(45)} | {(i, i + 1) for i in range(100, 140)}
    edges = {(a, b) for a, b in edges if a < b}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {x.node: x.root for x in graph.connected_components(frame).collect()} == root
    start = min(root)
    reach = graph.component_of(frame, spark.createDataFrame([(start,)], "node long"))
    assert {x.node for x in reach.collect()} == {n for n in root if root[n] == root[start]}
    assert graph.connected_components(frame.limit(0)).count() == 0
    tree = spark.createDataFrame([(i, (i - 1) // 2 if i else None, "even" if i % 2 == 0 else "odd") for i in range(15)], "node_id long, parent_id long, kind string")
    got = graph.nearest_ancestor(graph.ancestors(tree, tree.where("node_id = 14")), tree, ["odd"]).collect()
    assert not got or got[0].ancestor in (1, 3)


def test_symbols(spark):
    source = "def outer(a):\n    b = a\n    def inner():\n        return b\n    return inner\nouter(1)\n"
    nodes = symbols.parse_python(spark.createDataFrame([(1, source), (2, "not python ("), (3, None)], "doc_id long, text string"))
    assert {(r.name, r.role) for r in nodes.where("name is not null").collect()} >= {("outer", "declaration"), ("a", "declaration"), ("b", "reference"), ("inner", "reference")}
    named = nodes.where("name is not null").selectExpr("doc_id", "node", "name", "role", "scope", "node AS at")
    refs, decls = named.where("role = 'reference'").withColumnRenamed("node", "ref_id"), named.where("role = 'declaration'").withColumnRenamed("node", "symbol_id")
    assert {r.role for r in symbols.resolve(refs, decls).collect()} == {"bound"}
    old = spark.createDataFrame([(1, "n1", "s_old", "f", 0, 5)], "doc_id long, node_id string, symbol_id string, name string, start long, end long")
    new = spark.createDataFrame([(1, "n9", "s_new", "f", 0, 5), (1, "n2", "s_2", "g", 6, 9)], old.schema)
    assert {r.node_id: r.symbol_id for r in symbols.keep_ids(old, new).collect()} == {"n9": "s_old", "n2": "s_2"}


@given(st.lists(st.text(alphabet="ab -+@", max_size=6), max_size=12), st.lists(st.text(alphabet="ab -+@", max_size=6), max_size=12))
@settings(max_examples=200, deadline=None)
def test_diff_make_parse_apply(old, new):
    a, b = "".join(x + "\n" for x in old), "".join(x + "\n" for x in new)
    patch = diffs.make_patch(a, b, "f.txt")
    assert diffs.apply_hunks(a, [h for f in diffs.parse_patch(patch) for h in f["hunks"]]) == b


def test_diff_cases(spark):
    assert diffs.apply_hunks("a\r\nb\r\n", diffs.parse_patch("--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\r\n-b\r\n+c\r\n")[0]["hunks"]) == "a\r\nc\r\n"
    assert diffs.apply_hunks("", diffs.parse_patch("--- /dev/null\n+++ b/f\n@@ -0,0 +1 @@\n+x\n\\ No newline at end of file\n")[0]["hunks"]) == "x\n"
    assert diffs.parse_patch("--- a/f\tdate\n+++ b/f\n@@ -1 +1 @@\n--- x\n+y\n")[0]["hunks"][0]["lines"][0] == {"op": "-", "text": "-- x"}
    rows = spark.createDataFrame([("a\n", "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-z\n+y\n"), ("a\n", "--- a/f\nnothing"), ("a\n", "--- a/f g\n+++ b/f\n"), (None, None)], "text string, patch string")
    got = diffs.apply_patches(rows).collect()
    assert [r.after for r in got] == [None, None, None, ""] and all(r.reason for r in got[:3])
    assert diffs.parse_patches(rows).select(F.explode_outer("files").alias("f")).count() == 4
    planned = diffs.plan_modifications(spark.createDataFrame([("HarborMill a\nx", "PlainDock a\nx", "PlainDock a\nPlainDock y"), ("a", "a\nb", "c")], "text string, rendered string, edited string"), TERMS[:1]).collect()
    assert planned[0].planned == "HarborMill a\nHarborMill y" and planned[1].reason
    docs = spark.createDataFrame([(1, "héllo"), (2, "abc"), (3, "abc")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 1, 3, "e"), (2, 0, 2, "x"), (2, 1, 2, "y"), (3, 3, 3, "!"), (1, 6, 6, "."), (3, 0, 0, "")], "doc_id long, start long, end long, replacement string")
    assert {r.doc_id: (r.after, r.status) for r in diffs.apply_edits(docs, edits).collect()} == {1: ("hello.", "applied"), 2: (None, "conflict"), 3: ("abc!", "applied")}
    cut = diffs.apply_edits(docs, spark.createDataFrame([(1, 2, 2, "x")], edits.schema)).first()
    assert cut.status == "conflict"


def test_review(spark):
    events = spark.createDataFrame([(1, 1, "open"), (1, 3, "done"), (1, 2, "held"), (2, 1, "open")], "id long, at long, status string")
    assert {r.id: r.status for r in review.latest_state(events, "id", "at", "status").collect()} == {1: "done", 2: "open"}
    assert incremental.newest(events, F.col("id"), F.col("at"), 0).count() == 4 and incremental.newest(events, F.col("id"), F.col("at"), 1).count() == 2


def test_corpus_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, data in {"src/a.rs": b"fn x", "yarn.lock": b"k=v", "src/b.bin": b"\0\1", "src/c.txt": "é".encode() * 5000, "bad.txt": b"ok \xff", "node_modules/z.js": b"1", "big.txt": b"x" * 2000}.items():
        (root / name).write_bytes(data)
    got = {r.path: r.outcome for r in corpus.read_corpus(spark, str(root), 15_000).collect()}
    assert got["src/a.rs"] == "read" and got["yarn.lock"] == "name" and got["src/b.bin"] == "binary" and got["src/c.txt"] == "read" and got["bad.txt"] == "binary"
    assert "node_modules/z.js" not in {r.path for r in corpus.discover(spark, str(root)).collect()}
    df = spark.range(3)
    corpus.write_snapshot(df, str(tmp_path / "snap"), 1)
    corpus.write_snapshot(df.where("id > 0"), str(tmp_path / "snap"), 2)
    assert corpus.read_snapshot(spark, str(tmp_path / "snap")).count() == 2
    assert corpus.json_envelope(df).first().json == '{"id":0}'


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("HarborMill at host.example\nplain\n")
    lines = spark.readStream.text(str(source))
    done = redact.write_stream(redact.redact_lines(lines, [("host.example", "H")], TERMS[:1]), str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination(60)
    assert {r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"PlainDock at H", "plain"}
    batches = []
    redact.maintain(lines, lambda df, n: batches.append(df.count()), str(tmp_path / "cp2")).awaitTermination(60)
    assert batches == [2]
