"""Operators 4, 5, 7 and 8."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, licenses, quality, queries, urls


def same_rows(frame, relation):
    got = sorted(map(str, (tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())))
    names = relation.columns
    order = [names.index(c) for c in sorted(names)]
    return got == sorted(str(tuple(row[i] for i in order)) for row in relation.fetchall())


def views(**tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con


@pytest.fixture(scope="module")
def odd_docs(spark):
    line = "A line that is said again and again here."
    texts = [None, "", " \n\t", "one", "MIT License", "mit-license, MIT LICENSE mit license\n" * 3, "GNU General Public License version 3 or the Apache License 2.0", "über CC BY é4 cc by", "İ K mit licenſe MIT licen\u0130se"]
    texts += [f"{line}\n" * 4, "a b c d e f g h a b c d e x a b c d e", "w " * 60_000 + "cc by", "#$ %& *|" * 20, "a b c d e a b c d e", "spdx-license-identifier: MPL-2.0", "under the terms of the GNU Lesser General Public License v2.1"]
    rows = [(i, t, "de" if i % 3 else None, "s" if i % 2 else None, "clash", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[5], (None, "no id mit license", "de", "s", "clash", 1)], "doc_id long, text string, lang string, source string, labels string, n_words int")


def test_license_base_columns_against_sql(odd_docs):
    got = licenses.license_scan(odd_docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    con = views(documents=odd_docs.toArrow())
    assert same_rows(got, con.sql(queries.OP4_BASE_SQL))


def test_license_base_columns_of_the_table(spark, sf_dir):
    got = queries.op4_license_rules(spark, sf_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert same_rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), con.sql(queries.OP4_BASE_SQL))
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_suppression(spark):
    cases = {
        "This file is licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"},
        "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "GNU Affero General Public License version 3": {"agpl-3.0"},
        "see the GNU Lesser General Public License v2.1 and the MIT License": {"lgpl-2.1", "mit"},
        "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
        "released under the beer-ware license": {"beerware"},
        "nothing of the sort": set(),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.license_scan(docs).collect()}
    assert got == dict(enumerate(cases.values()))
    found = licenses.license_detections(docs).collect()
    for d in set(got):
        assert {r.label for r in found if r.doc_id == d} | {"apache"} == got[d] | {"apache"}
    for a in found:  # nothing contained in a detection of as good a priority is left
        for b in found:
            assert a is b or a.row != b.row or not (a.start <= b.start and a.end >= b.end and a.priority <= b.priority)
    assert len(licenses.rules()) > 300


EXPRESSION = (" spdx licen",)
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce it in the documentation.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above notice. 2. Redistributions in binary form must reproduce it. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "bsd-4-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Keep the notice. 2. All
        advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software. 3. The name of the author may not be used
        to endorse or promote products derived from this software without specific prior written permission.""",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "apache,apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "gpl,gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0,mit": "// SPDX-License-Identifier: (MIT OR Apache-2.0)",
    "apache-2.0,llvm-exception": "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception",
    "gpl-2.0,isc,mit": "SPDX-License-Identifier: GPL-2.0-only AND (MIT OR ISC)",
    "cc-by,cc-by-sa-4.0": "Text under CC BY-SA 4.0.",
    "cc-by,cc-by-nc-nd": "CC-BY-NC-ND",
    "cc-by-nc-4.0": "https://creativecommons.org/licenses/by-nc/4.0/legalcode",
    "": "the terms of the contract permitted or granted free of charge",
}


def test_license_texts_give_their_licenses(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS.values())), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert {i: got[i].labels for i in got} == dict(enumerate(TEXTS))
    assert all(r.score >= 0.8 for r in got.values() if r.labels) and got[len(TEXTS) - 1].score == 0


def test_the_gate_is_its_pattern(spark):
    r = random.Random(6)
    parts = [*licenses.GATE_WORDS, "CC", "by", "cc by", "MIT", "no", "public", "DOMAIN", " ", "-", "x", "é", "İ", "K", "licEN", "c c0", "\n"]
    texts = ["".join(r.choice(parts[-16:] if i % 2 else parts) for _ in range(r.randint(0, 4))) for i in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.passes_gate(F.col("t")).alias("g")).collect()
    assert all(x.g or not re.search(licenses.GATE, x.t, re.ASCII) for x in rows) and sum(not x.g for x in rows) > 100


def plain_scan(text):
    """Labels and score without gate, tags or the running maximum: every rule on the words, and every pair of detections compared."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    norm = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', lower))} "
    found = []
    for rule in licenses.rules():
        if rule.context not in EXPRESSION or rule.context in norm:
            for m in re.finditer(f"(?<= ){rule.pattern}(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, rule.priority, rule.id, rule.label, rule.confidence))
    ranked = sorted(found, key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept = [d for i, d in enumerate(ranked) if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] for e in ranked[:i])]
    names = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in norm}
    return ",".join(sorted(names | {d[4] for d in kept})), max((d[5] for d in kept), default=0.0)


def test_labels_and_scores_against_brute_force(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect() if len(r.text or "") < 10_000] + list(TEXTS.values()) + ["\n".join(TEXTS.values()), "MIT License\n" + TEXTS["mit"] + TEXTS["isc"]]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("(?i)licen|creative|cc by")).collect()]
    assert len(texts) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == {i: plain_scan(t) for i, t in enumerate(texts)}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def spelled(parsed):
    """All strings that a parsed pattern matches, with one letter for each class of letters that is no list."""
    made = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                ways = [chr(arg)]
            case "IN":
                ways = [chr(x) for kind, x in arg if str(kind) == "LITERAL"] or ["x"]
            case "MAX_REPEAT" | "MIN_REPEAT":
                ways = [""] * (arg[0] == 0) + spelled(arg[2])
            case "SUBPATTERN":
                ways = spelled(arg[3])
            case "BRANCH":
                ways = [x for branch in arg[1] for x in spelled(branch)]
        made = [a + b for a in made for b in ways]
    return made


def test_all_that_a_rule_matches_has_its_keywords(spark):
    for rule in licenses.rules():
        for text in spelled(re._parser.parse(rule.pattern)):
            if rule.context in EXPRESSION:  # further identifiers of an expression count only in texts that have one
                text = f"spdx license identifier {text}"
            assert re.search(rule.pattern, text) and re.search(licenses.GATE, text)
            assert rule.keyword in f" {text} " and rule.context in f" {text} ", (rule, text)
    cases = {"FreeBSD license": "bsd-2-clause", "released under the FreeBSD Licence": "bsd-2-clause", "BSD Zero Clause License": "0bsd", "Open Data Commons Database License": "odbl-1.0", "runs on FreeBSD, licensed": ""}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()} == dict(enumerate(cases.values()))


def test_tagged_patterns_match_what_plain_ones_do():
    r = random.Random(3)
    words = "gnu general public license version 3 0 mit the licence v3 apache beer ware beerware".split()
    for _ in range(300):
        text = [r.choice(words) for _ in range(12)]
        plain = f" {' '.join(text)} "
        tags = f" {' '.join(f'{w}#{i}' for i, w in enumerate(text))} "
        for rule in random.Random(1).sample(licenses.rules(), 40):
            a = [(plain[: m.start()].count(" ") - 1, m[0]) for m in re.finditer(f"(?<= ){rule.pattern}(?= )", plain)]
            b = [(int(re.search("#([0-9]+)", m[0])[1]), re.sub("#[0-9]+", "", m[0])) for m in re.finditer(licenses.tagged(rule.pattern), tags)]
            assert a == b, (rule, plain)


def test_quality_against_sql(odd_docs, spark, sf_dir):
    sql = queries.ORACLE_SQL["op5_adaptive_quality"]
    assert same_rows(quality.quality(odd_docs), views(documents=odd_docs.toArrow()).sql(sql))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert same_rows(queries.op5_adaptive_quality(spark, sf_dir), con.sql(sql))
    assert quality.quality(odd_docs.limit(0)).count() == 0


def test_repeated_words_against_windows(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.repeat_words(quality.words_of(F.col("t"))).alias("n")).collect()
    for row in got:
        w = texts[row.i].split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
        assert row.n == len(covered), texts[row.i]


def test_sketch_buckets_are_close_and_merge(spark):
    rows = spark.range(1, 100_000, 37).select(F.col("id").alias("x"), quality.bucket(F.col("id")).alias("b")).collect()
    assert all(b <= x and x - b <= x / 16 for x, b in rows)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")


def test_chat_against_plain_rendering(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):
        shared = r.randint(0, 4)
        for t in range(r.randint(1, 6)):
            content = f"shared {c // 2} {t}" if t < shared else f"own {c} {t} é"
            rows.append((c, t, ("system", "user", "assistant")[t % 3], content, "x"))
    rows += [(100, 0, "user", "alone", "x"), (None, 0, "user", "nobody", "x"), (102, 0, None, None, None), (103, 0, None, None, None), (103, 0, "user", "tie", "x")]
    frame = turns(spark, rows)
    got = {x.pair_id: x for x in chat.preference_pairs(frame, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == {c // 2 for c in by if c % 2 == 0 and c + 1 in by}
    say = lambda ts: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in ts)
    for p, x in got.items():
        a, b = sorted(by[2 * p]), sorted(by[2 * p + 1])
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        assert (x.n_common, x.prompt, x.chosen, x.rejected) == (n, say(a[:n]), say(a[n:]), say(b[n:]))
        for text, mask, own in ((x.chosen, x.chosen_mask, a[n:]), (x.rejected, x.rejected_mask, b[n:])):
            pieces = [text[int(s) : int(e)] for s, e in (m.split(":") for m in mask.split(",") if m)]
            assert pieces == [f"{t}<|im_end|>\n" for _, role, t in own if role == "assistant"]
    assert chat.preference_pairs(turns(spark, []), F.col("conv_id"), F.lit(True)).count() == 0


def test_chat_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert same_rows(queries.op7_preference_chat(spark, sf_dir), con.sql(queries.ORACLE_SQL["op7_preference_chat"]))


def test_urls_against_all_rules(spark):
    r = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "com.a", "a", "", "A.Com", "a.com.", "é.com"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/7", "/en/77?q", "/d#f", "/EN/", "/\x01", "/é"]
    pages = [(i if i % 7 else None, f"{r.choice(['http', 'x'])}://{r.choice(hosts)}{r.choice(paths)}", "x") for i in range(400)]
    pages += [(1, None, "x"), (2, "no scheme", "x"), (3, "://", "x"), (4, "http://a.com?x://y/en/", "x"), (4, "http://a.com/en/\nline", "x")]
    rules = [(h, p, r.choice(["allow", "block"])) for h in ("com", "a.com", "b.a.com", "A", "org") for p in ("", "/", "/e", "/en/", "/en/7", None)] + [(None, "/", "block"), ("com", "/e", "allow")]
    frame = spark.createDataFrame(pages, "page_id long, url string, host string")
    for ranges in (None, 1, 90):
        got = urls.filter_urls(frame, spark.createDataFrame(rules, "host string, path string, action string"), ranges=ranges).collect()
        assert len(got) == len(pages)
        best = {}
        for h, p, a in rules:
            if h is not None:
                key = (re.sub("[A-Z]", lambda m: m[0].lower(), h), p or "")
                best[key] = min(best.get(key, a), a)
        seen = {}
        for x in got:
            fits = [(len(h) + len(p), len(h), h + p, a) for (h, p), a in best.items() if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
            expected = max(fits)[2:] if fits else (None, "allow")
            assert (x.rule, x.verdict) == expected, (x, fits)
            seen[(x.host, x.path)] = 1
        parts = sorted((str(i), *((lambda m: (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", ""))(re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")))) for i, u, _ in pages)
        assert parts == sorted((str(x.page_id), x.host, x.path) for x in got)
    assert urls.filter_urls(frame, spark.createDataFrame([], "host string, path string, action string")).where("rule is not null").count() == 0
    assert urls.filter_urls(frame.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_hosts_beside_an_interval_and_a_hot_url(spark):
    """Neighbours in the order of keys, labels that hold the separator, long hosts, and one URL in a third of the rows."""
    hosts = ["a.com", "a-b.com", "a!.com", "b\x01a.com", "x.a.com", "a.com.", ".a.com", "acom", ".".join(["w"] * 5000) + ".a.com"]
    pages = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("/q/1", "/q", "/" + "long/" * 3000))] + [(1000 + i, "http://hot.a.com/q/same") for i in range(3000)]
    rules = [("a.com", "/q/", "block"), ("a.com", "", "allow"), ("hot.a.com", "/q/s", "block"), ("a", "", "block")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(frame, spark.createDataFrame(rules, "host string, path string, action string"), ranges=40).collect()}
    assert len(got) == len(pages)
    for r in got.values():
        fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "allow"))
    cut = frame.select("page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))
    points = cut.select(urls.host_key(F.col("host")).alias("key"), "path", F.xxhash64("page_id").alias("h"))
    assert sum(k == "com\x01a\x01hot\x01" for k, *_ in urls._cuts(points, 40)) > 30  # the hot URL alone takes most of the ranges


def test_url_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert same_rows(queries.op8_url_rules(spark, sf_dir), con.sql(queries.ORACLE_SQL["op8_url_rules"]))


def test_native_operators_on_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([(1, "MIT License " * 20, "en", "s", "x", 1, 2), (None, None, None, None, None, None, None), (1, "MIT License " * 20, "en", "s", "x", 1, 2)], "doc_id long, text string, lang string, source string, kept string, norm int, _text int")
    empty = docs.limit(0)
    assert quality.quality(empty).count() == licenses.license_scan(empty).count() == licenses.license_detections(empty).count() == 0
    assert quality.quality(docs).count() == licenses.license_scan(docs).count() == 3
    turns = spark.createDataFrame([(i // 2, i % 2, "assistant", "long " * 30_000 if i < 2 else f"t{i}", 1, "x") for i in range(6)], "conv_id long, turn long, role string, text string, pair_id int, c string")
    pairs = lambda t: chat.preference_pairs(t, F.floor(F.col("conv_id") / 2).cast("long"), F.col("conv_id") % 2 == 0)
    assert pairs(turns.limit(0)).count() == 0 and [r.n_common for r in pairs(turns).collect()] == [0]


def test_native_operators_plan_no_python(spark, sf_dir, capsys):
    for q in (queries.op4_license_rules, queries.op5_adaptive_quality, queries.op7_preference_chat):
        plan = json.dumps(str(q(spark, sf_dir)._jdf.queryExecution().executedPlan()))
        assert not re.search("Python|Pandas|Arrow", plan)
