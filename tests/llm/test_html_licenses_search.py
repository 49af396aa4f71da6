"""Extraction from drawn pages, license rules, exact search against brute force."""

from __future__ import annotations

import re
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantmere.llm import html_extract as H
from quantmere.llm import license_scan as L
from quantmere.llm import vector_search as S
from quantmere.llm.queries import ORACLES


def test_markup_decides():
    page = """<html><head><title>x</title><script>if (a<b) "</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
      three.<p>Next&nbsp;block<br>line<div class="ad-box">Buy</div><ul><li>i<li>j</ul><form><input>go</form>
    <section class="comments"><p>reader</p></section></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""
    assert H.extract_group([page]) == ["Head & line\nOne two three.\nNext block line\ni\nj"]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>cut <b", "cut"), ("<article><p>a &amp", "a &"), ("<div hidden>no</div><p>yes</p>", "yes"), ("</p></div>x", "x"), ("<!-- a --><p>b</p><!-- open", "b")])
def test_odd_pages(page, text):
    assert H.extract_group([page]) == [text]


def test_wrapper_finds_unmarked_template():
    pages = [f"<body><div><span>Site name</span></div><div><p>Story number {k} tells of {k * 7} things and more.</p><p>Second paragraph {k}.</p></div><div><p>All rights belong to us.</p></div></body>" for k in range(6)]
    assert H.extract_group(pages) == [f"Story number {k} tells of {k * 7} things and more.\nSecond paragraph {k}." for k in range(6)]


def _boilerplate(k, top="Site name"):
    return f"<body><div><span>{top}</span></div><div><p>Story number {k} tells of {k * 7} things and more.</p><p>Second paragraph {k}.</p></div><div><p>All rights belong to us.</p></div></body>"


@pytest.mark.parametrize("first", [None, "", "<!-- gone -->", "<body><div><sp", "<body><table><tr><td>Home</td></tr></table></body>", "error 500"])
def test_no_first_page_switches_induction_off(first):
    want = [f"Story number {k} tells of {k * 7} things and more.\nSecond paragraph {k}." for k in range(6)]
    assert H.extract_group([first, *[_boilerplate(k) for k in range(6)]])[1:] == want


def test_each_layout_has_its_template():
    shop = [f"<body><table><tr><td>Shop of things</td><td><ul><li>Item {k} costs {k * 3} coins at present.</li></ul></td></tr></table><h5>Call us</h5></body>" for k in range(5)]
    out = H.extract_group([*shop, *[_boilerplate(k) for k in range(6)]])
    assert out[:5] == [f"Item {k} costs {k * 3} coins at present." for k in range(5)]
    assert out[5:] == [f"Story number {k} tells of {k * 7} things and more.\nSecond paragraph {k}." for k in range(6)]


def test_template_that_the_first_reference_lacks():
    rows = [f"<body><div><p>Story number {k} tells of {k * 7} things and more.</p></div>{'<h6>Call us now</h6>' if k else ''}</body>" for k in range(6)]
    assert H.extract_group(rows) == [f"Story number {k} tells of {k * 7} things and more." for k in range(6)]


STORY = "A story that is told at some length, in words enough."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='layout has-sidebar'><article><p>{STORY}</p></article><div class=sidebar>Side</div></div>", STORY),
        (f"<div class='content with-comments'><p>{STORY}</p><div class=comments>me too</div></div>", STORY),
        (f"<div id=search-result><p>{STORY}</p></div>", STORY),
        (f"<div class=page-menu-left><main><p>Few.</p></main></div><p>{STORY}</p>", "Few."),
        (f"<p>{STORY}</p><div class=related><article>Another</article></div><div class=comments>me too</div>", STORY),
        (f"<article><p>{STORY}</p></article><div class=comments>{STORY * 9}</div>", STORY),
        ("<p title='the hidden cost'>a</p><p data-id=search>b</p><p alt='display: none'>c</p>", "a\nb\nc"),
        ("<div><p>yes</p><p HIDDEN=''>a</p><p aria-hidden = 'true'>b</p><p style='top:0; DISPLAY : none'>c</p><p hidden/></div>", "yes"),
        ("<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=tex>E=m</annotation></math> holds.</p>", "So E=m holds."),
    ],
)
def test_names_do_not_hide_the_content(page, text):
    assert H.extract_group([page]) == [text]


def test_varying_slot_under_a_name_is_content():
    menu = "<div class=sidebar><p>" + "Long list of places to go. " * 8 + "</p></div>"
    pages = [f"<body><div class='has-sidebar'><article><p>Story {k} tells of {k * 7} things.</p></article></div>{menu}<p>Same foot.</p></body>" for k in range(6)]
    pages = [p.replace("<article>", "<div>").replace("</article>", "</div>") if k % 2 else p for k, p in enumerate(pages)]
    assert H.extract_group(pages) == [f"Story {k} tells of {k * 7} things." for k in range(6)]


def test_copies_under_a_name_keep_their_text():
    pages = [f"<div class=has-sidebar><article><p>{STORY}</p></article></div><script>{k}</script>" for k in range(5)]
    assert H.extract_group(pages) == [STORY] * 5


def test_copies_keep_their_text():
    pages = [f"<article><h1>T</h1><p>{'same words here. ' * 20}</p><p>v{k}</p></article>" for k in range(5)]
    assert all("same words" in t for t in H.extract_group(pages))


def test_pages_table(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<p>t {k}</p>", "x") for k in range(30)] + [(None, None, None, "x"), (3, "http://h0.org/3", "<p>t 3</p>", "y")]
    out = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 32 and {(r.page_id, r.text, r.n_chars) for r in out} == {(k, f"t {k}", len(f"t {k}")) for k in range(30)} | {(None, "", 0)}
    assert H.extract_main_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string, text string").limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("Permission is hereby granted, free of charge,\n * to any person obtaining a copy", "mit"),
        ("We submit our work in Smith's name.", ""),
        (None, ""),
    ],
)
def test_license_labels(text, labels):
    assert L.scan_text(text)["labels"] == labels


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("/* GNU General\n * Public License version 2 */", "gpl,gpl-2.0"),
        ("gnu general\r\npublic license", "gpl"),
        ("# Mozilla\n#  Public License, v. 2.0", "mpl-2.0"),
        ("// Redistribution and\n//   use in source and binary forms, with or without\n// modification, are permitted", "bsd"),
        ("* Permission is\n *  hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("license: ms-pl", "ms-pl"),
        ("Creative Commons Attribution 4.0 International", "cc-by-4.0"),
        ("creative commons zero", "cc0-1.0"),
        ("all rights\n * reserved", "all-rights-reserved"),
        ("license = python-2.0", "psf-2.0"),
    ],
)
def test_wrapped_notices(text, labels):
    assert L.scan_text(text)["labels"] == labels


def examples(pattern):
    """Matches of a pattern: each alternative and optional part once, gaps as comment lines."""
    from re import _parser as P

    def draw(items):  # the first is the plainest
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "SUBPATTERN":
                some = draw(arg[3])
            elif name == "BRANCH":
                some = [x for b in arg[1] for x in draw(b)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                least, most, body = arg
                gap = (least, most) == (1, 24)
                some = ["\n * "] if gap else [x * max(least, 1) for x in draw(body)][:: 1 if most > 0 else -1]
                some = some if least else ["", *some]
            elif name == "IN":
                kind, value = arg[0]
                some = [chr(x) for k, x in arg if str(k) == "LITERAL"] or [chr(value[0]) if str(kind) == "RANGE" else " " if "SPACE" in str(value) else "7" if "DIGIT" in str(value) else "x"]
            elif name == "ANY":
                some = ["x"]
            else:
                assert name in ("ASSERT", "ASSERT_NOT", "AT"), name
                some = [""]
            out = [out[0] + x for x in some] + [x + some[0] for x in out[1:]]
        return out

    return [x for x in draw(P.parse(pattern)) if re.search(pattern, x)]


def test_every_rule_passes_the_gate():
    for k, rule in enumerate(L.rules()):
        some = examples(rule.regex.pattern)
        assert some, rule.name
        assert not [x for x in some if k not in L.gate(x)], rule.name
        assert any(L.detect(x) for x in some), rule.name
        assert all(L.scan_text(x)["detections"] for x in some), rule.name


GAPS = ["\n * ", " ", "  ", "\r\n", "\n# ", "\t", "-", "\n// "]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("permission is hereby granted free of charge gnu general public license version 2 mit apache licensed under the creative commons attribution 4.0 all rights reserved openrail-m copyright 2020 spdx-license-identifier: bsd-3-clause redistribution and use in source".split()), max_size=25), st.randoms())
def test_gated_is_ungated(words, rng):
    text = "".join(w + rng.choice(GAPS) for w in words)
    assert L.detect(text) == L.detect(text, range(len(L.rules())))


@pytest.mark.parametrize("text", ["licensed " + "_" * 2000 + " apache", "license " * 3000, "licensed under the " + "the " * 2000 + "gpl", "gpl " + "." * 20000 + " general public license", "neither the name " * 1000, "spdx license identifier: " + "a and " * 2000, "copyright " * 5000])
def test_hostile_texts_take_little_time(text):
    began = time.process_time()
    L.scan_text(text)
    assert time.process_time() - began < 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=30))
def test_accepted_intervals(pairs):
    accepted, plain = L.Accepted([s for s, _ in pairs]), []
    for s, n in pairs:
        assert accepted.hold(s, s + n) == any(a <= s and s + n <= b for a, b in plain)
        accepted.add(s, s + n)
        plain.append((s, s + n))


WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "mit", "License", "license", "apache", "general", "public", "x", "é", "license1", " ", "--", "\n"]), max_size=40))
def test_base_columns_by_brute_force(parts):
    text = " ".join(parts)
    words = WORD_RE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hits = sorted((k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    r = L.scan_text(text)
    assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(hits), ",".join(sorted({x for _, x in hits})))
    assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
    assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_tables(spark):
    docs = spark.createDataFrame([("a", "word " * 300_000 + "MIT License", 1), (None, None, 2), ("a", "", 3)], "doc_id string, text string, n_words int")
    out = sorted(((str(r.doc_id), r.n_words, r.first_word, r.labels) for r in L.scan_licenses(docs).collect()), key=str)
    assert out == [("None", 0, None, ""), ("a", 0, None, ""), ("a", 300_002, 300_000, "mit")]
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_contained_detections_are_suppressed():
    r = L.scan_text("Licensed under the Apache License, Version 2.0")
    assert [d["rule"] for d in r["detections"]] == ["apache-2.0/grant"]
    assert len(L.rules()) > 300


def test_base_places(spark):
    docs = spark.createDataFrame([(1, "MIT license mit License x Apache--license", "z"), (2, None, "z"), (None, "general public license", "z"), (1, "submit license", "z")], "doc_id long, text string, labels string")
    out = {(r.doc_id, r.n_words): r for r in L.scan_licenses(docs).collect()}
    r = out[1, 7]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 0, 5, "apache,mit")
    assert (out[2, 0].first_word, out[2, 0].score, out[None, 3].base_labels, out[1, 2].n_base) == (None, 0.0, "gpl", 0)


def test_search_matches_sql(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.2, (400, 20)).astype(np.float32)
    v[100:220] = v[100]  # one very common vector
    rows = [(k, x.tolist(), "q") for k, x in enumerate(v)] + [(500, None, ""), (550, [float("nan")] * 20, ""), (600, [1.0, None] + [0.0] * 18, ""), (650, [float("inf")] * 20, "")]
    rows += [rows[7], rows[7], rows[150], rows[50], rows[50], (50, v[3].tolist(), ""), (7, v[8].tolist(), "")]  # repeated rows, and ids with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(map(tuple, con.execute("SELECT query_id, rank, vec_id, score FROM (" + ORACLES["op10_exact_top_k"] + ")").fetchall()))
    search = lambda: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.top_k(df, df.filter("vec_id % 50 = 0")).collect())
    assert search() == want
    monkeypatch.setattr(S, "ROWS", 20)
    monkeypatch.setattr(S, "QUERIES", 2)
    monkeypatch.setattr(S, "TOGETHER", 3)
    assert search() == want  # many blocks, floors that rise


def test_search_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [-1.0, 0.5]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in S.top_k(df, df.filter("vec_id = 1"), scale=1).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (2, 3, -1)]
    assert S.top_k(df.limit(0), df.limit(0)).count() == 0
    assert S.top_k(df.filter("vec_id = 2"), df.filter("vec_id = 2")).count() == 0
    big = spark.createDataFrame([(1, [4e9, 1.0]), (2, [4e9, -1.0]), (3, [4e9, 3.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in S.top_k(big, big.filter("vec_id = 1"), scale=1).orderBy("rank").collect()] == [3, 2]


def plain_matching(a, b):
    """Nodes of the largest top-down, order-keeping mapping, by the definition."""
    if (a.tag, a.named, a.dropped) != (b.tag, b.named, b.dropped):
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(x, y))
    return 1 + best[-1][-1]


def checked(kinds, a, b):
    """The aligned pairs, after checking that they are a top-down, order-keeping mapping."""
    pairs = H.align(kinds, a, b)
    mapped = {id(x): y for x, y in pairs}
    assert len({id(y) for _, y in pairs}) == len(mapped) == len(pairs)
    for x, y in pairs:
        places = {id(k): i for i, k in enumerate(y.kids)}
        own = [places[id(mapped[id(k)])] for k in x.kids if id(k) in mapped]
        assert (x.tag, x.named, x.dropped) == (y.tag, y.named, y.dropped) and own == sorted(own)
    return pairs


@pytest.mark.parametrize("small", [0, 300, 10**9])
def test_matching_is_the_largest_by_brute_force(monkeypatch, small):
    monkeypatch.setattr(H, "SMALL", small)
    rng = np.random.default_rng(5)

    def draw(depth):
        name = ["div", "div", "span", "div class=ad"][rng.integers(4)]
        return f"<{name}>" + "".join(draw(depth - 1) for _ in range(rng.integers(0, 5) if depth else 0)) + f"</{name.split()[0]}>"

    kinds = H.Kinds()
    for _ in range(40):
        a, b = (H.parse("<section>" + "".join(draw(2) for _ in range(rng.integers(1, 7))) + "</section>") for _ in range(2))
        for x in (a, b):
            kinds.number(x)
        assert kinds.matching(a.sig, b.sig) == len(checked(kinds, a, b)) == plain_matching(a, b)


def test_wide_and_deep_pages_are_aligned_as_small_ones():
    for n, deep in ((3, 0), (300, 0), (3, 600)):
        pages, wanted = [], []
        for k, (above, below) in enumerate(((1, 3), (2, 1), (3, 2), (4, 4))):
            own = [[f"own text {k} {part} {i} " + "x" * 40 for i in range(n * many)] for part, many in (("a", above), ("b", below))]
            menu = "".join(f"<p><b>Menu {i}</b></p>" for i in range(n))
            inner = "".join(f"<p>{t}</p>" for t in own[0]) + menu + "".join(f"<p>{t}</p>" for t in own[1])
            pages.append("<div>" * deep + inner + "</div>" * deep)
            wanted.append("\n".join(own[0] + own[1]))
        assert H.extract_group(pages) == wanted
