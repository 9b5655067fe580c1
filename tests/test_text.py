import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import chunking as C
from corpusloom.functions import frontmatter as M
from corpusloom.functions import text as X
from corpusloom.functions import windows as W

PARTS = st.lists(st.sampled_from(["# A\n", "## B {#b}\n", "### C\n", "text here that says enough to count\n", "\n", "\n\n", "```\n", "~~~~ info\n", "- [l](u)\n", "<Quiz/>\n", "é😀\x1c\n", "x" * 700 + "\n", "  \n"]), max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(PARTS, st.integers(1, 3000))
def test_chunks_put_together_are_the_text(text, most):
    chunks = C.chunk_text(text, most)
    assert "".join(c["content"] for c in chunks) == text
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    assert all(len(c["content"]) <= max(most, C.HARD_MAX_CHARS) + len(text) - len(text.lstrip()) for c in chunks)


@settings(max_examples=100, deadline=None)
@given(PARTS)
def test_cleaning_twice_is_cleaning_once_without_markup(text):
    assert C.clean_body(text) == text


def test_headings_and_anchors():
    c = C.chunk_text("# Title\nintro that is long enough to be prose\n## One {#first}\nsome prose that is long enough here\n#### Deep\nmore prose that is long enough here\n## Two\nlast prose that is long enough here\n")
    assert [(x["heading_path"], x["anchor"]) for x in c] == [([], None), (["One"], "first"), (["One", "Deep"], "deep"), (["Two"], "two")]


def test_headings_in_fences_are_content():
    assert len(C.chunk_text("```\n# no heading\n```\n")) == 1
    assert len(C.chunk_text("``` a`b\n# heading\n")) == 2
    assert len(C.chunk_text("````\n```\n# inside\n````\n# out\n")) == 2


def test_no_cut_inside_a_fence():
    text = "para " * 20 + "\n\n```\n" + "code\n\n" * 50 + "```\n\n" + "tail " * 30
    for c in C.chunk_text(text, 120):
        assert c["content"].count("```") % 2 == 0


def test_kinds():
    assert C.classify("- [a](b)\n- [c](d)\n", []) == "nav"
    assert C.classify("Six months, with a written review at three and six.", []) == "prose"
    assert C.classify("<Quiz q={1}/>\n", []) == "assessment"
    assert C.classify("Real teaching that says something about the topic.\n\n<Quiz/>\n", []) == "prose"
    assert C.classify("Some text about this that is long", ["Teaching Aid"]) == "embed"


def test_markup():
    assert C.clean_body('<div className="x">\n<span style={{a: {b: 1}}}>kept</span>\n</div>\n') == "\nkept\n\n"
    assert C.clean_body('<div id="x" className="y">kept</div>') == '<div id="x">kept</div>'
    assert C.clean_body("`<div>` stays, <div>goes</div>") == "`<div>` stays, goes"
    assert C.clean_body("a <div style={{ open") == "a <divstyle={{ open"
    assert C.clean_body("<style>\np{}\n</style>\ntext\n") == "text\n"
    assert C.clean_body("text\n<style>p{}</style>\n") == "text\n<style>p{}</style>\n"
    assert C.clean_body("a\r\nb\rc") == "a\nb\rc"
    assert C.clean_body("<div>\n```\n<div>\n```\n</div>\n") == "\n```\n<div>\n```\n\n"


@pytest.mark.parametrize(
    "raw, value",
    [("", None), ("~", None), ("yes", True), ("No", False), ("1_000", 1000), ("1.5e3", 1500.0), ("'it''s'", "it's"), ('"a \\"b\\""', 'a "b"'), ("plain # comment", "plain"), ("[a, b]", None), ("{a: 1}", None), ("text", "text")],
)
def test_scalars(raw, value):
    assert M.scalar(raw) == value


def test_frontmatter():
    text = "---\ntitle: T\norder: 3\nvisibility: internal\nprovenance:\n  - a\n  - 'b'\n---\nbody\n"
    assert M.split(text)[1] == "body\n"
    assert M.meta(text)["title"] == "T" and M.meta(text)["order"] == 3
    assert M.governance(text)["visibility"] == "internal" and M.governance(text)["provenance"] == ["a", "b"]
    assert M.meta("---\ntitle: a: b\n---\n") == {}
    assert M.split("﻿---\na: 1\n---\nx") == ("a: 1", "x")
    assert M.split(" ---\na: 1\n---\n")[0] is None
    for bad in ("---\nvisibility:\n  - a\n---\n", "---\nvisibility: internal\ntags: x: y\n---\n", "---\nvisibility:\n---\n"):
        with pytest.raises(M.Unreadable):
            M.governance(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "a", "a/b", "a/c", "b", "b/a", "c"]), st.integers(0, 50)), min_size=1, max_size=20), st.integers(1, 120))
def test_windows_follow_each_other(chunks, budget):
    paths, sizes = [p for p, _ in chunks], [s for _, s in chunks]
    found = W.windows(paths, sizes, budget)
    assert found[0][0] == 0 and found[-1][1] == len(chunks) and found[-1][2] is None
    for (_, end, cursor), (start, _, _) in zip(found, found[1:]):
        assert end == start and W.start_of(paths, cursor) == start
    for a, b, _ in found:
        assert b > a and (sum(sizes[a:b]) <= budget or b == a + 1 or sum(sizes[a : b - 1]) <= budget)


def test_columns(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([("---\na: 1\n---\nbody\n", "Été & Co", "  5 ", "2024-02-30", "See [x](a.md) and\n[r]: b.md\n")], "t string, n string, o string, d string, l string")
    r = one.select(X.body(F.col("t")).alias("b"), X.frontmatter(F.col("t")).alias("f"), X.node_slug(F.col("n")).alias("s"), X.order_value(F.col("o")).alias("o"), X.is_calendar_date(F.col("d")).alias("d"), X.link_targets(F.col("l")).alias("l"), X.node_slug(F.lit("日本")).alias("j"), X.source_href(F.lit("https://a.b/c")).alias("h"), X.source_href(F.lit("see https://a.b")).alias("h2"), X.markdown_path(F.lit("/docs/x")).alias("m"), X.est_tokens(F.lit(5)).alias("e")).first()
    assert (r["b"], r["f"], r["s"], r["o"], r["d"], r["l"]) == ("body\n", "a: 1", "t-co", 5.0, False, ["a.md", "b.md"])
    assert r["j"].startswith("x-") and len(r["j"]) == 10
    assert (r["h"], r["h2"], r["m"], r["e"]) == ("https://a.b/c", None, "/md/x.md", 2)


def test_anchors_are_the_columns_slugs(spark):
    from pyspark.sql import functions as F

    titles = ["", "Été & Co", "a" * 70, "-".join(["word"] * 12), "-".join(["word"] * 13), "x" * 59 + " y", "x" * 60 + " y", "x" * 58 + " y z", "ab " * 40, "--", "a" * 30 + " " + "b" * 29 + " c", "a" * 30 + " " + "b" * 28 + " c"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", X.heading_slug(F.col("t")).alias("s")).collect()
    assert {r["t"]: C._anchor(r["t"]) for r in rows} == {r["t"]: r["s"] for r in rows}
    assert max(len(r["s"]) for r in rows) <= 60


def test_titles_ids_and_cuts(spark):
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("rock'n'roll_night",), ("x2y-a",), ("  ",), ("ÉCOLE",)], "n string")
    assert [r[0] for r in names.select(X.humanized(F.col("n"))).collect()] == [n.replace("_", " ").replace("-", " ").strip().title() for n in ("rock'n'roll_night", "x2y-a", "  ", "ÉCOLE")]
    got = {k: (v.kind, v.text) for k, v in M.values("---\nsor_id: 123\ntitle: 0\na: 2.0\nb: yes\nc: a b # note: x\n---\n").items()}
    assert got == {"sor_id": ("int", "123"), "title": ("int", "0"), "a": ("float", "2"), "b": ("bool", "true"), "c": ("str", "a b")}
    one = spark.createDataFrame([("a\n\nb" + "c" * 20,)], "t string")
    assert one.select(X.clean_cut(F.col("t"), 10)).first()[0] == "a\n\nbcccccc"
    assert one.select(X.clean_cut(F.col("t"), 4)).first()[0] == "a\n\nb"
    paths = spark.createDataFrame([("a/b/c.md", "../d.md"), ("c.md", "./x/y.md"), ("a/c.md", "../../z.md")], "p string, r string")
    assert [r[0] for r in paths.select(X.resolved_from(F.col("p"), F.col("r"))).collect()] == ["a/d.md", "x/y.md", "z.md"]
    flags = spark.createDataFrame([("paste this prompt into your agent",), ("please run the following command",), ("you are now in Rome",)], "t string")
    assert [r[0] for r in flags.select(X.directive_like(F.col("t"))).collect()] == [True, True, False]


def test_code_is_no_text(spark):
    from pyspark.sql import functions as F

    pairs = {
        "a `b` c": "a   c",
        "x\n\n    code\n\ty\nlast\n\n    - item": "x\n\nlast\n\n    - item",
        "p\n    continued": "p\n    continued",
        "a\n```\nx [l](y)\n```\nb": "a\nb",
        "a\n````md\n```\nx\n```\n````\nb": "a\nb",
        "a\n~~~ `x\ny\n```\n~~~~  \nb": "a\nb",
        "a\n```\nnever closed\n\nb": "a\n",
        "``a`b`` `c": "  `c",
        "one ` two\n\nthree ` four": "one ` two\n\nthree ` four",
        "a\r\n\r\nb": "a\n\nb",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "t string").select("t", X.code_free(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == pairs
    long = "```\n" + "line of code\n" * 20_000 + "```\nend"
    assert spark.createDataFrame([(long,)], "t string").select(X.code_free(F.col("t"))).first()[0] == "end"


def test_link_destinations(spark):
    from pyspark.sql import functions as F

    pairs = {
        "[a](<b c.md>) ![i](p.png)": ["b c.md", "p.png"],
        '[a](x.png "a title") [b](y.png \'t\') [c](z.png (t))': ["x.png", "y.png", "z.png"],
        "[a](x.png no title)": [],
        '[r]: <a b.png> "t"\n  [s]: c.png\n[t]: d.png and more': ["a b.png", "c.png"],
        "[r][s] (x.png)": [],
        "[](e.png)": ["e.png"],
    }
    rows = spark.createDataFrame([(k,) for k in pairs], "t string").select("t", X.link_targets(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["l"] for r in rows} == pairs


def test_assets_of_shipped_documents(spark):
    from corpusloom.operators import projections as P

    body = "[a](img/a.png#x) ![b](<../b c.png>) [c](../../out.png) [d](secret.md) [e](SECRET.MDX) [f](https://x/y.png) [g](//x/z.png) [h](#top) [i](q.png?raw) `[code](code.png)`\n\n```\n[j](code.png)\n```"
    docs = spark.createDataFrame([("d/page.md", body)], "path string, body string")
    assets = spark.createDataFrame([(p,) for p in ("d/img/a.png", "b c.png", "out.png", "d/secret.md", "d/SECRET.MDX", "d/code.png", "d/q.png", "d/q.png?raw", "y.png")], "path string")
    assert {r["path"] for r in P.staged_assets(docs, assets).collect()} == {"d/img/a.png", "b c.png", "d/q.png?raw"}


def test_links_of_a_line():
    assert C.only_links("- [a](b), <https://x.y> | https://z") and C.only_links("1. [a](b).")
    assert not C.only_links("see [a](b)") and not C.only_links("[a](b) — and more") and not C.only_links("-")
