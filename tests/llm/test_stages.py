"""Every stage of the pipeline on nulls, empty and long texts, repeats, further columns and empty tables."""

import pytest

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, ids string, _copy int, copies int"
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from home", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from home", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (5, LONG, "de", "a"),
    (6, "write to ann.b@example.com or call +1 (918) 555-3922 today", "es", "c"),
    (6, "write to ann.b@example.com or call +1 (918) 555-3922 today", "es", "c"),
    (None, "no id here but a text of some words", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", "i", 7, 9) for r in rows], COLUMNS)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    out = stage(spark, docs(spark), odd)
    rows = out.collect()
    if name == "sentencepiece":
        assert {(r["doc_id"], r["lang"], r["source"]) for r in rows} == {(r[0], r[2], r[3]) for r in TEXTS} and len(rows) == len(TEXTS)
        assert {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {None} and {r["n_tokens"] for r in rows if r["doc_id"] == 3} == {0}
        return
    assert out.columns == list(P.COLUMNS)
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    if name == "toxicity":
        assert len(rows) == len({(r["doc_id"], r["text"]) for r in rows}) + sum(len(v) - 1 for v in texts.values()) and set(texts) <= {r[0] for r in TEXTS}
    if name == "simhash_near_dedup":
        assert 1 in texts and 2 not in texts and None in texts and len(texts[6]) == 1
    if name == "personal_data":
        assert len(rows) == len(TEXTS) and texts[6] == ["write to [EMAIL] or call [PHONE] today"] * 2 and texts[5] == [LONG]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    if name == "mixing":
        assert max(len(v) for k, v in texts.items() if k != 6) <= 3 and len(texts[6]) <= 6
        sizes = {s: sum(len((r[1] or "").split()) for r in TEXTS if r[3] == s) for s in ("a", "b", "c", None)}
        taken = {s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s) for s in sizes}
        assert all(taken[s] <= 3 * sizes[s] for s in sizes)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stage_on_no_rows(spark, odd, name, stage):
    assert stage(spark, docs(spark, []), odd).collect() == []


def test_near_duplicates_are_those_of_the_fingerprints(spark, odd):
    from corpusloom.llm import simhash

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = simhash.grouped(simhash.fingerprints(table.select("doc_id", "text"))).collect()
    kept = [r["doc_id"] for r in dict(P.STAGES)["simhash_near_dedup"](spark, table, odd).collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in found}) and len(kept) < len(found)
