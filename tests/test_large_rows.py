"""Queries on rows that the smallest tables don't have."""

import duckdb

import __spark_entry__ as entry


def test_cuts_beside_line_ends(spark, tmp_path):
    # line ends of its own right before, right behind and around the place of the blank line, and none
    texts = ["x" * 180 + "y" * 300, "x" * 180 + "\n" + "y" * 300, "x" * 179 + "\n" + "y" * 300, "x" * 179 + "\n\n" + "y" * 300, "x" * 200 + "\n\n" + "y" * 300, "x" * 180 + "\n", "short"]
    rows = [(2 * i + odd, t) for i, t in enumerate(texts) for odd in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(entry.oracle_sql()["clean_cuts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = entry.queries()["clean_cuts"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_chunks_leave_a_task_in_blocks(spark):
    from corpusloom.functions import chunking as C

    text = "\n\n".join(["word " * 200] * 300)  # over BLOCK_CHARS / 2
    docs = spark.createDataFrame([(i, text if i % 3 else None) for i in range(12)], "doc_id long, body string").coalesce(1)
    sizes = C.chunked(docs).mapInArrow(lambda batches: (b.select(["doc_id"]) for b in batches), "doc_id long")
    want = {(i, c["ordinal"], c["chunk_hash"]) for i in range(12) if i % 3 for c in C.chunk_text(text)}
    assert {(r["doc_id"], r["ordinal"], r["chunk_hash"]) for r in C.chunked(docs).collect()} == want and sizes.count() == len(want)
    assert "MapInArrow" in C.chunked(docs)._jdf.queryExecution().toString() and "ArrowEvalPython" not in C.chunked(docs)._jdf.queryExecution().toString()


def test_a_term_of_many_chunks_is_few_rows(spark):
    from corpusloom.operators import index as I

    rows = spark.createDataFrame([(i, "the cat" if i % 2 else "the dog the") for i in range(1000)], "chunk_id long, content string").coalesce(1)
    packed = {r["term"]: r for r in I.postings(rows, "simple").collect()}
    assert set(packed) == {"the", "cat", "dog"} and len(packed["the"]["chunk_id"]) == 1000
    assert packed["the"]["places"][:3] == [0, 2, 0] and packed["the"]["starts"][:3] == [0, 2, 3]


#: Texts that the given documents don't hold: none, nothing, foreign line ends, tags and styles, headings, blank lines, fences.
ODD = [None, "", " \n\t", "a\r\nb\r\n", "a\rb\x85c", "<div>kept</div> text", "<style>\np{}\n</style>\nbody", "# T\nfirst\n## H {#h}\nsecond", "\n\n".join(["x" * 900] * 9), "y\n \n" * 900, "```\n" + "z\n\n" * 900 + "```\nend", "\U0001f600" * 9001, "x" * 8000]


def same_as_sql_on_odd_texts(spark, folder, name):
    # each text under an id of its own, twice under one id, and under none
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, t) for t in ODD] * 2 + [(None, t) for t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = duckdb.sql(entry.oracle_sql()[name].replace("FROM documents", f"FROM '{folder}/documents.parquet/*.parquet'"))
    got = entry.queries()[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_chunks_put_together_are_any_text(spark, tmp_path):
    same_as_sql_on_odd_texts(spark, tmp_path, "chunk_concat_roundtrip")


def test_hashes_of_the_chunks_of_any_text(spark, tmp_path):
    same_as_sql_on_odd_texts(spark, tmp_path, "chunk_hash")
