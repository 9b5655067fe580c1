"""Counts come from all texts."""

from collections import Counter

from corpusloom.llm import pieces


def test_the_dictionary_counts_every_text(spark, monkeypatch):
    import re

    # the common word stands in a few of 6,000 texts, which a sample would mostly miss
    texts = [f"w{i} " + ("often " * 500 if i % 1500 == 7 else "") + "seldom" * (i % 2) for i in range(6000)] + [None, "", "x" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter(w for t in texts if t for w in re.findall(pieces.WORD, pieces.SPACE + t.replace(" ", pieces.SPACE)) if len(w) <= pieces.DICTIONARY_CHARS)
    monkeypatch.setattr(pieces, "COUNTED", 100)
    assert {r["word"]: r["count"] for r in pieces.word_counts(docs).collect()} == dict(want)
    monkeypatch.setattr(pieces, "DICTIONARY_WORDS", 2)
    assert set(pieces.dictionary(docs, pieces.load(pieces.model_path()))) == {w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:2]}
