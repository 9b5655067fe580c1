"""Round 3: op7_pieces cuts by bytes and folds parts of words, each once."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corpusloom.llm import pieces

ODD = [None, "", "   ", "\n\n a", "a\n", "▁x ▁ y", "\U0001f600\U0001f600 中文字\r\n\t\x00", "a" * 300, "�", "  a  b\n \n", "so, so. (so) so-so; It's so!"]


def _words(text: str | None) -> list[str]:
    return re.findall(pieces.WORD, pieces.SPACE + text.replace(" ", pieces.SPACE)) if text else []


def _by_parts(words: list[str], model: pieces.Pieces, merges: pieces.Merges) -> list[list[int]]:
    parts, n = pieces.cut_parts(pa.array([w.replace(pieces.SPACE, " ") for w in words], pa.string()), pieces.joins(model))
    ids, counts = merges.folded(pc.replace_substring(parts, " ", pieces.SPACE))
    sums, ends = np.concatenate([[0], np.cumsum(counts)]), np.cumsum(n)
    return [ids[sums[b - k] : sums[b]].tolist() for b, k in zip(ends, n)]


def test_words_by_bytes_are_those_of_the_pattern():
    words, n = pieces.cut_words(pa.array(ODD, pa.string()))
    want = [_words(t) for t in ODD]
    assert n.tolist() == [len(w) for w in want]
    assert [w.replace(" ", pieces.SPACE) for w in words.to_pylist()] == [w for some in want for w in some]


def test_ids_of_parts_are_those_of_whole_words():
    for seed in range(40):
        rng = random.Random(seed)
        letters = "abc" + pieces.SPACE + "é"
        names = list(dict.fromkeys([*(c for c in letters if rng.random() < 0.9), *("".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(30))]))
        # every other model has equal scores
        scores = [float(rng.randint(-6, 0)) if seed % 2 else -float(k) for k in range(len(names))]
        model = pieces.Pieces(tuple((p, k + 3, s) for k, (p, s) in enumerate(zip(names, scores))), 500, False, 5)
        words = list({"".join(rng.choices(letters + "dñ", k=rng.randint(1, 80))) for _ in range(40)})
        want = [pieces.fold_word(w, model.by_piece(), 500).tolist() for w in words]
        assert _by_parts(words, model, pieces.Merges(model.by_piece(), 500)) == want


def test_words_with_other_marks_have_the_same_parts():
    """So a task folds far fewer strings than there are different words."""
    model = pieces.load(pieces.model_path())
    bare = [f"{a}{b}" for a in ("sal", "tor", "min", "ver") for b in ("den", "gar", "lo", "is")]
    words = pa.array([f" {w}{mark}" for w in bare for mark in ("", ";)", "!)", "|", "#", "~")], pa.string())
    parts = pieces.cut_parts(words, pieces.joins(model))[0].unique()
    assert len(words.unique()) == 96 and len(parts) < 32


def test_small_blocks_and_a_small_memory_give_the_same_ids(spark, monkeypatch):
    model = pieces.load(pieces.model_path())
    by_piece = model.by_piece()
    rng = random.Random(7)
    texts = ODD + [" ".join("".join(rng.choices("aeinorst,.-é", k=rng.randint(1, 90))) for _ in range(30)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    broken = spark.range(1).select(F.lit(99).cast("long").alias("doc_id"), F.expr("cast(unhex('61ff20c3') as string)").alias("text"))
    monkeypatch.setattr(pieces, "CUT_BYTES", 500)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    got = {r["doc_id"]: r for r in pieces.encoded(rows.unionByName(broken), model, {"▁a": pieces.fold_word("▁a", by_piece, model.byte_base)}).collect()}
    for k, text in [*enumerate(texts), (99, "a� �")]:
        if text is None:
            assert got[k]["ids"] is None and got[k]["n_tokens"] is None and got[k]["decoded_sha256"] is None
            continue
        want = [i for w in _words(text) for i in pieces.fold_word(w, by_piece, model.byte_base).tolist()]
        assert got[k]["ids"] == want and got[k]["n_tokens"] == len(want)
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.replace(pieces.SPACE, " ").encode()).hexdigest()
