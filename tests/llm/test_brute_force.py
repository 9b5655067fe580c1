"""Parts of the numbered operators against trying everything, on small inputs."""

import itertools
import random
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licenses, media, mixing, neardup, pieces, pii, sharding, toxicity, urls

DATA = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_of_all_segmentations(spark):
    scores = {"a": -2.1, "b": -3.2, "c": -2.7, "ab": -4.05, "bc": -4.31, "abc": -6.6, "ca": -3.93, "cab": -6.81, "▁": -1.3, "▁a": -2.95}
    model = pieces.Pieces(tuple((p, i, s) for i, (p, s) in enumerate(scores.items())), 100, True, 3)
    rng = random.Random(4)
    words = sorted({"▁" + "".join(rng.choice("abcx") for _ in range(rng.randrange(0, 7))) for _ in range(60)})

    def segmentations(word):
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            ends = [i + 1 for i, cut in enumerate(cuts) if cut] + [len(word)]
            yield [word[a:b] for a, b in zip([0, *ends], ends)]

    def worth(parts):
        return sum(scores[p] if p in scores else -1000.0 if len(p) == 1 else -1e9 for p in parts)

    want = {}
    for w in words:
        best = max(segmentations(w), key=worth)
        want[w] = [x for p in best for x in ([list(scores).index(p)] if p in scores else [100 + b for b in p.encode()])]
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    assert got == want
    assert {w: pieces._viterbi_word(w, model.by_piece(), 100, 3).tolist() for w in words} == want


def test_words_folded_at_once_are_as_one_by_one():
    """Ties of scores, characters that are no piece, long and empty lists of words; and the given model."""
    toy = {"a": (-9.0, 0), "b": (-9.0, 1), "c": (-9.0, 2), "ab": (-1.0, 3), "bc": (-1.0, 4), "aa": (-1.0, 5), "abc": (-2.0, 6), "aab": (-3.0, 7), "abab": (-2.0, 8), "x?": (-1.0, 9)}
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    words += ["a?b", "x?", "\U0001f600ab", "ab" * 32, "ab" * 33, "abc" * 100]
    merges = pieces.Merges(toy, 100)
    got = merges.fold(words)
    assert got.keys() == set(words)
    assert all(got[w].tolist() == pieces.fold_word(w, toy, 100).tolist() for w in words)
    assert merges.fold([]) == {}
    assert pieces.Merges({"a": (0.0, 0)}, 9).fold(["a", "aa"])["aa"].tolist() == [0, 0]
    model = pieces.load(pieces.model_path())
    words = ["▁international", "▁1234.56", "▁▁▁", "\n\n", "▁naïve", "▁日本", "▁" + "z" * 70, "▁don't"]
    got = pieces.Merges(model.by_piece(), model.byte_base).fold(words)
    assert all(got[w].tolist() == pieces.fold_word(w, model.by_piece(), model.byte_base).tolist() for w in words)



def test_decode_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        spans = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scored = [(i, j, rng.normal(size=len(pii.KINDS))) for i, j in spans]

        def worth(chosen):
            return sum(s.max() for _, _, s in chosen)

        best = 0.0
        for k in range(1, 5):
            for chosen in itertools.combinations(scored, k):
                if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:])):
                    best = max(best, worth(chosen))
        found = pii.decode(n, scored)
        of = {(i, j): s for i, j, s in scored}
        if len(found) <= 4:
            assert sum(of[i, j][kind] for i, j, kind in found) == pytest.approx(best)


def test_verdicts_over_a_random_graph(spark):
    rng = random.Random(2)
    names = [f"http://h{i}.{'net' if i % 9 == 4 else 'org' if i % 11 == 7 else 'io'}/{'de/' if i % 9 == 4 else 'es/' if i % 11 == 7 else 'p/'}{i}" for i in range(120)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    pages = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "page_id long, url string, html string")
    got = {r["url"]: (r["verdict"], r["decided_by"]) for r in urls.judged(pages, redirects=spark.createDataFrame(edges, "source string, target string")).collect()}
    to = {n: n for n in names}

    def top(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in edges:
        to[top(a)] = top(b)
    own = lambda n: "allow" if ".net/de/" in n else "block" if ".org/es/" in n else None
    said = defaultdict(set)
    for n in names:
        said[top(n)].add(own(n))
    for n in names:
        here = said[top(n)]
        want = (own(n), "rule") if own(n) else ("allow", "alias") if "allow" in here else ("block", "alias") if "block" in here else ("allow", "default")
        assert got[n] == want, n


def test_rules_as_a_table_decide_as_a_list(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame([(-1, None, None), (-2, "none", "x")], "page_id long, url string, html string"))
    rules = [*urls.RULES, ("block", "www.example.com", "/en/7"), ("allow", "com", "/")]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    a, b = ({tuple(r) for r in urls.judged(pages, x).collect()} for x in (rules, table))
    assert a == b and len(a) == pages.distinct().count()


@pytest.mark.parametrize("seed", range(20))
def test_targets_are_a_water_level(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 300, 2000]) for _ in range(rng.randrange(1, 8))]
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * s, level * w) for s, w in zip(sizes, weights)) < sum(sizes) else (low, level)
    assert [float(x) for x in mixing.targets(sizes, weights)] == pytest.approx([min(3 * s, high * w) for s, w in zip(sizes, weights)], abs=1e-6)


def test_thresholds_are_those_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1, 50), rng.choice([rng.randrange(1 << 60), 12345])) for _ in range(400)]
    total = Counter()
    for s, n, _ in rows:
        total[s] += n
    budgets = [(s, total[s] * share) for s, share in (("a", 0.3), ("b", 0.77), (None, 0.05))]
    got = mixing.thresholds(spark.createDataFrame(rows, "source string, size long, hash long"), budgets)
    for s, budget in budgets:
        own = defaultdict(int)
        for source, n, h in rows:
            if source == s:
                own[h] += n
        taken, best = 0, abs(budget)
        for h in sorted(own):
            taken += own[h]
            best = min(best, abs(taken - budget))
        assert abs(sum(n for h, n in own.items() if h < got[s]) - budget) == best


def test_rewrite_keeps_every_row(spark, tmp_path):
    rows = [(i, f"text {i} " * (i + 1), i % 3) for i in range(40)] + [(None, "no id", 0), (None, "nor here", 1), (1, "again", 2), (1, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int").withColumn("slot_", F.lit(1))
    manifest, flow = sharding.rewrite(docs, str(tmp_path / "old"), str(tmp_path / "new"), shards=4)
    back = spark.read.parquet(str(tmp_path / "new"))
    moved = {r["shard"] for r in manifest.where("rewritten").collect()}
    assert moved == {0, 1, 2, 3}
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    for r in back.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect():
        assert sorted(r["s"]) == list(range(len(r["s"])))


def test_score_by_plain_loops():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "bad", "worse", "tree", "house"], int(rng.integers(1, 12)))) for _ in range(40)]
    y = np.array([int("bad worse" in t) for t in texts])
    import pyarrow as pa

    ids, first = toxicity.word_ids(pa.array(texts))
    parts = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
    model = toxicity.fit(parts, y)
    scores = model.scores(ids, first)
    for t, got in zip(parts, scores):
        x = np.array([model.rows[a] + model.rows[b] for a, b in t]) if len(t) else np.zeros((0, toxicity.DIM))
        total = float(model.shift)
        pooled = []
        for f in model.filters:
            width = len(f)
            padded = np.concatenate([x, np.zeros((width - 1, x.shape[1]))])
            best = [max(sum(float(padded[i + j] @ f[j][:, c]) for j in range(width)) for i in range(len(x))) for c in range(f[0].shape[1])]
            pooled += best
        hidden = np.maximum(np.array(pooled) + model.bias, 0)
        total += float(hidden @ model.out)
        assert got == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4)


def test_thumbnails_of_own_and_of_broken_files(spark):
    files = media.encode([bytes(range(64)) * 5, bytes(64)])
    df = spark.createDataFrame([(1, files[0]), (2, files[1]), (3, files[0][:40]), (4, b"junk"), (5, None)], "id int, media binary").withColumn("width", F.lit("clash"))
    got = {r["id"]: r for r in media.thumbnails(df).collect()}
    assert got[1]["width"] % 8 == 0 and got[1]["width"] * got[1]["height"] >= 64 * 5
    assert got[1]["thumbnail_hash"] != got[2]["thumbnail_hash"]
    assert [got[i]["width"] for i in (3, 4, 5)] == [None] * 3


def test_columns_of_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "write to ann@example.com. Licensed under the Apache License, Version 2.0.", "x")], "doc_id long, text string, spans string")
    for name in ("n_ip", "ids", "n_tokens", "license", "dice", "score", "threshold"):
        df = df.withColumn(name, F.lit("mine"))
    found = pii.found(df).first()
    assert found["spans"].startswith("email:9:") and found["n_ip"] == 0
    assert len(pieces.encode(df).first()["ids"]) > 5
    assert isinstance(licenses.scan(df).first()["dice"], float)


def test_near_duplicate_stage_on_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two"), (None, "alone here"), (7, "\n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect())
    assert kept[1, long] == 1 and (2, long + " end") not in kept
    assert kept[5, "one two"] == 1 and (6, "one two") not in kept
    assert kept[3, None] + kept[4, ""] == 1 and kept[7, "\n\t "] == 1 and kept[None, "alone here"] == 1
    assert neardup.deduplicated(docs.where("doc_id < 0")).count() == 0


def test_whole_licence_files_are_named(spark):
    wrapped = "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + textwrap.fill(licenses.MIT_TEXT, 70)
    rows = spark.createDataFrame([(1, wrapped), (2, "Copyright 2020 B\n" + licenses.BSD_CONDITIONS + "\n" + licenses.BSD_THIRD + "\n" + licenses.BSD_WARRANTY), (3, licenses.MIT_TEXT[:200])], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["license_line"]) for r in licenses.scan(rows).collect()}
    assert got[1][0] == "MIT-text" and got[1][1] == 0 and got[2][0] == "BSD-3-Clause-text"
    assert got[3][0] != "MIT-text"


def test_words_are_bounded_before_they_come_to_the_driver(spark, monkeypatch):
    """Documents in the order of their hashes, each that still fits; the rest's words are never collected."""
    import zlib

    rows = [(i, "bad word " * (1 + i % 50) if i % 2 else "fine text here " * (1 + i % 40), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    order = [r["doc_id"] for r in docs.where("crc32(cast(doc_id as string)) % 5 <> 0").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").collect()]
    fits, words = [], 0
    for i in order:
        n = len(rows[i][1].split())
        if words + n <= 3000:
            words += n
            fits.append(i)
    seen = []
    monkeypatch.setattr(toxicity, "MOST_WORDS", 3000)
    monkeypatch.setattr(toxicity, "fit", lambda parts, y: seen.append(([len(p) for p in parts], list(y))) or toxicity.Model(np.zeros((1, toxicity.DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0))
    monkeypatch.setattr(toxicity.Model, "scores", lambda self, ids, first: np.zeros(len(first) - 1))
    toxicity.train(docs, labels)
    learned = [i for i in fits if zlib.crc32(str(i).encode()) % 5 != 1]
    assert seen == [([len(rows[i][1].split()) for i in learned], [i % 2 for i in learned])] and len(fits) < len(order)
