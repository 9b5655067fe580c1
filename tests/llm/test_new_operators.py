"""Byte-level BPE, resampling and the filter audit against the library, SQL and trying everything."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import audit, bpe, registry, resampling

DATA = "/root/testdata/sf0.001"
RANKS = bpe.load(bpe.ranks_path())
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=RANKS, special_tokens={})
TREE = bpe.Tree(RANKS)
ALPHABETS = ("ab", "aeiou", "thing the ", "éèaà", "漢字仮名", "=-", "  \n", " 0123456789", "\U0001f600x", "Zz'sd")


def plain(ranks, piece):
    """BPE by its definition, one merge after the other."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return tuple(ranks[p] for p in parts)
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abc", "ab", "ca", "bcb"]), min_size=1, max_size=30), st.permutations(["ab", "bc", "ca", "abc", "cab", "aa", "aaa", "aaaa", "bcb", "abab"]))
def test_joined_halves_are_the_whole_for_any_order_of_merges(letters, order):
    """Tables in which windows must grow: the tokens' ranks are any permutation."""
    ranks = {c.encode(): i for i, c in enumerate("abc")} | {t.encode(): i + 3 for i, t in enumerate(order)}
    piece = "".join(letters).encode()
    tree = bpe.Tree(ranks)
    assert tree._halves(piece) == plain(ranks, piece) == tree.merged(piece)
    for cut in range(1, len(piece)):
        assert tree.join(plain(ranks, piece[:cut]), plain(ranks, piece[cut:])) == plain(ranks, piece)


def test_every_token_of_the_table_is_reached_by_merges():
    assert all(TREE._halves(token) == (rank,) for token, rank in RANKS.items())


def test_ids_are_the_librarys():
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "don't we'll I'D", "a" * 5000, "=" * 777, "漢字" * 2000, "the" * 3000, "\x00\x1c\x85  b"]
    texts += ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(1, 120))) for _ in range(800)]
    matches = bpe.Matches(TREE)
    find = regex.compile(bpe.pattern()).findall
    for text in texts:
        ids = [i for m in find(text) for i in TREE.encode(m.encode())]
        assert ids == LIBRARY.encode_ordinary(text), text[:50]
        assert TREE.decode(ids) == text.encode()
        assert b"".join(matches[m] for m in find(text)) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_what_is_remembered_changes_no_id(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tree = bpe.Tree(RANKS)
    matches = bpe.Matches(tree)
    for w in (" international", " unbelievable", "zzzzqqqq", " ofthshating") * 3:
        assert matches[w] == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode_ordinary(w))
    assert max(len(tree.halves), len(tree.pairs), len(matches)) <= 5


def test_bpe_query_is_the_library_on_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = registry.QUERIES["op11_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_decodes_part_of_a_character_and_null_ids(spark):
    df = spark.createDataFrame([(1, [LIBRARY.encode_ordinary("漢")[0]], "x"), (2, None, "x"), (3, [], "x")], "k int, ids array<int>, decoded string")
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode(df).collect()}
    assert "漢".encode().startswith(got[1]) and got[1] and got[2] == got[3] == b""


def duck(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return c


@pytest.mark.parametrize("name", ["op12_resampling", "op13_filter_audit"])
def test_same_as_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck(DATA).sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def features(text, n_from, n_to):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return len(words), [" ".join(words[i : i + k]) for k in range(n_from, n_to + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n_from, n_to", [(1, 1), (1, 2), (2, 3)])
def test_weights_of_runs_of_words(spark, monkeypatch, n_from, n_to):
    """Blocks of a few words each, so that words and tuples meet across blocks."""
    monkeypatch.setattr(resampling, "BLOCK_WORDS", 30)
    rng = random.Random(5)
    some = ["alpha", "Beta", "gamma", "délta", "e1", "of", "the"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(0, 25))) for _ in range(40)] + [None, "", "...", "one", "The-the\x00THE", "of of of"]
    docs = list(enumerate(texts)) + [(3, "of the alpha"), (None, "of the alpha")]
    target = ["alpha beta gamma alpha beta", None, "of the of the"]
    s, t = Counter(), Counter()
    bucket = lambda f: zlib.crc32(f.encode()) % 50
    for _, text in docs:
        s.update(map(bucket, features(text, n_from, n_to)[1]))
    for text in target:
        t.update(map(bucket, features(text, n_from, n_to)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 50) / ((s[b] + 1) * (all_t + 50)))) for b in s}
    want = []
    for key, text in docs:
        n, own = features(text, n_from, n_to)
        want.append((key, len(own), n, sum(gain[bucket(f)] for f in own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = resampling.weights(df, spark.createDataFrame([(x,) for x in target], "text string"), n_from=n_from, n_to=n_to, buckets=50)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_the_draw_ranks_by_score_and_then_id(spark):
    rows = [(i, 20, 20 if i % 3 else 5, 10 * (i % 7)) for i in range(500)] + [(7, 20, 20, 0), (None, 30, 30, 5)]
    got = resampling.drawn(spark.createDataFrame(rows, "id long, n_features long, n_words long, weight long").repartition(5)).collect()
    assert len(got) == len(rows)

    def score(r):
        h = int(hashlib.sha256(f"2024:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        return r[3] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    enough = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-score(r), r[0] is None, r[0] or 0))
    want = [(score(r), r[0]) for r in enough[: len(enough) // 10]]
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(want) + 1))
    assert [(r["score"], r["id"]) for r in ranked] == want


def test_a_polynomial_is_what_trying_all_sets_and_orders_gives():
    rng = random.Random(3)
    counts = {m: rng.randrange(0, 9) for m in range(32)}
    p = audit.Polynomial(counts)
    for corner in range(32):
        assert p.at(corner) == sum(n for m, n in counts.items() if m & corner)
    for i in range(5):
        removed = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            removed += sum(n for m, n in counts.items() if m >> i & 1 and not m & before)
        assert p.shapley(i) == Fraction(removed, 120)


def test_text_masks_at_the_edges():
    words = [f"w{i}" for i in range(200)]
    assert audit.text_mask(" ".join(words).encode()) == 0
    assert audit.text_mask(" ".join(words[:199]).encode()) == 1
    assert audit.text_mask(" ".join(words[:100] * 2).encode()) == 0
    assert audit.text_mask(" ".join([*words[:99], words[0]] * 2).encode()) == 2
    assert audit.text_mask(b"") == 1
    assert audit.text_mask("é".encode() * 97 + b"ABC") & 4 == 0
    assert audit.text_mask("é".encode() * 96 + b"ABC") & 4
    assert all(audit.text_mask(c.encode()) & 8 for c in "#$%&*|") and not audit.text_mask(b"!@^(") & 8
    assert audit.text_mask("a b".encode()) & 1  # a space beyond ASCII is none here


def test_audit_of_repeats_nulls_and_several_labels(spark):
    docs = [(1, "same", "en"), (2, "same", "de"), (2, "same", "de"), (3, "same", None), (None, "same", "en"), (4, None, "en"), (5, "", "en"), (6, "b", "en"), (6, "b", "fr"), (7, "b", "fr")]
    labels = [(2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (99, 1, 1)]
    counts = audit.mask_counts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    e, got = 16, Counter()
    for r in counts.collect():
        got[r["part"], r["mask"], r["good"], r["toxic"]] += r["n"]
    short, cap = 1, 0
    want = {("en", short, False, False): 1 + 1 + 1 + 1, ("en", short | e, False, False): 1, ("de", short | e, True, True): 2, ("", short | e, False, False): 1, ("fr", short, False, False): 1, ("fr", short | e, False, False): 1}
    assert cap == 0 and {k: n for k, n in got.items() if n} == want


def test_no_documents_have_no_parts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audited(audit.mask_counts(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
