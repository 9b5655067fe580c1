"""Near-duplicates held against all pairs: nothing may be missed."""

import itertools

import numpy as np

from corpusloom.llm import neardup


def _kept(spark, texts):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in neardup.deduplicated(df).collect()}


def _least(texts):
    """Least id of each group, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return set(group)


def _words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def test_no_pair_at_the_edge_is_missed(spark):
    rng, texts, gone = np.random.default_rng(11), [], 0
    for k in range(120):
        one = _words(rng, 184)  # 180 shingles
        two = list(one)
        # one block: 20 shingles of each text are its own, which is 160 of 200, or 21 and just under
        block, at = (16, 17)[k % 2], int(rng.integers(4, 160))
        two[at : at + block] = _words(rng, block)
        texts += [" ".join(one), " ".join(two)]
        gone += block == 16
    least = _least(texts)
    assert len(texts) - len(least) == gone == 60
    assert _kept(spark, texts) == least


def _families(rng, families, members, block):
    """Texts of families, in any order: each member is an edit of another one, and seldom like the others."""
    texts = []
    for _ in range(families):
        family = [_words(rng, 64)]
        while len(family) < members:
            two = list(family[int(rng.integers(len(family)))])
            at = int(rng.integers(0, 64 - block))
            two[at : at + block] = _words(rng, block)
            family.append(two)
        texts += [" ".join(w) for w in family]
    return [texts[k] for k in rng.permutation(len(texts))]


def test_chains_in_crowded_buckets_are_followed(spark):
    texts = _families(np.random.default_rng(7), 30, 14, 2)
    least = _least(texts)
    assert len(least) < len(texts) / 2
    assert _kept(spark, texts) == least


def test_small_buckets_are_compared_whole(spark):
    # three and four documents: two of the three leaders are mostly the same one
    for members in (3, 4):
        texts = _families(np.random.default_rng(members), 80, members, 3)
        assert _kept(spark, texts) == _least(texts)
