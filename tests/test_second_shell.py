"""The second shell's reading order against folders flattened one by one, and the guard on hits."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import projections as P
from corpusloom.operators import search as S


def flat(pages, prefix=""):
    """Pages (path: url and order) of a folder in order, and the key by which the folder stands among others."""
    here = [p for p in pages if p.startswith(prefix)]
    index = prefix + "index.md" if prefix and prefix + "index.md" in pages else None
    items = [(pages[p][1], pages[p][0], [p]) for p in here if "/" not in p[len(prefix) :] and p != index]
    for name in {p[len(prefix) :].split("/")[0] for p in here if "/" in p[len(prefix) :]}:
        items.append(flat(pages, f"{prefix}{name}/"))
    rest = [p for _, _, some in sorted(items, key=lambda x: x[:2]) for p in some]
    if index:
        return pages[index][1], pages[index][0], [index, *rest]
    return math.inf, pages[rest[0]][0] if rest else "", rest


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_that_of_folders_flattened(spark, seed):
    rng, pages = random.Random(seed), {"index.md": ("/docs", 3.0)}
    for _ in range(120):
        folder = "/".join(rng.choice(("a", "a-b", "hr", "z")) for _ in range(rng.randrange(5)))
        name = rng.choice(("index", "hr-notes", "p1", "p2", "q"))
        path = f"{folder}/{name}.md".lstrip("/")
        stem = path.removesuffix(".md")
        url = "/docs/" + (stem.removesuffix("/index") if stem.endswith("/index") else stem)
        pages.setdefault(path, (url if path != "index.md" else "/docs", rng.choice((math.inf, math.inf, 1.0, -2.0, 2.5))))
    rows = spark.createDataFrame([(p, u, None if o == math.inf else o) for p, (u, o) in pages.items()], "path string, url string, order double")
    got = [r["path"] for r in P.in_url_order(rows).orderBy("sort_key").collect()]
    assert got == flat(pages)[2]


def test_no_folders_and_no_pages(spark):
    rows = spark.createDataFrame([("b.md", "/docs/b", None), ("a.md", "/docs/a", None), ("c.md", "/docs/c", 1.0)], "path string, url string, order double")
    assert [r["path"] for r in P.in_url_order(rows).orderBy("sort_key").collect()] == ["c.md", "a.md", "b.md"]
    assert P.in_url_order(rows.limit(0)).count() == 0


def test_hits_of_another_shape_are_refused(spark):
    row = spark.range(1).select(*[F.lit("x").alias(c) for c in S.HIT if c != "top_vec_sim"], F.lit(None).cast("double").alias("top_vec_sim"))
    assert S.projected(row.select(*reversed(S.HIT))).columns == list(S.HIT) and S.projected(row).first()["top_vec_sim"] is None
    for bad in (row.drop("slug"), row.withColumn("more", F.lit(1)), row.withColumn("top_vec_sim", F.lit("0.5"))):
        with pytest.raises(TypeError):
            S.projected(bad)
    with pytest.raises(Exception, match="no number"):
        S.projected(row.withColumn("top_vec_sim", F.lit(float("nan")))).collect()
