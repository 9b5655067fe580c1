"""Evaluation and calibration: passages, risk and coverage, floors, success at k."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import durable
from ..functions import text as X
from ..functions.questions import Generator, questioner

PRECISION = 0.95
DOORS = {
    "synthesized": "Note: these questions were written from the passages that they are scored against, so they share words that a reader's questions won't. The sets look further apart than they are: check the floor against questions from a file before relying on it.",
    "queries-file": "Note: these questions were written by people for sections, not sampled by passage. Their weakest scores are not those of synthesized questions, so floors of the two doors don't compare: note the door beside the number.",
}
BUILT_IN_NOTE = "Note: the questions from outside are the built-in ones, which are far from any corpus and score low against all of them. The margin is too large, and the floor may let through questions just beside the corpus: measure again with such questions."
#: Dense code points of a passage that a question is written from, at least, and passages of a node.
LEAST_PASSAGE, PER_NODE = 200, 2

#: Everyday questions that no corpus of documents here answers.
PROBES = (
    "What's for dinner tonight?",
    "How do I file my taxes?",
    "Who won the football game yesterday?",
    "What's the weather this weekend?",
    "How do I unclog a kitchen sink?",
    "Best pizza place near me?",
    "How do I renew my passport?",
    "What time does the mall close?",
    "Is it going to rain in Lahore tomorrow?",
    "How do I reset my wifi router?",
    "What's a good gift for a five year old?",
    "How long do I boil an egg?",
    "Which phone should I buy this year?",
    "How do I get red wine out of a carpet?",
    "What's the capital of Australia?",
    "How much water should I drink per day?",
    "Why is my car making a clicking noise?",
    "How do I train a puppy not to bite?",
    "What movies are playing this week?",
    "How do I write a resignation letter?",
)


def probes(spark: SparkSession) -> DataFrame:
    """The built-in questions from outside the corpus."""
    return spark.createDataFrame([(i, q, False) for i, q in enumerate(PROBES)], "qid long, q string, in_corpus boolean")


def embedded_count(chunks: DataFrame) -> DataFrame:
    """Per generation how many chunks can be measured."""
    return chunks.where("embedding_status = 'embedded'").groupBy("generation").agg(F.count(F.lit(1)).alias("embedded"))


def scored(questions: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """questions (qid, q, in_corpus) with score: the similarity of the nearest chunk. A question without one fails."""
    from .search import search_many

    # embedded once, and searched apart from what follows
    asked = durable(questions.select("qid", embed(F.col("q")).alias("vector")))
    best = durable(search_many(chunks.select("chunk_id", "embedding"), asked, 1).select("qid", F.col("sim").alias("score")))
    score = F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no score for "), F.col("q"))).cast("double")).otherwise(F.col("score"))
    return questions.join(best, "qid", "left").withColumn("score", score)


def weakest(points: DataFrame, n: int = 5) -> DataFrame:
    """The n in-corpus questions of least score: they set the floor."""
    return points.where("in_corpus").orderBy("score", "qid").limit(n)


def report(points: DataFrame, generation: int | None, model: str, dim: int, door: str, precision: float = PRECISION, pinned: bool = False, probes_from: str = "built-in", skipped: int = 0) -> dict:
    """What a calibration measured, one row of figures and the weakest questions. points: qid, q, in_corpus, score."""
    m, f = margin(points).first(), floors(points, precision).first()
    value, apart = paste_value(m["lowest_in"], m["highest_out"])
    at = curve(points).where(F.col("floor").isin([x for x in (f["zero_false_abstention"], f["target_floor"]) if x is not None]))
    counts = points.agg(F.count_if("in_corpus").alias("inside"), F.count_if(~F.col("in_corpus")).alias("outside")).first()
    return {
        "generation": generation, "pinned": pinned, "model": model, "dim": dim, "door": door, "probes_from": probes_from, "skipped": skipped, "aurc": round(aurc(curve(points)).first()[0], 4), "margin": None if m["margin"] is None else round(m["margin"], 4),
        "inside": counts["inside"], "outside": counts["outside"], "paste": value, "separable": apart, "precision": precision,
        "floors": {r["floor"]: r.asDict() for r in at.collect()}, "zero": f["zero_false_abstention"], "target": f["target_floor"], "weakest": [(r["score"], r["q"]) for r in weakest(points).collect()],
    }


def rendered(r: dict) -> str:
    """A report as text, with what its door and its questions from outside are worth; a floor to paste only where the questions are apart."""
    served = "unknown" if r["generation"] is None else f"{r['generation']} ({'pinned' if r['pinned'] else 'served'})"
    out = [f"generation {served}, model {r['model']}/d{r['dim']}, questions: {r['door']}, from outside: {r['probes_from']}", f"AURC = {r['aurc']} (lower is better)"]
    out.append(f"margin = {'none' if r['margin'] is None else format(r['margin'], '.3f')} over {r['inside']} inside and {r['outside']} outside")
    if r["skipped"]:
        out.append(f"{r['skipped']} passages got no question")
    for name, floor in (("no question refused", r["zero"]), (f"precision {r['precision']}", r["target"])):
        if floor is not None:
            out.append(f"{name}: floor {floor:.3f}, coverage {r['floors'][floor]['coverage']:.3f}, risk {r['floors'][floor]['risk']:.3f}")
    out += ["weakest questions:", *(f"  {score:.3f}  {q}" for score, q in r["weakest"])]
    out.append(DOORS[r["door"]])
    if r["probes_from"] == "built-in":
        out.append(BUILT_IN_NOTE)
    out.append(f"vector_floor: {r['paste']:.3f}" if r["separable"] else "vector_floor: uncalibrated  # questions inside and outside overlap: no floor tells them apart")
    return "\n".join(out) + "\n"


def synthesized(sample: DataFrame, generator: Generator, content: str = "content") -> tuple[DataFrame, int]:
    """A question (q) for each passage, and how many passages got none. Each passage is asked about once, whatever reads the result."""
    asked = durable(sample.select(X.normalized_query(questioner(generator)(F.col(content))).alias("q")))
    return asked.where("q <> ''"), asked.where("q = ''").count()


def calibrated(chunks: DataFrame, inside: DataFrame | None, embed: Callable[[Column], Column], outside: DataFrame | None = None, model: str = "fake", dim: int = 64, generation: int | None = None, generator: Generator | None = None, denied: DataFrame | None = None, per_node: int = PER_NODE, least: int = LEAST_PASSAGE, precision: float = PRECISION) -> dict:
    """The whole run: questions inside and outside (q; the built-in ones by default) scored against the chunks, and the report.

    inside: questions from a file. Without them they are synthesized from a sample of the chunks, which
    then have the columns that `passages` demands, by a generator. chunks of several generations are
    measured one generation at a time: the one named, else the newest.
    """
    pinned = generation is not None
    if "embedding_status" in chunks.columns:
        chunks = chunks.where("embedding_status = 'embedded'")
    if "generation" in chunks.columns:
        generation = chunks.agg(F.max("generation")).first()[0] if generation is None else generation
        chunks = chunks.where(F.col("generation") == generation)
    if chunks.isEmpty():
        raise ValueError(f"no embedded chunks in generation {generation}: build it first")
    skipped, door = 0, "queries-file"
    if inside is None:
        door = "synthesized"
        if generator is None:
            raise ValueError("questions are synthesized by a generator: name one, or give questions from a file")
        sample = durable(passages(chunks, denied, per_node, least))
        if sample.isEmpty():
            raise ValueError("no passage is long enough to ask about: lower least")
        inside, skipped = synthesized(sample, generator)
    plain = lambda df: df.select(X.normalized_query(F.col("q")).alias("q")).where("q <> ''")
    own = plain(inside).select((F.lit(1 << 32) + F.monotonically_increasing_id()).alias("qid"), "q", F.lit(True).alias("in_corpus"))
    other = probes(inside.sparkSession) if outside is None else plain(outside).select(F.monotonically_increasing_id().alias("qid"), "q", F.lit(False).alias("in_corpus"))
    # numbered once, and read several times
    points = durable(scored(durable(own.unionByName(other)), chunks, embed))
    return report(points, generation, model, dim, door, precision, pinned, "built-in" if outside is None else "provided", skipped)


def against_baseline(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """measured and baseline (metric, value; baseline: higher_is_better): the difference, and whether it got worse."""
    both = measured.join(baseline.select("metric", F.col("value").alias("before"), "higher_is_better"), "metric")
    delta = F.col("value") - F.col("before")
    return both.withColumn("delta", delta).withColumn("worse", F.when(F.col("higher_is_better"), delta < 0).otherwise(delta > 0))


def passages(chunks: DataFrame, denied: DataFrame | None, per_node: int = PER_NODE, least: int = LEAST_PASSAGE, node: str = "node_id", content: str = "content") -> DataFrame:
    """The per_node passages of each node that come first by MD5 of their content, so that not only openings are asked about; n from 1.

    Only embedded prose of published nodes that aren't denied (node_id), of at least so many code points
    besides white space. chunks must have the columns that say so: a rule is never left out for want of one.
    """
    rules = {"embedding_status": "embedded", "source_type": "prose", "status": "published"}
    absent = sorted({*rules, node, content, "chunk_id"} - set(chunks.columns))
    if absent:
        raise ValueError(f"passages need {', '.join(absent)}")
    for column, value in rules.items():
        chunks = chunks.where(F.col(column) == value)
    chunks = chunks.where(X.dense_length(F.col(content)) >= least)
    if denied is not None:
        chunks = chunks.join(denied.select(F.col("node_id").alias(node)).distinct(), node, "left_anti")
    w = Window.partitionBy(node).orderBy(F.md5(content), "chunk_id")
    return chunks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node)


def by_score(points: DataFrame) -> DataFrame:
    """Points (score, in_corpus) summed by score: what all else works on."""
    return points.groupBy("score").agg(F.count_if("in_corpus").alias("inside"), F.count_if(~F.col("in_corpus")).alias("outside"))


def curve(points: DataFrame, buckets: int = 1024) -> DataFrame:
    """For every distinct score as floor: served, coverage, risk, false_abstention, precision.

    A point is served at or above the floor. Running counts go over score ranges: the ranges' totals
    are at most `buckets` rows, the rest is summed within a range.
    """
    sums = by_score(points)
    ends = sums.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("inside").alias("all_in"), F.sum("outside").alias("all_out"))
    span = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("hi") - F.col("score")) / (F.col("hi") - F.col("lo")) * (buckets - 1))).otherwise(F.lit(0))
    ranged = sums.crossJoin(F.broadcast(ends)).withColumn("_b", span.cast("int"))  # ends: one row
    totals = ranged.groupBy("_b").agg(F.sum("inside").alias("_in"), F.sum("outside").alias("_out"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    offsets = totals.select("_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_in"), F.coalesce(F.sum("_out").over(before), F.lit(0)).alias("_out"))
    upto = Window.partitionBy("_b").orderBy(F.col("score").desc())
    rows = ranged.join(F.broadcast(offsets), "_b")
    rows = rows.withColumn("tp", F.col("_in") + F.sum("inside").over(upto)).withColumn("fp", F.col("_out") + F.sum("outside").over(upto))
    served = F.col("tp") + F.col("fp")
    return rows.select(
        F.col("score").alias("floor"),
        served.alias("served"),
        (served / (F.col("all_in") + F.col("all_out"))).alias("coverage"),
        F.when(served > 0, F.col("fp") / served).otherwise(0.0).alias("risk"),
        F.when(F.col("all_in") > 0, (F.col("all_in") - F.col("tp")) / F.col("all_in")).otherwise(0.0).alias("false_abstention"),
        F.when(served > 0, F.col("tp") / served).otherwise(0.0).alias("precision"),
    )


def aurc(curve_: DataFrame, ranges: int = 256) -> DataFrame:
    """Area under risk over coverage, by trapezoids from (0, 0). The curve has a row for each distinct score.

    Each range of coverage sums its own trapezoids; only the ranges' ends, at most `ranges` rows, meet in one task.
    """
    part = F.least(F.floor(F.col("coverage") * ranges), F.lit(ranges - 1)).cast("int")
    rows = curve_.select("coverage", "risk", part.alias("_r"))
    w = Window.partitionBy("_r").orderBy("coverage")
    step = rows.withColumn("_c", F.lag("coverage").over(w)).withColumn("_k", F.lag("risk").over(w))
    inner = (F.col("coverage") - F.col("_c")) * (F.col("risk") + F.col("_k")) / 2
    ends = step.groupBy("_r").agg(F.sum(inner).alias("area"), F.min(F.struct("coverage", "risk")).alias("a"), F.max(F.struct("coverage", "risk")).alias("b"))
    before = F.lag("b").over(Window.orderBy("_r"))  # at most `ranges` rows
    gap = ends.select(F.coalesce("area", F.lit(0.0)).alias("area"), "a", before.alias("p"))
    between = (F.col("a.coverage") - F.coalesce("p.coverage", F.lit(0.0))) * (F.col("a.risk") + F.coalesce("p.risk", F.lit(0.0))) / 2
    return gap.agg(F.sum(F.col("area") + between).alias("aurc"))


def floors(points: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The floor that abstains from no in-corpus question, and that of most coverage at the precision (the highest of equals)."""
    zero = points.where("in_corpus").agg(F.min("score").alias("zero_false_abstention"))
    best = curve(points).where(F.col("precision") >= precision).agg(F.max(F.struct("coverage", "floor")).alias("b")).select(F.col("b.floor").alias("target_floor"))
    return zero.crossJoin(F.broadcast(best))  # one row each


def paste_value(lowest_in: float, highest_out: float | None) -> tuple[float, bool]:
    """The floor to declare and whether the sets are apart: the middle to three digits, half to even on the exact value.

    Where the middle, so rounded, leaves the gap, or where there is none, the weakest in-corpus score.
    """
    if highest_out is None or highest_out >= lowest_in:
        return lowest_in, False
    middle = float(round(Decimal((highest_out + lowest_in) / 2), 3))
    return (middle if highest_out < middle <= lowest_in else lowest_in), True


def margin(points: DataFrame) -> DataFrame:
    return points.agg(F.min(F.when(F.col("in_corpus"), F.col("score"))).alias("lowest_in"), F.max(F.when(~F.col("in_corpus"), F.col("score"))).alias("highest_out")).withColumn("margin", F.col("lowest_in") - F.col("highest_out"))


def overlapping(points: DataFrame) -> DataFrame:
    """Out-of-corpus questions that score no less than the weakest in-corpus one."""
    low = points.where("in_corpus").agg(F.min("score").alias("_low"))
    return points.where("not in_corpus").crossJoin(F.broadcast(low)).where(F.col("score") >= F.col("_low")).drop("_low")  # one row


def success_at(hits: DataFrame, expected: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of queries whose expected node is among the first k distinct nodes. hits: qid, node_id, r, and the expected node."""
    first = hits.groupBy("qid", expected, "node_id").agg(F.min("r").alias("r"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("r")))
    best = place.groupBy("qid").agg(F.min(F.when(F.col("node_id") == F.col(expected), F.col("place"))).alias("place"))
    return best.agg(F.count(F.lit(1)).alias("queries"), *[(F.count_if(F.col("place") <= k) / F.count(F.lit(1))).alias(f"success_at_{k}") for k in ks])


def success_by_kind(asked: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """kind, queries and at_k: how many questions of a kind have their node among the first k distinct nodes.

    asked: qid, kind, expected; hits: qid, node_id, r. A question without hits counts as one that failed.
    """
    first = hits.groupBy("qid", "node_id").agg(F.min("r").alias("r"))
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("r", "node_id")))
    own = asked.select("qid", "kind", "expected").join(place, "qid", "left")
    best = own.groupBy("qid", "kind").agg(F.min(F.when(F.col("node_id") == F.col("expected"), F.col("place"))).alias("place"))
    return best.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col("place") <= k).alias(f"at_{k}") for k in ks])


def leaks(asked: DataFrame, hits: DataFrame, unwanted: DataFrame) -> DataFrame:
    """queries, and leaked: how many of them got one of the unwanted nodes (node_id), such as pages of links."""
    got = hits.join(unwanted.select("node_id").distinct(), "node_id", "left_semi").select("qid").distinct().withColumn("_got", F.lit(True))
    return asked.select("qid").distinct().join(got, "qid", "left").agg(F.count(F.lit(1)).alias("queries"), F.count("_got").alias("leaked"))


def answered_outside(outside: DataFrame, hits: DataFrame, abstained: DataFrame) -> DataFrame:
    """probes, and answered: how many questions from outside (qid) got hits without abstention (qid)."""
    got = hits.select("qid").distinct().join(abstained.select("qid"), "qid", "left_anti").withColumn("_got", F.lit(True))
    return outside.select("qid").distinct().join(got, "qid", "left").agg(F.count(F.lit(1)).alias("probes"), F.count("_got").alias("answered"))
