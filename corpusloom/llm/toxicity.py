"""Toxicity: a convolutional text classifier trained in numpy (operator 2).

Words (runs of letters and digits, ASCII lower-cased) have hashed embeddings: one row for the word
and one for its first bytes. Filters of widths 1, 2 and 3 run over the whole text, each keeps its
largest value, and a logistic layer makes the score. The first coordinate of a row starts as the
smoothed log-odds of its bucket in the labelled texts; everything is then learned by Adam on the logistic
loss. Only rows whose CRC-32 of doc_id (as text) is not divisible by 5 are learned from; of these
the remainder 1 calibrates: for each language the threshold between the classes that errs least
there, or that of all languages together where a language has fewer than ENOUGH rows.

learned() takes all of them: their words are buckets in a table, counts are summed by bucket, and in
each epoch shards of about SHARD_ROWS rows learn in their tasks, whose models are averaged piece by
piece. The driver holds one model. Scoring is of every text as a whole, in the tasks that read it; no
shuffle. train() fits a bounded sample in one process (at most MOST_TOXIC and MOST_CLEAN documents by
hash of doc_id, and MOST_WORDS words); no query uses it.

Defined cases: a null text is empty; a text without words has the score of no evidence. Without
labelled rows of both classes the score is 0 for all. Of several labels for a document the largest
counts; rows with a null doc_id or label aren't learned from. Equal texts have equal scores. The
score never sees labels, lang, source or doc_id; the threshold sees lang.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import blocks, buffers, dropped, spread, table, text_batches, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 12
PREFIX_BYTES = 4
MOST_TOXIC, MOST_CLEAN, MOST_WORDS = 2500, 4500, 6_000_000
EPOCHS, BATCH, RATE = 3, 48, 0.01
#: A minibatch ends at so many words, too.
BATCH_WORDS = 1 << 20
#: Rows of a shard that learns by itself in an epoch, until there are MOST_SHARDS; beyond, shards grow. Slices of a model that are averaged apart.
SHARD_ROWS, MOST_SHARDS, PIECES = 16_384, 256, 64
#: What word_ids() adds to the two buckets of a word.
OFFSETS = np.array([1, BUCKETS + 1], np.int32)
ENOUGH = 40
#: Bytes that end a word: ASCII other than letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two embedding rows for every word, and the first word of each text (one entry more than texts)."""
    data, offsets = buffers(column)
    text, starts, ends, first = hashing.word_spans(data, offsets, APART)
    whole = hashing.span_hashes(text, starts, ends)
    begin = hashing.span_hashes(text, starts, np.minimum(ends, starts + PREFIX_BYTES))
    rows = np.stack([whole % np.uint64(BUCKETS), np.uint64(BUCKETS) + begin % np.uint64(BUCKETS)], axis=1)
    return rows.astype(np.int32) + 1, first


@dataclass
class Model:
    """Weights, at most a few MB whatever the corpus. Row 0 of the embeddings is padding."""

    rows: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5
    trained: bool = True

    def spread_out(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all words, with padding after every text, and where texts start and end."""
        pad = max(WIDTHS) - 1
        counts = np.diff(first)
        starts = first[:-1] + pad * np.arange(len(counts))
        place = np.arange(len(ids)) + pad * np.repeat(np.arange(len(counts)), counts)
        x = np.zeros((len(ids) + pad * len(counts) + pad, DIM), np.float32)
        x[place] = self.rows[ids[:, 0]] + self.rows[ids[:, 1]]
        return x, starts, starts + counts

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' values at every place."""
        n = len(x) - max(WIDTHS) + 1
        return [sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters]

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        x, starts, ends = self.spread_out(ids, first)
        some = ends > starts
        out = np.zeros((len(starts), len(WIDTHS) * FILTERS), np.float32)
        if some.any():
            edges = np.stack([starts[some], ends[some]], axis=1).ravel()
            for k, y in enumerate(self.responses(x)):
                y = np.concatenate([y, np.zeros((1, FILTERS), np.float32)])
                most = np.maximum.reduceat(y, np.minimum(edges, len(y) - 1))[::2]
                out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(most + self.bias[k * FILTERS : (k + 1) * FILTERS], 0)
        return out

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(first) - 1)
        logits = self.pooled(ids, first).astype(np.float64) @ self.out.astype(np.float64) + self.shift
        return np.round(1 / (1 + np.exp(-np.clip(logits, -30, 30))), 6)


def _start(seen: np.ndarray, n: np.ndarray) -> Model:
    """A model whose first coordinate says how much more often a bucket is in toxic texts.

    seen: by class and bucket the texts that have it; n: by class all texts.
    """
    rng = np.random.default_rng(7)
    rate = np.log((seen[1] + 0.02 * n[1]) / (n[1] * 1.02)) - np.log((seen[0] + 0.02 * n[0]) / (n[0] * 1.02))
    rows = rng.normal(0, 0.05, (2 * BUCKETS + 1, DIM)).astype(np.float32)
    rows[:, 0] = np.clip(rate, -2, 3)
    rows[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] += rng.uniform(0, 0.5, (len(f), FILTERS))
    total = len(WIDTHS) * FILTERS
    return Model(rows, filters, np.zeros(total, np.float32), rng.uniform(0, 0.3, total).astype(np.float32), -1.0)


class Adam:
    """Steps over minibatches, in place; of a pooled filter only the words at its largest value learn."""

    def __init__(self, model: Model, n: np.ndarray) -> None:
        self.model = model
        self.parts = [model.rows, *model.filters, model.bias, model.out]
        self.first_moment, self.second_moment = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        share = n / max(n.sum(), 1)
        self.weight = 0.5 / np.maximum(share, 1e-9)  # by class
        self.touched = np.zeros(len(model.rows), bool)
        self.steps = 0

    def step(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        model = self.model
        flat = np.concatenate(ids)
        first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        x, starts, ends = model.spread_out(flat, first)
        ys = model.responses(x)
        best = np.zeros((len(ids), len(WIDTHS), FILTERS), np.int64)
        value = np.zeros((len(ids), len(WIDTHS) * FILTERS), np.float32)
        for d, (s, e) in enumerate(zip(starts, ends)):
            if e > s:
                for k, y in enumerate(ys):
                    best[d, k] = s + y[s:e].argmax(axis=0)
                    value[d, k * FILTERS : (k + 1) * FILTERS] = y[best[d, k], np.arange(FILTERS)]
        some = (ends > starts)[:, None]
        hidden = np.where(some, np.maximum(value + model.bias, 0), 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30)))
        error = ((p - labels) * self.weight[labels] / len(ids)).astype(np.float32)
        back = np.where(hidden > 0, error[:, None] * model.out, 0)
        grads = [np.zeros_like(f) for f in model.filters]
        token = np.full(len(x), -1, np.int64)
        pad = max(WIDTHS) - 1
        token[np.arange(len(flat)) + pad * np.repeat(np.arange(len(ids)), np.diff(first))] = np.arange(len(flat))
        touched, amounts = [], []
        for k, f in enumerate(model.filters):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(len(f)):
                here = best[:, k] + j  # texts x filters
                grads[k][j] = np.einsum("dfe,df->ef", x[here], g)
                words = token[here]
                live = (words >= 0) & (g != 0)
                touched.append(words[live])
                amounts.append((g[:, :, None] * f[j].T[None])[live])
        words, amount = np.concatenate(touched), np.concatenate(amounts)
        rows = flat[words]
        used, place = np.unique(rows, return_inverse=True)
        self.touched[used] = True
        change = np.zeros((len(used), DIM), np.float32)
        np.add.at(change, place.reshape(rows.shape)[:, 0], amount)
        np.add.at(change, place.reshape(rows.shape)[:, 1], amount)
        self.steps += 1
        model.shift -= RATE * float(error.sum())
        for i, g in enumerate([change, *grads, back.sum(axis=0), hidden.T @ error]):
            where = used if i == 0 else slice(None)
            self.first_moment[i][where] = 0.9 * self.first_moment[i][where] + 0.1 * g
            self.second_moment[i][where] = 0.999 * self.second_moment[i][where] + 0.001 * g * g
            rate = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            self.parts[i][where] -= rate * self.first_moment[i][where] / (np.sqrt(self.second_moment[i][where]) + 1e-8)


def fit(ids: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from texts in memory."""
    seen = np.zeros((2, 2 * BUCKETS + 1))
    for i, y in zip(ids, labels):
        seen[y, np.unique(i)] += 1
    n = np.bincount(labels, minlength=2)
    model, rng = _start(seen, n), np.random.default_rng(11)
    learner = Adam(model, n)
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            learner.step([ids[i] for i in own], labels[own])
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the fewest errors; of equal ones the middle of the widest gap."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + (np.sum(1 - y) - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[0.0], s, [1.0]])
    gaps = np.diff(edges)
    gaps[1:-1][s[1:] == s[:-1]] = -1  # no threshold between equal scores
    k = max(np.flatnonzero(errors == errors[gaps >= 0].min()), key=lambda k: gaps[k])
    return float((edges[k] + edges[k + 1]) / 2)


def best_cut(scores: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """best_threshold() of rising scores that stand once each, with the number of texts of either class."""
    errors = np.concatenate([[0], np.cumsum(bad)]) + good.sum() - np.concatenate([[0], np.cumsum(good)])
    edges = np.concatenate([[0.0], scores, [1.0]])
    gaps = np.diff(edges)
    k = max(np.flatnonzero(errors == errors.min()), key=lambda k: gaps[k])
    return float((edges[k] + edges[k + 1]) / 2)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, bad (0, 1), lang, cal and words (buckets as bytes) of every labelled document that isn't held out."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("bad"))
    # labels meet texts by a shuffle: sent to all tasks they would go through the driver
    rows = docs.select("doc_id", "text", "lang").where(~held_out()).join(marked.hint("shuffle_hash"), "doc_id")
    # of rows that repeat an id the first by text, whatever the tasks
    rows = rows.groupBy("doc_id", "bad").agg(F.min(F.struct("text", "lang")).alias("_m")).select("doc_id", "bad", "_m.text", "_m.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                ids, first = word_ids(part.column("text"))
                ids = (ids - OFFSETS).astype(np.uint16)
                found = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("bad"), part.column("lang"), pa.array(found, pa.binary())], ["doc_id", "bad", "lang", "words"])

    fields = [*(rows.schema[c] for c in ("doc_id", "bad", "lang")), T.StructField("words", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(fields)).withColumn("cal", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


def unpacked(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint16).reshape(-1, 2).astype(np.int32) + OFFSETS


def counted(rows: DataFrame) -> np.ndarray:
    """By class and bucket the texts that have it: summed in the tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2 * BUCKETS + 1), np.int64)
        for batch in batches:
            for y, words in zip(batch.column("bad").to_pylist(), batch.column("words")):
                seen[y, np.unique(unpacked(words.as_py()))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "clean", "toxic"])

    sums = rows.select("bad", "words").mapInArrow(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = np.zeros((2, 2 * BUCKETS + 1))
    for r in sums.collect():  # 2 * BUCKETS rows at most
        seen[:, r["bucket"]] = r["clean"], r["toxic"]
    return seen


def epoch(rows: DataFrame, model: Model, n: np.ndarray, shards: int, number: int) -> Model:
    """The model after one pass over all rows.

    Each shard of the rows (by hash of doc_id) learns from the same model, in the order of another hash.
    Then models are averaged, an embedding over the shards that changed it, in PIECES of a few KB a shard.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def learned_from(texts: Iterator[tuple[int, int, bytes]], shard: int) -> pa.RecordBatch:
        start = shared.value
        model = replace(start, rows=start.rows.copy(), filters=[f.copy() for f in start.filters], bias=start.bias.copy(), out=start.out.copy())
        learner, many = Adam(model, n), 0
        ids, labels, size = [], [], 0
        for _, y, words in texts:
            ids.append(unpacked(words))
            labels.append(y)
            many, size = many + 1, size + len(ids[-1])
            if len(ids) == BATCH or size > BATCH_WORDS:
                learner.step(ids, np.array(labels))
                ids, labels, size = [], [], 0
        if ids:
            learner.step(ids, np.array(labels))
        out = []
        for k in range(PIECES):
            at = np.arange(k, len(model.rows), PIECES)
            at = at[learner.touched[at]]
            out.append((shard, k, len(at), at.astype(np.int32).tobytes(), model.rows[at].tobytes()))
        rest = np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.out, [model.shift]])
        out.append((shard, PIECES, many, b"", rest.astype(np.float64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "piece", "n", "at", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for batch in batches for t in zip(batch.column("shard").to_pylist(), batch.column("bad").to_pylist(), (w.as_py() for w in batch.column("words"))))
        for shard, own in groupby(texts, key=lambda t: t[0]):
            yield learned_from(own, shard)

    def merged(pieces: pa.Table) -> pa.Table:
        piece = pieces.column("piece")[0].as_py()
        each = sorted(pieces.to_pylist(), key=lambda r: r["shard"])
        if piece == PIECES:
            values = sum(r["n"] * np.frombuffer(r["values"]) for r in each) / sum(r["n"] for r in each)
            return pa.table({"piece": pa.array([piece], pa.int32()), "at": pa.array([b""], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})
        places = len(range(piece, 2 * BUCKETS + 1, PIECES))
        sums, times = np.zeros((places, DIM)), np.zeros(places)
        for r in each:
            at = np.frombuffer(r["at"], np.int32) // PIECES
            sums[at] += np.frombuffer(r["values"], np.float32).reshape(-1, DIM)
            times[at] += 1
        at = np.flatnonzero(times)
        return pa.table({"piece": pa.array([piece], pa.int32()), "at": pa.array([(at * PIECES + piece).astype(np.int32).tobytes()], pa.binary()), "values": pa.array([(sums[at] / times[at, None]).astype(np.float32).tobytes()], pa.binary())})

    dealt = rows.select("doc_id", "bad", "words", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(F.lit(number), "doc_id").alias("_order"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "_order", "doc_id").select("shard", "bad", "words")
    pieces = dealt.mapInArrow(run, "shard int, piece int, n long, at binary, values binary")
    model = replace(model, rows=model.rows.copy())
    for r in pieces.groupBy("piece").applyInArrow(merged, "piece int, at binary, values binary").collect():  # one model
        if r["piece"] < PIECES:
            model.rows[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["values"], np.float32).reshape(-1, DIM)
        else:
            rest = np.frombuffer(r["values"])
            model.shift = float(rest[-1])
            rest, sizes = rest.astype(np.float32), [*(f.size for f in model.filters), model.bias.size]
            *filters, bias, out = np.split(rest[:-1], np.cumsum(sizes))
            model.filters = [v.reshape(f.shape) for v, f in zip(filters, model.filters)]
            model.bias, model.out = bias, out
    shared.destroy()
    return model


def thresholds(rows: DataFrame, model: Model) -> tuple[float | None, dict[str, float]]:
    """The threshold of all languages together, and of each that has ENOUGH rows, from all rows' scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks(batch, "words"):
                ids = [unpacked(w.as_py()) for w in part.column("words")]
                scores = model.scores(np.concatenate(ids), np.cumsum([0, *(len(i) for i in ids)]))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("bad"), pa.array(scores)], ["lang", "bad", "score"])

    def cut(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("score")
        score, bad, good = (own.column(c).to_numpy() for c in ("score", "n_bad", "n_good"))
        both = bad.sum() > 0 and good.sum() > 0
        best = best_cut(score, bad, good) if both and (key[0].as_py() or bad.sum() + good.sum() >= ENOUGH) else None
        return pa.table({"every": pa.array([key[0].as_py()], pa.bool_()), "lang": pa.array([key[1].as_py()], pa.string()), "best": pa.array([best], pa.float64())})

    found = rows.select("lang", "bad", "words").mapInArrow(run, "lang string, bad int, score double")
    # a row for each language and score; scores have six digits, so a group has 1,000,001 rows at most
    found = found.groupBy("lang", "score").agg(F.sum("bad").alias("n_bad"), F.sum(1 - F.col("bad")).alias("n_good"))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("every"), F.col("lang")), F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"))))
    found = found.select(kinds.alias("_k"), "score", "n_bad", "n_good").select("_k.*", "score", "n_bad", "n_good").groupBy("every", "lang", "score").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"))
    got = found.groupBy("every", "lang").applyInArrow(cut, "every boolean, lang string, best double").where("best is not null").collect()  # a row a language
    shared.destroy()
    return next((r["best"] for r in got if r["every"]), None), {r["lang"]: r["best"] for r in got if not r["every"] and r["lang"] is not None}


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents (doc_id, text, lang) that aren't held out."""
    text_batches(docs.sparkSession)
    rows = written(labelled_words(docs, labels), "toxicity-words")
    n = np.zeros(2, np.int64)
    for r in rows.where("not cal").groupBy("bad").count().collect():
        n[r["bad"]] = r["count"]
    if not n.all():
        dropped(rows)
        return Model(np.zeros((1, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, trained=False)
    learn = rows.where("not cal")
    model = _start(counted(learn), n)
    shards = min(MOST_SHARDS, -(-int(n.sum()) // SHARD_ROWS))
    for number in range(EPOCHS):
        model = epoch(learn, model, n, shards, number)
    best, model.thresholds = thresholds(rows.where("cal"), model)
    if best is not None:
        model.threshold = best
    dropped(rows)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of them, fitted in one process: a quick look. No query uses it."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marked.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(marked.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    # MOST_TOXIC + MOST_CLEAN rows at most
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), "doc_id")
    # of rows that repeat an id the first by text, whatever the tasks
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("_m")).select("doc_id", "_m.text", "_m.lang", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                ids, first = word_ids(part.column("text"))
                found = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("lang"), pa.array(found, pa.binary())], ["doc_id", "toxic", "lang", "ids"])

    fields = [*(rows.schema[c] for c in ("doc_id", "toxic", "lang")), T.StructField("ids", T.BinaryType())]
    got = rows.mapInArrow(run, T.StructType(fields)).withColumn("_order", F.xxhash64("doc_id")).withColumn("cal", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    got = written(got, "toxicity-sample")
    # the lengths come first, a few bytes a document, so that of the words no more than MOST_WORDS do;
    # in an order that doesn't depend on the tasks, as far as the words go
    sizes = got.select("_order", "doc_id", F.floor(F.length("ids") / 8).alias("n")).collect()
    chosen, words = [], 0
    for r in sorted(sizes, key=lambda r: (r["_order"], r["doc_id"])):
        if words + r["n"] <= MOST_WORDS:
            words += r["n"]
            chosen.append(r["doc_id"])
    ids, y, lang, cal = [], [], [], []
    some = got.where(F.col("doc_id").isin(chosen)) if len(chosen) < len(sizes) else got
    for r in sorted(some.collect(), key=lambda r: (r["_order"], r["doc_id"])):
        ids.append(np.frombuffer(bytes(r["ids"]), np.int32).reshape(-1, 2))
        y.append(int(r["toxic"] > 0))
        lang.append(r["lang"])
        cal.append(r["cal"])
    dropped(got)
    y, cal = np.array(y, np.int64), np.array(cal, bool)
    learn = np.flatnonzero(~cal)
    if len(learn) == 0 or len(set(y[learn])) < 2:
        return Model(np.zeros((1, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, trained=False)
    model = fit([ids[i] for i in learn], y[learn])
    own = np.flatnonzero(cal)
    if len(own):
        scores = np.concatenate([model.scores(ids[i], np.array([0, len(ids[i])])) for i in own])
        if len(set(y[own])) == 2:
            model.threshold = best_threshold(scores, y[own])
        for name in {lang[i] for i in own if lang[i] is not None}:
            same = np.array([lang[i] == name for i in own])
            if same.sum() >= ENOUGH and len(set(y[own][same])) == 2:
                model.thresholds[name] = best_threshold(scores[same], y[own][same])
    return model


def scored(df: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """df with score, threshold (its language's) and toxic_flag, which replace columns of these names."""
    text_batches(df.sparkSession)
    df = df.drop("score", "threshold", "toxic_flag")
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("toxic_flag", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in blocks(batch, text):
                scores = model.scores(*word_ids(part.column(text)))
                names = part.column(lang).to_pylist() if lang else [None] * part.num_rows
                limits = np.array([model.thresholds.get(x, model.threshold) for x in names])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(limits), pa.array((scores >= limits) & model.trained)], schema.names)

    return df.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learned(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = scored(spread(docs), model).drop("text")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic_flag")
