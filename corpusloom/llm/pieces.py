"""SentencePiece encoding and decoding over a relational lattice (operator 7).

A text is escaped (a space is U+2581, one stands before the text) and cut into words that no piece
crosses: spaces and what follows them, line ends apart. For a table of words the lattice is
relational: substrings of bounded length are exploded and equi-joined to the piece table, edges are
grouped by word, and Spark's higher-order aggregate folds them into a segmentation. Two folds:

* viterbi: the path of highest score, for unigram models;
* merges: for BPE models. A piece's score there is its merge rank, no log-probability, and the path
  of highest sum isn't what such a model means. The fold starts from single characters and, step by
  step, takes the lattice edge of highest score that spans exactly two present symbols, the leftmost
  of equal ones. That gives SentencePiece's own ids.

The corpus has far too many words, and far too many uses of them, for a join of every use: see the
README's figures for encode_by_joins(). So encode() lets Spark fold the DICTIONARY_WORDS commonest
words of all texts into a dictionary, at most that large whatever the corpus; tasks read it and fold
words it lacks by the same rule. Which words it holds changes the speed, never an id. Tasks work on
Arrow buffers: they cut texts into words by their bytes, number a block's different words, and cut
those that the dictionary lacks into parts wherever no piece of the model holds the two bytes that
meet. No merge crosses such a place, so a word's ids are its parts', one after another, and each part
is folded once.

Defined cases: a null text has null ids, an empty one none. Characters without a piece become the
byte pieces of their UTF-8. Decoding drops one leading space and turns U+2581 into spaces, so it
gives back every text that has no U+2581 itself. Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, spread, table, text_batches

SPACE = "▁"
#: A word: spaces and what follows them, or line ends. No piece holds a space after another character, or a line end.
WORD = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+"
#: Words of the dictionary, their characters at most, and rows of counts that a task holds before it adds them up and passes them on.
DICTIONARY_WORDS, DICTIONARY_CHARS, COUNTED = 12_000, 24, 500_000
#: Parts of words that a task remembers, and characters of a part worth it.
REMEMBERED, MOST_REMEMBERED_CHARS = 300_000, 64
#: Words that are folded at once.
MATRIX_WORDS = 4096
#: Bytes of text that are cut and numbered at once, besides a longer single text.
CUT_BYTES = 1 << 20
#: Behind every rank: two symbols that make no piece.
NO_RANK = np.iinfo(np.int32).max



def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """A piece table. Its size is the model's, whatever the corpus."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_base: int
    unigram: bool
    longest: int

    def by_piece(self) -> dict[str, tuple[float, int]]:
        return {p: (score, i) for p, i, score in self.pieces}


@lru_cache(4)
def load(path: str) -> Pieces:
    """The normal pieces of a model file with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    normal = tuple((p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL)
    base = next(i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE)
    return Pieces(normal, base, proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM, max(len(p) for p, _, _ in normal))


def escaped(text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE))))


def _substrings(word: Column, longest: int) -> Column:
    """All (start, end, piece) of at most `longest` characters, as one array."""
    n = F.length(word)
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i, F.lit(longest))), lambda k: F.struct(i.alias("start"), (i + k).alias("end"), F.substring(word, i + 1, k).alias("piece")))))


def lattice(words: DataFrame, model: Pieces, word: str = "word") -> DataFrame:
    """word and edges, an array of (start, end, score, id): its substrings that are pieces. words: distinct, not empty."""
    spark = words.sparkSession
    table_ = spark.createDataFrame([(p, i, float(s)) for p, i, s in model.pieces], "piece string, id int, score double")
    parts = words.select(word, F.explode(_substrings(F.col(word), model.longest)).alias("s")).select(word, "s.*")
    # the piece table is as large as the model file, some 30,000 rows here
    edges = parts.join(F.broadcast(table_), "piece", "left")
    kept = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("start", "end", "score", "id")))
    return edges.groupBy(word).agg(kept.alias("edges"))


def merges(word: Column, edges: Column) -> Column:
    """Ends of the symbols that BPE merging leaves: an array of positions from 0 to the word's length."""
    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    longer = F.filter(edges, lambda e: e["end"] - e["start"] > 1)

    def step(ends: Column, _: Column) -> Column:
        joins = F.filter(longer, lambda e: F.array_contains(ends, e["start"]) & F.array_contains(ends, e["end"]) & (F.size(F.filter(ends, lambda b: (b > e["start"]) & (b < e["end"]))) == 1))
        best = F.array_max(F.transform(joins, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("start"), e["end"].alias("end"))))
        return F.when(best.isNull(), ends).otherwise(F.filter(ends, lambda b: ~((b > -best["start"]) & (b < best["end"]))))

    return F.aggregate(steps, F.sequence(F.lit(0), F.length(word)), step)


def viterbi(word: Column, edges: Column, unknown: float = -1000.0) -> Column:
    """Ends of the pieces on the path of highest score; a character without a piece costs `unknown`."""
    n = F.length(word)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(best: Column, j: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["end"] == j), lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("back")))
        alone = F.array(F.struct((F.get(best, j - 1)["score"] + unknown).alias("score"), (j - 1).alias("back")))
        return F.concat(best, F.array(F.array_max(F.concat(into, alone))))

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)
    # back from the end: the positions passed, in order
    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(F.get(path, F.lit(0)) == 0, path).otherwise(F.concat(F.array(F.get(best, F.get(path, F.lit(0)))["back"]), path)))


def ids_of(word: Column, edges: Column, ends: Column, byte_base: int) -> Column:
    """Ids of the segments between the ends; byte pieces for those without a piece."""

    def one(i: Column) -> Column:
        a, b = F.get(ends, i - 1), F.get(ends, i)
        own = F.transform(F.filter(edges, lambda e: (e["start"] == a) & (e["end"] == b)), lambda e: e["id"])
        code = F.hex(F.encode(F.substring(word, a + 1, b - a), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: (F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + byte_base))
        return F.when(F.size(own) > 0, F.slice(own, 1, 1)).otherwise(raw)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), one))


def encode_words(words: DataFrame, model: Pieces, word: str = "word") -> DataFrame:
    """word and ids, by joins and folds alone. words: distinct, not null or empty."""
    fold = viterbi if model.unigram else merges
    rows = lattice(words, model, word).withColumn("ends", fold(F.col(word), F.col("edges")))
    return rows.select(word, ids_of(F.col(word), F.col("edges"), F.col("ends"), model.byte_base).alias("ids"))


def encode_by_joins(docs: DataFrame, model: Pieces, key: str = "doc_id") -> DataFrame:
    """key and ids with every use of a word joined to its ids: the wholly relational form. Keys must be distinct."""
    uses = docs.select(key, F.posexplode(F.regexp_extract_all(escaped(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), 1)).alias("at", "word"))
    coded = encode_words(uses.select("word").distinct(), model)
    rows = uses.join(coded, "word").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.select(key).join(rows, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def cut_words(column: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words (WORD) of all texts, one after another, with spaces for U+2581, and the number of words of each text. A null text has none."""
    data, offsets = buffers(column)
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    try:
        for text in texts:
            text.decode()
    except UnicodeDecodeError:
        texts = [text.decode("utf-8", "replace").encode() for text in texts]
    mark = SPACE.encode()
    texts = [b" " + text.replace(mark, b" ") if text else b"" for text in texts]
    ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
    joined = b"".join(texts)
    code = np.frombuffer(joined, np.uint8)
    space, line = code == 32, code == 10
    # a word starts with its text, at both ends of line ends, and at a space after something else
    start = np.ones(len(code) + 1, bool)
    start[1:-1] = (line[1:] != line[:-1]) | (space[1:] & ~space[:-1])
    start[ends] = True
    at = np.flatnonzero(start)
    return _cut(joined, at), np.diff(np.searchsorted(at, ends), prepend=0)


def _cut(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    """UTF-8 data as strings between the offsets."""
    if offsets[-1] > np.iinfo(np.int32).max:
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def joins(model: Pieces) -> np.ndarray:
    """Whether two bytes can meet within a symbol, by 256 * first + second: within some piece, spaces for U+2581, or within a character."""
    out = np.zeros((256, 256), bool)
    out[:, 0x80:0xC0] = True
    for piece, _, _ in model.pieces:
        code = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
        out[code[:-1], code[1:]] = True
    return out.ravel()


def cut_parts(words: pa.StringArray, meets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The parts of all words, one after another, and the number of parts of each word. meets: as joins() gives it."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    data, offsets = buffers(words)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    start = np.ones(len(data) + 1, bool)
    start[1:-1] = ~meets[data[:-1].astype(np.uint16) << 8 | data[1:]]
    start[offsets] = True
    at = np.flatnonzero(start)
    return _cut(data, at), np.diff(np.searchsorted(at, offsets))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and count: the uses of every word of at most DICTIONARY_CHARS characters in all texts. Tasks add up what they see before the shuffle."""

    def added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("count", "sum")])
        return pa.RecordBatch.from_arrays([rows["word"].combine_chunks(), rows["count_sum"].combine_chunks()], ["word", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in blocks(batch, text, CUT_BYTES):
                words, counts = cut_words(part.column(text))[0].value_counts().flatten()
                few = pc.less_equal(pc.utf8_length(words), DICTIONARY_CHARS)
                words = pc.replace_substring(words.filter(few), " ", SPACE).cast(pa.string())
                held.append(pa.RecordBatch.from_arrays([words, counts.filter(few)], ["word", "count"]))
                if sum(b.num_rows for b in held) > COUNTED:
                    yield added(held)
                    held = []
        if held:
            yield added(held)

    return docs.select(text).mapInArrow(run, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def dictionary(docs: DataFrame, model: Pieces) -> dict[str, np.ndarray]:
    """Ids of the DICTIONARY_WORDS commonest words of all texts."""
    common = word_counts(spread(docs)).orderBy(F.col("count").desc(), "word").limit(DICTIONARY_WORDS).select("word")
    # the limit leaves one task; folding takes all cores
    common = common.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word")
    return {r["word"]: np.array(r["ids"], np.int32) for r in encode_words(common, model).collect()}


def fold_word(word: str, pieces: dict[str, tuple[float, int]], byte_base: int) -> np.ndarray:
    """Ids of a word that the dictionary lacks, by the merges fold."""
    parts = list(word)
    if len(parts) > 200:
        parts = _fold_long(parts, pieces)
    else:
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    out: list[int] = []
    for p in parts:
        found = pieces.get(p)
        if found is not None:
            out.append(found[1])
        else:
            out += [byte_base + b for b in p.encode()]
    return np.array(out, np.int32)


def _fold_long(parts: list[str], pieces: dict[str, tuple[float, int]]) -> list[str]:
    """The same fold with a heap, for words of any length."""
    import heapq

    n = len(parts)
    after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0:
            both = parts[i] + parts[j]
            if (found := pieces.get(both)) is not None:
                heapq.heappush(heap, (-found[0], i, both))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not parts[i] or j < 0 or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [p for p in parts if p]


def gathered(ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries `at`, one after another, and how many each has. ids: those of all entries, counts of each."""
    n = counts[at]
    ends = np.cumsum(n)
    first = (np.cumsum(counts) - counts)[at]
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)], n


def flat(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each has."""
    return np.concatenate([np.zeros(0, np.int32), *words]), np.array([len(w) for w in words], np.int64)


class Merges:
    """The merges fold for many words at once: matrices of symbols, one merge of each word a step.

    Two symbols make a piece if they are its halves. All such pairs lie in one table: that of left and
    right at base[left] + right, if the owner of that place is left. Ranks count scores from the highest.
    """

    def __init__(self, pieces: dict[str, tuple[float, int]], byte_base: int) -> None:
        self.pieces, self.byte_base = pieces, byte_base
        ranks = {score: k for k, score in enumerate(sorted({score for score, _ in pieces.values()}, reverse=True))}
        halves: dict[int, list[tuple[int, int, int]]] = {}
        for p, (score, i) in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in pieces and p[k:] in pieces:
                    halves.setdefault(pieces[p[:k]][1], []).append((pieces[p[k:]][1], ranks[score], i))
        # symbol `none` is no piece
        self.none = max((i for _, i in pieces.values()), default=0) + 1
        span = 4 * sum(map(len, halves.values())) + 1
        self.base = np.zeros(self.none + 1, np.int64)
        self.owner = np.full(span + self.none + 1, -1, np.int32)
        self.rank, self.into = np.full(len(self.owner), NO_RANK, np.int32), np.full(len(self.owner), -1, np.int32)
        # longest rows first, each at the first of some places where it meets no other
        places = np.random.default_rng(0)
        for left, row in sorted(halves.items(), key=lambda x: (-len(x[1]), x[0])):
            right, rank, into = np.array(row).T
            while (self.owner[(base := int(places.integers(span))) + right] >= 0).any():
                pass
            self.base[left] = base
            self.owner[base + right], self.rank[base + right], self.into[base + right] = left, rank, into
        # one more place than the greatest character needs: for all beyond it
        self.symbol = np.full(max((ord(p) for p in pieces if len(p) == 1), default=0) + 2, self.none, np.int32)
        for p, (_, i) in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbours; NO_RANK where they make none."""
        at = self.base[left] + right
        return np.where(self.owner[at] == left, self.rank[at], NO_RANK), self.into[at]

    def fold(self, words: list[str]) -> dict[str, np.ndarray]:
        """Ids of each word."""
        ids, counts = self.folded(pa.array(words, pa.string()))
        return dict(zip(words, np.split(ids, np.cumsum(counts)[:-1]))) if words else {}

    def folded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. Long words and those with a character that is no piece go one by one."""
        if not len(words):
            return flat([])
        data, offsets = buffers(words)
        code = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        symbols = self.symbol[np.minimum(code, len(self.symbol) - 1)]
        n = np.asarray(pc.utf8_length(words)).astype(np.int64)
        first = np.cumsum(n) - n
        alone = n > MOST_REMEMBERED_CHARS
        alone[np.repeat(np.arange(len(n)), n)[symbols == self.none]] = True
        order = np.flatnonzero(~alone)
        order = order[np.argsort(n[order], kind="stable")]
        ids, counts = [], []
        for at in range(0, len(order), MATRIX_WORDS):
            some = order[at : at + MATRIX_WORDS]
            place = np.arange(n[some[-1]])[:, None]
            rows = np.where(place < n[some], symbols[np.minimum(first[some] + place, len(symbols) - 1)], self.none)
            left = self._merged(rows).T
            kept = left != self.none
            ids.append(left[kept])
            counts.append(kept.sum(axis=1))
        slow = np.flatnonzero(alone)
        singly = flat([fold_word(w, self.pieces, self.byte_base) for w in words.take(pa.array(slow)).to_pylist()])
        back = np.empty(len(n), np.int64)
        back[np.concatenate([order, slow])] = np.arange(len(n))
        return gathered(np.concatenate([*ids, singly[0]]), np.concatenate([*counts, singly[1]]), back)

    def _merged(self, rows: np.ndarray) -> np.ndarray:
        """rows, a word in each column and `none` behind its last symbol, after all merges: symbols that went are `none`."""
        # a row of `none` ends the words: no pair crosses it
        rows = np.pad(rows, ((0, 1), (0, 0)), constant_values=self.none)
        height, width = rows.shape
        symbols, last = rows.ravel(), (height - 1) * width
        after, before = np.arange(len(symbols)) + width, np.arange(len(symbols)) - width
        after[last:] -= width
        ranks, into = self.pairs(symbols, symbols[after])
        # the least of rank and place: the leftmost of equal ones
        table_ = (ranks.astype(np.int64) * height).reshape(rows.shape) + np.arange(height)[:, None]
        keys = table_.ravel()
        none = NO_RANK * height
        while True:
            best = table_.min(axis=0)
            column = np.flatnonzero(best < none)
            if not len(column):
                return rows
            here = best[column] % height * width + column
            gone = after[here]
            next_ = after[gone]
            symbols[here], symbols[gone], keys[gone] = into[here], self.none, none
            after[here], before[next_] = next_, here
            near, following = np.concatenate([here, before[here]]), np.concatenate([next_, here])
            found, into[near] = self.pairs(symbols[near], symbols[following])
            # what is before a word's first symbol, a negative place, is the last row, which has no rank
            keys[near] = found.astype(np.int64) * height + near // width % height


def _viterbi_word(word: str, pieces: dict[str, tuple[float, int]], byte_base: int, longest: int, unknown: float = -1000.0) -> np.ndarray:
    """Ids on the path of highest score, for unigram models."""
    best, back = [0.0], [0]
    for j in range(1, len(word) + 1):
        options = [(best[j - 1] + unknown, j - 1)]
        options += [(best[i] + pieces[word[i:j]][0], i) for i in range(max(0, j - longest), j) if word[i:j] in pieces]
        score, i = max(options)
        best.append(score)
        back.append(i)
    out, j = [], len(word)
    while j:
        p = word[back[j] : j]
        out.append([pieces[p][1]] if p in pieces else [byte_base + b for b in p.encode()])
        j = back[j]
    return np.array([x for part in reversed(out) for x in part], np.int32)


class Decoder:
    """Bytes of the pieces, laid out for decoding many ids at once."""

    def __init__(self, model: Pieces) -> None:
        size = max(max(i for _, i, _ in model.pieces), model.byte_base + 255) + 1
        parts = [b""] * size
        for p, i, _ in model.pieces:
            parts[i] = p.replace(SPACE, " ").encode()
        for b in range(256):
            parts[model.byte_base + b] = bytes([b])
        self.parts = pa.array(parts, pa.large_binary())
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.start[ids], n)
        out = self.data[at].tobytes()
        return out[1:] if out[:1] == b" " else out

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Digest of what the ids of each text decode to. ids: those of all texts, counts of each."""
        sizes = np.concatenate([[0], np.cumsum(self.length[ids])])
        data = memoryview(self.parts.take(pa.array(ids)).buffers()[2] or b"").cast("B")
        ends = np.cumsum(counts)
        bounds = ((int(a), int(b)) for a, b in zip(sizes[ends - counts], sizes[ends]))
        return [hashlib.sha256(data[a + (a < b and data[a] == 32) : b]).hexdigest() for a, b in bounds]


def encoded(df: DataFrame, model: Pieces, words: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """df with ids instead of the text, n_tokens, and decoded_sha256: the digest of the decoded ids. They replace columns of these names."""
    rest = [f for f in df.schema.fields if f.name not in (text, "ids", "n_tokens", "decoded_sha256")]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
    # the model's size and DICTIONARY_WORDS bound it
    shared = df.sparkSession.sparkContext.broadcast((model, [w.replace(SPACE, " ") for w in words], flat(list(words.values())), joins(model), None if model.unigram else Merges(model.by_piece(), model.byte_base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, known_ids, meets, merges_ = shared.value
        decoder, known, pieces = Decoder(model), pa.array(known, pa.string()), merges_.pieces if merges_ else model.by_piece()
        parts, part_ids = pa.array([], pa.string()), flat([])

        def fold(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
            words = pc.replace_substring(words, " ", SPACE)
            if merges_:
                return merges_.folded(words)
            return flat([_viterbi_word(w, pieces, model.byte_base, model.longest) for w in words.to_pylist()])

        def coded(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
            """Ids of words that the dictionary lacks, and how many each has."""
            nonlocal parts, part_ids
            some, n = cut_parts(words, meets) if merges_ else (words, np.ones(len(words), np.int64))
            some = some.dictionary_encode()
            if len(parts) >= REMEMBERED:
                parts, part_ids = pa.array([], pa.string()), flat([])
            at = pc.index_in(some.dictionary, parts)
            new = some.dictionary.filter(at.is_null()).cast(pa.string())
            new_ids = fold(new)
            ids, counts = np.concatenate([part_ids[0], new_ids[0]]), np.concatenate([part_ids[1], new_ids[1]])
            place = np.array(at.fill_null(-1)).astype(np.int64)
            place[place < 0] = len(parts) + np.arange(len(new))
            short = np.asarray(pc.utf8_length(new)) <= MOST_REMEMBERED_CHARS
            part_ids = tuple(np.concatenate(x) for x in zip(part_ids, gathered(*new_ids, np.flatnonzero(short))))
            parts = pa.concat_arrays([parts, new.filter(pa.array(short))])
            ids, counts = gathered(ids, counts, place[np.asarray(some.indices)])
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(n)
            return ids, sums[ends] - sums[ends - n]

        for batch in batches:
            for part in blocks(batch, text, CUT_BYTES):
                words, n = cut_words(part.column(text))
                words = words.dictionary_encode()
                different = words.dictionary.cast(pa.string())
                at = pc.index_in(different, known)
                own = coded(different.filter(at.is_null()))
                place = np.array(at.fill_null(-1)).astype(np.int64)
                place[place < 0] = len(known) + np.arange(len(own[1]))
                coded_words, place = tuple(np.concatenate(x) for x in zip(known_ids, own)), place[np.asarray(words.indices)]
                ends, row = np.concatenate([[0], np.cumsum(n)]), 0
                # ids take more room than words: fewer texts at once
                for some in blocks(part, text):
                    bounds = ends[row : row + some.num_rows + 1]
                    ids, counts = gathered(*coded_words, place[bounds[0] : bounds[-1]])
                    offsets = np.concatenate([[0], np.cumsum(counts)])[bounds - bounds[0]]
                    counts, null = np.diff(offsets), np.array(some.column(text).is_null())
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
                    yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in rest), lists, pa.array(counts, mask=null), pa.array(decoder.digests(ids, counts), pa.string(), mask=null)], schema.names)
                    row += some.num_rows

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ids, n_tokens and decoded_sha256 instead of the text."""
    text_batches(docs.sparkSession)
    model = load(path or model_path())
    return encoded(spread(docs), model, dictionary(docs, model))


def decoded(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """df with text, decoded from its ids; null ids give a null text, unknown or control ids nothing."""
    model = load(path or model_path())
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = [None if v is None else decoder.decode(np.array(v, np.int64)).decode("utf-8", "replace") for v in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of what they decode to."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
