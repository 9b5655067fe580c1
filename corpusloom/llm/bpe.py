"""Byte-level BPE encoding and decoding by a tree of halves (operator 11).

Encodings of byte strings form a monoid: halves are encoded, each in the same way, and neighbours
are joined. Only tokens near the seam can change by a join. A window of tokens around the seam is
encoded anew and grows on each side until that side is stable; what lies outside stays as it is.

Why that is exact: BPE merges the pair of lowest rank, the leftmost of equal ones, and no merge is
undone. Tokens t1 ... tn are the encoding of their bytes if and only if each ti ti+1 alone encodes
to itself. (Up to the first merge that crosses a border, what lies between the next borders goes
through the same merges as alone; so that merge would also cross the border in the pair alone.)
Both parts and the window are encodings, so the seams of the window are all that needs a look, and
one look settles them: the encodings of pairs are remembered.

Words share their halves, so the tree of most words is one join of two remembered halves. Spark
spreads the texts; within a text each match of the pattern has a tree of its own. Decoding is a
homomorphism: the bytes of a text are those of its tokens, concatenated.

Defined cases: a null text is encoded as an empty one, and that has no tokens; null ids decode to
no bytes. Bytes that are no UTF-8 are read as U+FFFD. Ids outside the table raise an error. A match
that is a token as a whole is that token, as the tiktoken library has it. An empty table gives an
empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, buffers, spread, table, text_batches

#: Entries that a task remembers of each kind (matches, halves, pairs), and bytes of one worth it. They change the speed, never an id.
REMEMBERED, MOST_REMEMBERED_BYTES = 250_000, 48


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(4)
def load(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks. The table is as large as the file, whatever the corpus."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines()) if token}


class Tree:
    """Encodes byte strings by halves."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a match of the pattern."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self._halves(piece) if piece else ()

    def _halves(self, piece: bytes) -> tuple[int, ...]:
        out = self.halves.get(piece)
        if out is None:
            if len(piece) == 1:
                out = (self.ranks[piece],)
            else:
                half = len(piece) >> 1
                out = self.join(self._halves(piece[:half]), self._halves(piece[half:]))
            self._remember(piece, out)
        return out

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of a and b, both of them encodings and not empty."""
        window = self.pair(a[-1], b[0])
        if window == (a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            if not left:
                i = min(2 * i, len(a))
            if not right:
                j = min(2 * j, len(b))
            window = self.window(self.decode(a[len(a) - i :]) + self.decode(b[:j]))

    def stable(self, x: int, y: int) -> bool:
        """Whether no merge crosses the border of these two tokens."""
        return self.pair(x, y) == (x, y)

    def pair(self, x: int, y: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens."""
        found = self.pairs.get((x, y))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[x, y] = self.merged(self.tokens[x] + self.tokens[y])
        return found

    def window(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a window, remembered like that of a half."""
        found = self.halves.get(piece)
        if found is None:
            found = self.merged(piece)
            self._remember(piece, found)
        return found

    def _remember(self, piece: bytes, ids: tuple[int, ...]) -> None:
        if len(piece) <= MOST_REMEMBERED_BYTES:
            if len(self.halves) >= REMEMBERED:
                self.halves.clear()
            self.halves[piece] = ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The encoding by its definition: merge by merge, the lowest rank first. For windows."""
        n, ranks = len(piece), self.ranks
        # a part begins at i and ends before end[i]; 0 for one that was merged into its left neighbour
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if j == 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            before[stop] = i
            if stop < n and (rank := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (rank, i, end[stop]))
            if (k := before[i]) >= 0 and (rank := ranks.get(piece[k:stop])) is not None:
                heappush(heap, (rank, k, stop))
        return tuple(ranks[piece[i:stop]] for i, stop in enumerate(end) if stop)

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Matches(dict):
    """Ids of matches as packed 32-bit integers, encoded where they are asked for the first time."""

    def __init__(self, tree: Tree) -> None:
        super().__init__()
        self.tree = tree

    def __missing__(self, match: str) -> bytes:
        raw = match.encode()
        ids = array("i", self.tree.encode(raw)).tobytes()
        if len(raw) <= MOST_REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids


_matches: dict[str, Matches] = {}


def matches_of(mark: str, ranks: dict[bytes, int]) -> Matches:
    """What this Python worker remembers of a table, from one task to the next."""
    if mark not in _matches:
        _matches.clear()
        _matches[mark] = Matches(Tree(ranks))
    return _matches[mark]


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, cut: str | None = None) -> DataFrame:
    """docs and the ids of each text. path: a file of ranks; cut: the pattern whose matches are encoded separately."""
    text_batches(docs.sparkSession)
    cut = cut or pattern()
    # as large as the file, whatever the corpus
    ranks = load(path or ranks_path())
    mark = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rest = [f for f in docs.schema.fields if f.name != ids]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, own = regex.compile(cut).findall, matches_of(mark, shared.value)
        for batch in batches:
            for part in blocks(batch, text):
                data, offsets = buffers(part.column(text))
                coded = [b"".join(map(own.__getitem__, find(data[a:b].tobytes().decode("utf-8", "replace")))) for a, b in zip(offsets[:-1], offsets[1:])]
                ends = np.cumsum([0, *(len(c) >> 2 for c in coded)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), lists], schema.names)

    return spread(docs).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df and the bytes of each row's ids, as a binary column: a prefix of ids may end inside a character."""
    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in load(path or ranks_path()).items()})
    rest = [f for f in df.schema.fields if f.name != decoded]
    schema = T.StructType([*rest, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, row.values.to_numpy().tolist() if row.is_valid else ())) for row in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(out, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the number and digest of its ids, and the digest of what they decode to."""
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
