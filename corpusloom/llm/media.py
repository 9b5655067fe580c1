"""Media columns: baseline JPEG with DC-only thumbnails (operator 9).

A payload of bytes becomes a grey baseline JPEG without loss: its 64-byte groups are the blocks,
and byte k of a group is the quantised coefficient k in scan order. Coefficients of size category
8 are -255..-128 and 128..255, 256 values whose eight amplitude bits are the byte itself, so one
Huffman code of one bit serves all, and a block takes 72 bytes. Each block is a restart interval,
so every block is decoded on its own and its DC value needs no other. All steps work on a slice
of the batch at once.

The decoder parses markers and tables as they come. Any baseline JPEG can be read: grey or
interleaved colour, any Huffman tables, with or without restart intervals; scans decode side by
side, one symbol of each at a time. Thumbnails take one pixel from each luminance block's DC value.

Defined cases: a null payload is empty; an empty one is one block of zeros. A picture is at most
8191 blocks wide and high; blocks that only fill the last row are counted in a comment. Equal
payloads give equal pictures and features. A file that isn't a baseline JPEG has null results in
thumbnails() and raises in decode().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, buffers, spread, table

WIDE, MOST = 64, 8191
NOTE = b"blocks="


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


ONE_CODE = bytes([1] + [0] * 15)
#: Quantiser of ones; one Huffman table for DC and one for AC, each with the one symbol 8; restart at every block.
TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, b"\x00" + ONE_CODE + b"\x08") + _segment(0xC4, b"\x10" + ONE_CODE + b"\x08") + _segment(0xDD, b"\x00\x01")
SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def shape(n: int) -> tuple[int, int]:
    """Width and height in blocks of a picture of n blocks."""
    high = min(-(-n // WIDE), MOST)
    wide = -(-n // high)
    return wide, -(-n // wide)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a multiple of 64, at least 64."""
    counts = [len(p) // 64 for p in payloads]
    shapes = [shape(n) for n in counts]
    filled = b"".join(p + bytes(64 * (w * h - n)) for p, n, (w, h) in zip(payloads, counts, shapes))
    units = np.frombuffer(filled, np.uint8).reshape(-1, 64)
    bits = np.zeros((len(units), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units[:, :, None], axis=2)
    rows = np.empty((len(units), 74), np.uint8)
    rows[:, :72] = np.packbits(bits.reshape(len(units), 576), axis=1)
    rows[:, 72] = 0xFF
    ends = np.cumsum([w * h for w, h in shapes])
    begins = np.concatenate([[0], ends[:-1]])
    rows[:, 73] = 0xD0 + (np.arange(len(units)) - np.repeat(begins, ends - begins)) % 8
    times = np.ones(rows.shape, np.int64)
    times[:, :72] += rows[:, :72] == 0xFF
    flat = np.repeat(rows.ravel(), times.ravel())
    after = np.cumsum(times.ravel())
    flat[after[(times == 2).ravel()] - 1] = 0
    after = after.reshape(rows.shape)[:, 73]
    out = []
    for n, (w, h), begin, end in zip(counts, shapes, begins, ends):
        scan = flat[after[begin - 1] if begin else 0 : after[end - 1] - 2].tobytes()
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + b"\x01\x11\x00")
        out.append(b"\xff\xd8" + TABLES + _segment(0xFE, NOTE + str(n).encode()) + frame + SCAN + scan + b"\xff\xd9")
    return out


def parse(data: bytes) -> dict:
    """Markers and tables of a baseline JPEG, and where its scan begins and ends."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, out = 2, {"quant": {}, "huff": {}, "restart": 0, "note": None}
    while True:
        if data[at] != 0xFF or at + 4 > len(data):
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                out["quant"][body[0] & 15] = body[1] if size == 64 else body[1] * 256 + body[2]  # DC step only
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                out["huff"][body[0]] = body[1:k]
                body = body[k:]
        elif marker == 0xC0:
            out["height"], out["width"], count = struct.unpack_from(">HHB", body, 1)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xFE:
            out["note"] = body
        elif marker == 0xDA:
            out["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["scan"] = at
            out["end"] = data.rindex(b"\xff\xd9")
            return out


@lru_cache(64)
def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits that may come: 256 times the length of the code that they begin with, plus its symbol."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = 256 * length + spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """What parse says of each file, and its luminance coefficients: one row of 64, in scan order, for each block.

    Blocks are in the order of the scan. Files of like layout and tables are decoded together.
    """
    heads = [parse(f) for f in files]
    alike: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        parts = tuple((p[1], p[2], h["huff"][h["tables"][p[0]][0]], h["huff"][16 + h["tables"][p[0]][1]]) for p in h["parts"])
        alike.setdefault((parts, h["restart"]), []).append(i)
    out: list[tuple[dict, np.ndarray] | None] = [None] * len(files)
    for (parts, restart), own in alike.items():
        single = len(parts) == 1
        units = [k for k, p in enumerate(parts) for _ in range(1 if single else p[0] * p[1])]
        wide, high = (1, 1) if single else (max(p[0] for p in parts), max(p[1] for p in parts))
        mcus = [-(-heads[i]["width"] // (8 * wide)) * -(-heads[i]["height"] // (8 * high)) for i in own]
        raw = np.frombuffer(b"".join(files[i][heads[i]["scan"] : heads[i]["end"]] + b"\xff\xd9" for i in own), np.uint8)
        mark = np.flatnonzero(raw[:-1] == 0xFF)
        kind = raw[mark + 1]
        keep = np.ones(len(raw), bool)
        keep[mark[kind == 0] + 1] = False
        cut = mark[kind >= 0xD0]
        keep[cut] = keep[cut + 1] = False
        moved = np.concatenate([[0], np.cumsum(keep)])
        data = np.concatenate([raw[keep], np.zeros(16, np.uint8)])
        starts = moved[np.concatenate([[0], cut[:-1] + 2])]  # a segment follows each restart marker and each file's end
        per = [-(-m // restart) if restart else 1 for m in mcus]
        if sum(per) != len(starts):
            raise ValueError("restart markers are missing")
        sizes = np.concatenate([np.minimum(restart or m, m - np.arange(n) * (restart or m)) for m, n in zip(mcus, per)])
        found = _symbols(data, starts.astype(np.int64), sizes, units, parts)
        at = 0
        for i, m in zip(own, mcus):
            n = m * units.count(0)
            out[i] = heads[i], found[at : at + n]
            at += n
    return out


def _symbols(data: np.ndarray, starts: np.ndarray, mcus: np.ndarray, units: list[int], parts: tuple) -> np.ndarray:
    """Luminance coefficients of all segments, each decoded from its start."""
    dc, ac = [lookup(p[2]) for p in parts], [lookup(p[3]) for p in parts]
    luminance = units.count(0)
    firsts = np.concatenate([[0], np.cumsum(mcus)]) * luminance
    out = np.zeros((firsts[-1], 64), np.int16)
    windows = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1))
    bit, before = starts * 8, np.zeros((len(parts), len(starts)), np.int64)

    def take(at: np.ndarray, table: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and value that stand at each segment's bit; moves the bits on."""
        here = bit[at]
        word = np.ascontiguousarray(windows[here >> 3]).view(">u8").ravel().astype(np.uint64) << (here & 7).astype(np.uint64)
        code = table[(word >> np.uint64(48)).astype(np.int64)]
        length, symbol = code >> 8, code & 255
        if not length.all():
            raise ValueError("a code that the table lacks")
        size = symbol & mask
        rest = (word << length.astype(np.uint64)) >> np.uint64(1)
        value = (rest >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), (1 << size) - 1, 0)
        bit[at] = here + length + size
        return symbol, value

    for mcu in range(int(mcus.max(initial=0))):
        live = np.flatnonzero(mcus > mcu)
        nth = 0
        for part in units:
            _, step = take(live, dc[part], 15)
            before[part, live] += step
            row = firsts[live] + mcu * luminance + nth
            if part == 0:
                out[row, 0] = before[0, live]
                nth += 1
            k, at, row = np.ones(len(live), np.int64), live, row
            while len(at):
                symbol, value = take(at, ac[part], 15)
                size = symbol & 15
                k = np.where(symbol == 0, 64, k + (symbol >> 4))
                some = size > 0
                if part == 0:
                    if some.all():
                        out[row, k] = value
                    else:
                        out[row[some], k[some]] = value[some]
                k = k + 1
                more = k < 64
                if not more.all():
                    at, row, k = at[more], row[more], k[more]
    return out


def thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """One pixel for each luminance block, from its DC value, in the picture's order."""
    step = head["quant"].get(head["parts"][0][3], 1)
    level = np.clip(np.floor(coefficients[:, 0].astype(np.int64) * step / 8 + 128.5), 0, 255).astype(np.uint8)
    parts = head["parts"]
    across, down = (1, 1) if len(parts) == 1 else parts[0][1:3]
    most = (1, 1) if len(parts) == 1 else (max(p[1] for p in parts), max(p[2] for p in parts))
    wide, high = -(-head["width"] // (8 * most[0])), -(-head["height"] // (8 * most[1]))
    return level.reshape(high, wide, down, across).transpose(0, 2, 1, 3).reshape(high * down, wide * across)


def payload(head: dict, coefficients: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    n = int(head["note"][len(NOTE) :])
    return np.where(coefficients[:n] < 0, coefficients[:n] + 255, coefficients[:n]).astype(np.uint8).tobytes()


def thumbnails(df: DataFrame, column: str = "media") -> DataFrame:
    """df with width, height and thumbnail_hash of its JPEG files; null for what is none. They replace columns of these names."""
    from pyspark.sql import types as T

    df = df.drop("width", "height", "thumbnail_hash")

    schema = T.StructType([*df.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail_hash", T.StringType())])

    def one(data: bytes | None) -> tuple:
        try:
            head, found = decode([data or b""])[0]
        except (ValueError, KeyError, IndexError, struct.error):
            return None, None, None
        return head["width"], head["height"], hashlib.sha256(thumbnail(head, found).tobytes()).hexdigest()[:16]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, t = ([*zip(*map(one, batch.column(column).to_pylist()))] or [(), (), ()]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, n_bytes and the media that hold the column's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column):
                data, offsets = buffers(part.column(column))
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                media = encode([t + bytes(max(-len(t) % 64, 0 if t else 64)) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_back(df: DataFrame, key: str) -> DataFrame:
    """Payload and picture digests, read from the stored media."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "media"):
                files = part.column("media").to_pylist()
                rows = []
                for data, (head, found) in zip(files, decode(files)):
                    body, small = payload(head, found), thumbnail(head, found)
                    mark = hashlib.sha256(small.tobytes()).hexdigest()[:16]
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{head['width']}x{head['height']}:{mark}", head["width"], head["height"]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), *columns], [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"])

    return df.mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a JPEG, read back, with features of the picture."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")))
    return read_back(stored(docs, "doc_id", "data"), "doc_id")
