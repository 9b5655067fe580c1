"""Personal data: base patterns and a semi-Markov conditional random field (operator 3).

Base spans are what fixed patterns find: email, ip, card (Luhn) and phone. They always stay. The
field adds spans that the patterns miss, such as addresses written with (at) and dot, defanged
ip numbers, and phone or card numbers in other layouts. It works on windows around digits and
address signs: a window is a run of tokens, every segment of at most MOST_TOKENS tokens is a
candidate for every kind, and features of the whole segment (digit count and grouping, checksum,
separators, end of an address, neighbours, a word that announces it) score it. Dynamic programming
over the window finds the segmentation of highest score, boundaries and kinds together; base spans
are fixed in it and cost no search. Weights are learned by the likelihood of whole segmentations
(forward-backward over segments) on windows made by a documented generator.

Defined cases: a null text is empty and has no spans. Positions are code points, ends exclusive.
Kinds overlap where base patterns do; added spans overlap none. Equal texts have equal spans; long
texts are searched as a whole: windows that touch are one window, of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import blocks, spread, table, text_batches

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment, and characters of a window on both sides of an anchor.
MOST_TOKENS, AROUND = 16, 40
#: An added span must beat leaving its tokens out by so much.
MARGIN = 1.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Where a window can be: an address sign in some spelling, or digits and their separators.
SIGN = re.compile(r"@|[(\[\s][aA][tT][)\]\s]")
DOTTED = re.compile(r"\s?[\w-]+(?:\.|\s?[(\[]?\s?dot\b)", re.I)
DIGITS = re.compile(r"[0-9](?:[\x20().+/\[\]-]{0,3}[0-9]){5,}")
#: Four groups of at most three digits, each dot alone or in brackets or spaces, as in 10[.]0[.]0[.]1.
DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\x20(\[]{0,2}\.[\x20)\]]{0,2}[0-9]{1,3}){3}(?![0-9])")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
ANNOUNCES = {
    "email": {"mail", "email", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "carte", "tarjeta", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "cell"},
}
FEATURES = ("one", "luhn", "digits_9_15", "digits_12_19", "digits_16", "octets", "dotted4", "sign", "domain_end", "edge_word", "plus", "paren", "groups_phone", "groups_card", "spaces_only", "announced", "glued", "length", "bad_inside", "cut_digits", "dot_space", "plain_at")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, leftmost and apart within a kind."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text around anchors, apart from each other; what touches is one stretch."""
    anchors = [m.span() for m in SIGN.finditer(text) if m[0] == "@" or DOTTED.match(text, m.end())]
    anchors += [m.span() for m in DIGITS.finditer(text)]
    anchors += [m.span() for m in DEFANGED.finditer(text)]
    start = end = -1
    for left, right in sorted(anchors):
        a, b = max(left - AROUND, 0), min(right + AROUND, len(text))
        if a <= end:
            end = max(end, b)
            continue
        if start >= 0:
            yield start, end
        start, end = a, b
    if start >= 0:
        yield start, end


def _segment_features(tokens: list[str], i: int, j: int, before: str, after: str) -> dict[str, float] | None:
    """Features of the segment tokens[i:j]; None where no kind can be."""
    first, last = tokens[i], tokens[j - 1]
    if first.isspace() or not (last.isalnum()):
        return None
    words = tokens[i:j]
    body = "".join(words)
    groups = [w for w in words if w.isascii() and w.isdigit()]
    digits = "".join(groups)
    letters = [w for w in words if w.isalpha()]
    low = body.lower()
    sign = "@" in body or any(w.lower() == "at" for w in letters)
    if not sign and len(digits) < 4:
        return None
    f = dict.fromkeys(FEATURES, 0.0)
    f["one"] = 1.0
    octets = [g for g in groups if int(g[:4]) <= 255 and len(g) <= 3]
    f["luhn"] = float(12 <= len(digits) <= 19 and luhn(digits) and not letters)
    f["digits_9_15"] = float(9 <= len(digits) <= 15 and not letters)
    f["digits_12_19"] = float(12 <= len(digits) <= 19 and not letters)
    f["digits_16"] = float(len(digits) == 16 and not letters)
    f["octets"] = float(len(groups) == 4 and len(octets) == 4 and not letters)
    f["dotted4"] = float(len(groups) == 4 and len(re.findall(r"\.", body)) == 3 and not letters)
    dots = [k for k, w in enumerate(words) if w == "." or w.lower() == "dot"]
    f["sign"] = float(sign and body.count("@") + sum(w.lower() == "at" for w in letters) == 1)
    f["domain_end"] = float(sign and bool(dots) and last.isalpha() and last.isascii() and 2 <= len(last) <= 6 and last.lower() not in ("dot", "at") and any(words[k].lower() == "at" or words[k] == "@" for k in range(dots[-1])))
    f["edge_word"] = float(sign and (first.lower() in ("at", "dot", "@") or not first.isalnum()))
    f["plus"] = float(first == "+" or digits[:2] == "00" and body[0] == "0")
    f["paren"] = float(bool(re.search(r"\([0-9]{2,4}\)", body)) and not letters)
    sizes = tuple(len(g) for g in groups)
    f["groups_phone"] = float(sizes[-3:] == (3, 3, 4) and len(sizes) <= 4 and not letters)
    f["groups_card"] = float(sizes in ((4, 4, 4, 4), (4, 6, 5), (16,), (15,)) and not letters)
    f["spaces_only"] = float(not letters and set(body) <= set("0123456789 "))
    f["glued"] = float(bool(before) and (before.isalnum() or before in "._%+-@") or bool(after) and (after.isalnum() or after == "@"))
    f["length"] = (j - i) / MOST_TOKENS
    inside = set(low) - set("abcdefghijklmnopqrstuvwxyz0123456789@.+-_()[] /")
    f["bad_inside"] = float(bool(inside) or bool(letters) and not sign or "  " in body or "\n" in body or sign and any(w.isspace() and not (words[k - 1].lower() in ("at", "dot", ")", "]", "@", ".") or k + 1 < len(words) and words[k + 1].lower() in ("at", "dot", "(", "[", "@")) for k, w in enumerate(words) if 0 < k))
    f["dot_space"] = float(bool(re.search(r"[^\s]\.\s", body)))
    f["plain_at"] = float(sign and "@" not in body and bool(re.search(r"\sat\s", low)) and "dot" not in letters)
    f["cut_digits"] = float(len(digits) > 19)
    return f


def candidates(tokens: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Segments that can be of a kind, by their start, each with features for every kind (rows)."""
    n = len(tokens)
    for i in range(n):
        before = tokens[i - 1][-1] if i else ""
        near = {w.lower() for w in tokens[max(0, i - 6) : i] if w.isalpha()}
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            f = _segment_features(tokens, i, j, before, tokens[j][0] if j < n else "")
            if f is not None:
                rows = np.tile(np.array([f[k] for k in FEATURES]), (len(KINDS), 1))
                rows[:, FEATURES.index("announced")] = [float(bool(near & ANNOUNCES[k])) for k in KINDS]
                yield i, j, rows


def segment_scores(weights: np.ndarray, cands: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    return [(weights * rows).sum(axis=1) for _, _, rows in cands]


def decode(n: int, scored: Iterable[tuple[int, int, np.ndarray]], margin: float = 0.0) -> list[tuple[int, int, int]]:
    """The segmentation of highest score: segments (start, end, kind), a token outside scores 0.

    Segments come with the scores of their kinds, by their start, and are not kept.
    """
    best, back, done = [0.0] + [-np.inf] * n, [None] * (n + 1), 0

    def settle(to: int) -> None:
        nonlocal done
        while done < to:
            done += 1
            if best[done] <= best[done - 1]:
                best[done], back[done] = best[done - 1], None

    for i, j, scores in scored:
        settle(i)
        kind = int(scores.argmax())
        value = best[i] + scores[kind] - margin
        if value > best[j]:
            best[j], back[j] = value, (i, kind)
    settle(n)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


def _expected(n: int, cands: list, scores: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """Probability of each segment and kind over all segmentations, and the log of their sum."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    ending, starting = {}, {}
    total = [np.logaddexp.reduce(s) for s in scores]
    for k, (i, j, _) in enumerate(cands):
        ending.setdefault(j, []).append(k)
        starting.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[cands[k][0]] + total[k] for k in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[cands[k][1]] + total[k] for k in starting.get(i, ()))])
    return [np.exp(forward[i] + s + backward[j] - forward[n]) for (i, j, _), s in zip(cands, scores)], forward[n]


def examples(count: int = 400, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with their spans (start, end, kind), made by rule: layouts of each kind, and what only looks like one."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick("abcdefghiklmnoprstuv") for _ in range(int(rng.integers(2, 9))))

    def card(valid: bool) -> str:
        while True:
            d = pick("3456") + number(15)
            if luhn(d) == valid:
                return d

    def email() -> str:
        at, dot = pick([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("[at]", "[dot]")])
        name = word() + pick(["", "." + number(2), "." + word(), number(2)])
        return name + at + word() + pick(["", number(1)]) + dot + pick(["com", "org", "net", "example.com", "de", "co.uk"])

    def ip() -> str:
        dot = pick([".", "[.]", " . ", "[.]"])
        return dot.join(str(int(x)) for x in rng.integers(1, 255, 4))

    def phone() -> str:
        a, b, c = number(3), pick(["555", number(3)]), number(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"001 {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}"])

    def a_card() -> str:
        d = card(True)
        return pick([d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)), ".".join(d[k : k + 4] for k in range(0, 16, 4)), "/".join(d[k : k + 4] for k in range(0, 16, 4))])

    def nothing() -> str:
        return pick([card(False), number(16), number(10), number(13), number(8), f"{number(4)}-{number(2)}-{number(2)}", f"v{number(1)}.{number(2)}.{number(1)}", f"{number(3)}.{number(3)}.{number(2)}.{number(4)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)}, {number(3)}, {number(4)}", "look at this", f"meet at {word()}", "".join(pick("0123456789abcdef") for _ in range(40)), f"{number(4)} {number(4)} {number(3)}", f"{word()} at {word()}", f"{number(1)}.{number(2)}.{number(2)}", f"{number(24)}", f"@{word()}", f"{number(3)}.{number(3)}.{number(3)}.{number(3)}", f"{number(2)} {number(3)} {number(2)} {number(4)} {number(5)}"])

    makers = (email, ip, a_card, phone)
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 3))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 5)))) + pick([" ", " ", ", ", ": "])
            if rng.random() < 0.55:
                kind = int(rng.integers(4))
                if rng.random() < 0.3:
                    text += pick(sorted(ANNOUNCES[KINDS[kind]])) + pick([" ", ": "])
                made = makers[kind]()
                spans.append((len(text), len(text) + len(made), kind))
                text += made
            else:
                text += nothing()
            text += pick([" ", ". ", ", ", " "])
        out.append((text + word(), spans))
    return out


@lru_cache(1)
def weights(rounds: int = 6, rate: float = 0.3) -> np.ndarray:
    """Weights (kinds x features) by stochastic gradient of the log-likelihood; deterministic."""
    w, rng, ready = np.zeros((len(KINDS), len(FEATURES))), np.random.default_rng(3), []
    for text, spans in examples():
        tokens = [m for m in TOKEN.finditer(text)]
        starts, ends = {m.start(): k for k, m in enumerate(tokens)}, {m.end(): k + 1 for k, m in enumerate(tokens)}
        cands = list(candidates([m[0] for m in tokens]))
        truth = {(starts[a], ends[b]): kind for a, b, kind in spans}
        ready.append((len(tokens), cands, truth))
    for r in range(rounds):
        for at in rng.permutation(len(ready)):
            n, cands, truth = ready[at]
            if not cands:
                continue
            prob, _ = _expected(n, cands, segment_scores(w, cands))
            step = np.zeros_like(w)
            for (i, j, rows), p in zip(cands, prob):
                gold = truth.get((i, j))
                y = np.zeros(len(KINDS)) if gold is None else np.eye(len(KINDS))[gold]
                step += (y - p)[:, None] * rows
            w += rate / (1 + r) * (step - 0.002 * w)
    return w


def added_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field finds beside the base spans."""
    out = []
    for a, b in windows(text):
        taken = [(s, e) for s, _, e in base if s < b and e > a]
        # base spans are fixed segments, so each stretch between them is decoded on its own
        edges = [a, *(x for s, e in taken for x in (max(s, a), min(e, b))), b]
        for k in range(0, len(edges), 2):
            lo, hi = edges[k], edges[k + 1]
            if hi - lo < 7:
                continue
            tokens = list(TOKEN.finditer(text, lo, hi))
            cands = candidates([m[0] for m in tokens])
            # a stretch may begin or end inside a token of the text
            cands = (c for c in cands if not (c[0] == 0 and lo and text[lo - 1].isalnum() and text[lo].isalnum() or c[1] == len(tokens) and hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum()))
            for i, j, kind in decode(len(tokens), ((i, j, (w * rows).sum(axis=1)) for i, j, rows in cands), margin):
                out.append((tokens[i].start(), kind, tokens[j - 1].end()))
    return out


def all_spans(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, w))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def found(df: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """df with counts and digest of the base spans and all spans; redact: also the text with each span as [KIND]. They replace columns of these names."""
    text_batches(df.sparkSession)
    names = [f"n_{k}" for k in KINDS]
    df = df.drop(*names, "base_sha256", "spans", "n_added", *(["redacted"] if redact else []))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), *([T.StructField("redacted", T.StringType())] if redact else [])])
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    base, every = all_spans(t or "", w)
                    counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), *([redacted(t, every)] if redact else [])))
                kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * redact
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))], schema.names)

    return df.mapInArrow(run, schema)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each stretch of spans replaced by the kind of the first in it; null stays null."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return found(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
