"""Frontmatter: a narrow grammar of top-level scalars and one list shape, and governance keys from it."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = re.compile(r"\ufeff?---\r?\n(.*?)\r?\n---[ \t]*\r?\n?", re.S)

#: The words that YAML 1.1 reads as booleans and as null.
TRUE_WORDS = ("yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON")
FALSE_WORDS = ("no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF")
NULL_WORDS = ("", "~", "null", "Null", "NULL")


class Unreadable(ValueError):
    """A line that YAML would refuse, or a key that must not be guessed."""


class Value(NamedTuple):
    """What a line says: its kind (str, bool, int, float, null) and the value."""

    kind: str
    value: object

    @property
    def text(self) -> str | None:
        if self.kind == "null":
            return None
        if self.kind == "float" and self.value.is_integer():
            return str(int(self.value))
        return str(self.value).lower() if self.kind == "bool" else str(self.value)


def _words(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


#: Characters up to a comment.
_PLAIN = r"(?:(?![ \t]+\#).)*?"
#: The scalars of a line as one alternation: the name of the alternative that takes all of it is its kind.
_SCALAR = re.compile(
    r'"(?P<double>.*)"'
    r"|'(?P<single>.*)'"
    rf"|(?:(?P<null>{_words(NULL_WORDS)})|(?P<bool>{_words(TRUE_WORDS + FALSE_WORDS)})"
    r"|(?P<int>[-+]?[0-9][0-9_]*)"
    r"|(?P<float>[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    rf"|(?P<node>[|>&*!{{\[]{_PLAIN})"
    rf"|(?P<mapping>{_PLAIN}:(?:[ \t]{_PLAIN})?)"
    rf"|(?P<str>{_PLAIN}))(?:[ \t]+(?:\#.*)?)?",
    re.S,
)
#: How the text of each alternative becomes a value; block, flow and alias nodes are beyond this grammar and count as null.
_READ = {
    "double": lambda t: Value("str", re.sub(r'\\(["\\])', r"\1", t)),
    "single": lambda t: Value("str", t.replace("''", "'")),
    "null": lambda t: Value("null", None),
    "node": lambda t: Value("null", None),
    "bool": lambda t: Value("bool", t in TRUE_WORDS),
    "int": lambda t: Value("int", int(t.replace("_", ""))),
    "float": lambda t: Value("float", float(t.replace("_", ""))),
    "str": lambda t: Value("str", t),
}
#: A line at the left margin: nothing, a comment, or a key with what follows it.
_LINE = re.compile(r"(?P<skip>\s*(?:\#.*)?|[ \t].*)|(?P<key>[^\s:]+):(?:[ \t]+(?P<rest>.*))?")


def split(text: str) -> tuple[str | None, str]:
    """The block and the body; a text without a block is all body."""
    found = _BLOCK.match(text)
    return (found[1], text[found.end() :]) if found else (None, text)


def read_value(raw: str) -> Value:
    """The value of a scalar, with its kind."""
    found = _SCALAR.fullmatch(raw.strip())
    kind = found.lastgroup if found else "mapping"
    if kind == "mapping":
        raise Unreadable(raw)
    return _READ[kind](found[kind])


def scalar(raw: str):
    """The value of a scalar: str, bool, int, float or None."""
    return read_value(raw).value


def values(text: str) -> dict[str, Value]:
    """Top-level scalars with their kinds; one line that can't be read empties the map."""
    lines = [_LINE.fullmatch(line) for line in re.split(r"\r?\n", split(text)[0] or "")]
    try:
        return {} if None in lines else {m["key"]: read_value(m["rest"] or "") for m in lines if m["key"]}
    except Unreadable:
        return {}


def meta(text: str) -> dict:
    return {k: v.value for k, v in values(text).items()}


def list_values(text: str, key: str) -> list[str] | None:
    """The items of a block list under the key, or None."""
    items, inside = [], False
    for line in re.split(r"\r?\n", split(text)[0] or ""):
        item = re.fullmatch(r"[ \t]*-[ \t]+(.*)", line)
        if inside and item:
            items.append(item[1].strip().removeprefix('"').removeprefix("'").removesuffix('"').removesuffix("'").strip())
        elif items:
            break
        else:
            inside = line.rstrip(" \t") == f"{key}:"
    return [i for i in items if i] or None


def governance(text: str) -> dict:
    """visibility, doc_status, owner, provenance and superseded_by; a visibility that can't be read raises."""
    known = values(text)

    def word(key: str) -> str | None:
        found = known.get(key)
        return found.value.strip() or None if found and found.kind == "str" else None

    def listed(key: str) -> list[str] | None:
        return list_values(text, key)

    named = any(line.startswith("visibility:") for line in (split(text)[0] or "").splitlines())
    if named and (word("visibility") is None or listed("visibility")):
        raise Unreadable("visibility must be one readable value: an unreadable tier would count as none")
    one = word("provenance")
    return {"visibility": word("visibility"), "doc_status": word("status"), "owner": word("owner"), "provenance": listed("provenance") or (one and [one]), "superseded_by": word("superseded_by")}


def order_number(value) -> float:
    """A declared order as a number; infinity where there is none."""
    try:
        number = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else math.inf
    except ValueError:
        return math.inf
    return number if math.isfinite(number) else math.inf


META = T.MapType(T.StringType(), T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
GOVERNANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("visibility", "doc_status", "owner")] + [T.StructField("provenance", T.ArrayType(T.StringType())), T.StructField("superseded_by", T.StringType()), T.StructField("problem", T.StringType())])


@F.udf(META, useArrow=True)
def meta_of(text):
    """Scalars as (kind, text): booleans as true and false, nulls without a text."""
    return None if text is None else {k: (v.kind, v.text) for k, v in values(text).items()}


@F.udf(GOVERNANCE, useArrow=True)
def governance_of(text):
    """Governance keys, or why they can't be read: rows with a problem must not be served."""
    try:
        return {**governance(text or ""), "problem": None}
    except Unreadable as e:
        return {**dict.fromkeys(("visibility", "doc_status", "owner", "provenance", "superseded_by")), "problem": str(e)}
