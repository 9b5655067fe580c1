"""Row-level text functions as Spark columns.

White space here is Unicode's, (?U)\\s, in every function that speaks of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHARS_PER_TOKEN


_BLOCK = r"\A\x{FEFF}?---\r?\n((?s:.*?))\r?\n---[ \t]*\r?\n?"


def frontmatter(text: Column) -> Column:
    """The block between --- lines at the very beginning, or null."""
    return F.when(text.rlike(_BLOCK), F.regexp_extract(text, _BLOCK, 1))


def body(text: Column) -> Column:
    """What follows the frontmatter, byte for byte; the whole text without one."""
    return F.regexp_replace(text, _BLOCK, "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line ends as \\n."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def _dashed(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def node_slug(name: Column) -> Column:
    """Lower-case letters and digits joined by dashes; a name without any gets x- and a digest."""
    return F.coalesce(F.nullif(_dashed(name), F.lit("")), F.concat(F.lit("x-"), F.substring(F.sha2(name, 256), 1, 8)))


def heading_slug(title: Column, cap: int = 60) -> Column:
    """As node_slug, at most cap characters, cut at a dash where there is one; may be empty."""
    full = _dashed(title)
    # the last dash within the cap, even where the cap falls on a word's end
    return F.when(F.length(full) <= cap, full).otherwise(F.regexp_replace(F.substring(full, 1, cap), "-[^-]*$", ""))


def heading_path_text(path: Column) -> Column:
    """Slugs of the headings that have one, joined by /."""
    return F.array_join(F.filter(F.transform(path, heading_slug), lambda s: s != ""), "/")


def stable_id(path: Column, declared: Column) -> Column:
    """The declared id if it is a text and not blank, else the path without its last suffix. declared: (kind, value)."""
    text = F.when(declared["kind"] == "str", F.nullif(stripped(declared["value"]), F.lit("")))
    return F.coalesce(text, without_suffix(path))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_suffix(path: Column) -> Column:
    """The path without the last suffix of its name; a name that begins with its only dot has none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


@F.pandas_udf(T.StringType())
def _titled(names: pd.Series) -> pd.Series:
    return names.str.title()


def humanized(stem: Column) -> Column:
    """A name as a title: dashes and underscores as spaces, a capital after everything that is no letter (Rock'N'Roll)."""
    return _titled(stripped(F.regexp_replace(stem, "[-_]+", " ")))


def title_of(declared: Column, stem: Column) -> Column:
    """The declared title unless it is null, empty, zero or false; else the name as a title. declared: (kind, value)."""
    none = declared.isNull() | declared["value"].isNull() | (declared["value"] == "") | ((declared["kind"] != "str") & declared["value"].isin("0", "false"))
    return F.when(none, humanized(stem)).otherwise(declared["value"])


def source_id(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit(":prose"))


def order_value(raw: Column) -> Column:
    """A finite number, else infinity."""
    endless = F.expr("double('Infinity')")
    value = F.trim(raw).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == endless), endless).otherwise(value)


def tie_key(name: Column) -> Column:
    """Siblings of one order stand by name without .md or .mdx, by code point."""
    return F.regexp_replace(name, r"\.mdx?$", "")


def is_document(name: Column) -> Column:
    return name.rlike(r"^.+\.mdx?$")


def dense_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def embed_input(title: Column, heading_path: Column, content: Column) -> Column:
    """What is embedded: a breadcrumb, a blank line, the content."""
    crumb = F.replace(F.replace(heading_path, F.lit("/"), F.lit(" > ")), F.lit("-"), F.lit(" "))
    return F.concat(F.concat_ws(" > ", title, F.nullif(crumb, F.lit(""))), F.lit("\n\n"), content)


def normalized_query(q: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(q, r"(?U)\s+", " "), "^ | $", "")


def est_tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN)


def without_diagrams(text: Column) -> Column:
    """Every svg element, closed in itself or by its tag, as [diagram]; a pair never spans another opening or closing tag."""
    return F.regexp_replace(text, r"(?is)<svg\b[^>]*/>|<svg\b[^>]*>[^<]*+(?:<(?!/?svg\b)[^<]*+)*+</svg>", "[diagram]")


#: Phrases that tell a reader to do something with the text.
DIRECTIVES = (
    r"paste (?:this|the following|it)\b",
    r"copy (?:this|the following)\b",
    r"prompt into your\b",
    r"run (?:this|the following) (?:prompt|command|script)\b",
    r"type the following\b",
    r"give your agent (?:this|the following)\b",
    r"drop (?:this|the following) into\b",
)


def directive_like(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(DIRECTIVES))


def clean_cut(text: Column, limit: int) -> Column:
    """The text within limit characters, cut at the last blank line of the second half where there is one."""
    head, half = F.substring(text, 1, limit), limit // 2
    tail = F.substring(head, half + 1, limit)
    at = F.length(tail) - F.instr(F.reverse(tail), "\n\n")  # 1-based place of the last pair's first character
    paragraph = F.substring(head, F.lit(1), F.lit(half) + at - 1)
    return F.when(F.length(text) <= limit, text).when(F.contains(tail, F.lit("\n\n")), paragraph).otherwise(head)


def yaml_scalar(value: Column) -> Column:
    """A value as a YAML scalar: quoted as JSON where it would be read as something else."""
    risky = F.contains(value, F.lit(": ")) | value.endswith(":") | F.contains(value, F.lit(" #")) | value.rlike(r"^[-?:,\[\]{}#&*!|>'\"%@`]") | (value != stripped(value))
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(risky, quoted).otherwise(value)


def resolved_from(path: Column, relative: Column) -> Column:
    """A relative path seen from the folder of a path, without . and .. in it."""
    steps = F.concat(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.split(relative, "/"))
    walk = F.aggregate(F.filter(steps, lambda p: ~p.isin("", ".")), F.array().cast("array<string>"), lambda at, p: F.when(p == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(p))))
    return F.array_join(walk, "/")


def stays_inside(path: Column, relative: Column) -> Column:
    """Whether a relative path, seen from the folder of a path, never climbs above the root."""
    steps = F.filter(F.split(relative, "/"), lambda p: ~p.isin("", "."))
    start = F.struct((F.size(F.split(path, "/")) - 1).alias("depth"), F.lit(True).alias("inside"))

    def step(at: Column, part: Column) -> Column:
        depth = at["depth"] + F.when(part == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (at["inside"] & (depth >= 0)).alias("inside"))

    return F.aggregate(steps, start, step)["inside"]


#: Fixed values, of Markdown's grammar: a destination may stand in angle brackets and then hold spaces; a title may follow it.
BARE, ANGLED, TITLE = r"[^\s)]+", r"<[^<>\n]*>", r"""(?:"[^"]*"|'[^']*'|\([^)]*\))"""


def _bare(targets: Column) -> Column:
    return F.transform(targets, lambda t: F.when(t.startswith("<") & t.endswith(">"), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t))


def inline_links(body_: Column) -> Column:
    """Destinations of inline links and images, without their brackets."""
    return _bare(F.regexp_extract_all(body_, F.lit(rf"\[[^\]]*\]\(\s*({ANGLED}|{BARE})(?:\s+{TITLE})?\s*\)"), 1))


def link_targets(body_: Column) -> Column:
    """Destinations of inline links and images and of reference definitions, in that order, without their brackets."""
    reference = F.regexp_extract_all(body_, F.lit(rf"(?m)^[ \t]{{0,3}}\[[^\]]+\]:[ \t]*({ANGLED}|\S+)[ \t]*{TITLE}?[ \t]*$"), 1)
    return F.concat(inline_links(body_), _bare(reference))


def code_free(text: Column) -> Column:
    """Markdown without its code: fenced blocks and indented ones go, a code span becomes a space.

    By CommonMark: a fence is closed by one at least as long of the same mark, or by the end. An indented
    line is code where a paragraph would begin, unless it begins a list item. A span ends at a run of as
    many backticks as began it, in its own paragraph.
    """
    # both marks at once, as one may stand in a block of the other
    blocks = [rf"({mark}{{3,}}){info}$(?:\n(?! {{0,3}}\{n}{mark}*[ \t]*$)[^\n]*+)*+(?:\n {{0,3}}\{n}{mark}*[ \t]*$|\z)" for n, mark, info in ((1, "`", r"[^`\n]*"), (2, "~", r"[^\n]*"))]
    lines = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), rf"(?m)^ {{0,3}}(?:{'|'.join(blocks)})\n?", "")
    indented = r"^(?:(?: {4}|\t)(?![ \t]*(?:[-*+]|\d+[.)])\s)[^\n]*(?:\n|$))+"
    span = r"(?s)(?<!`)(`+)(?!`)(?:.*?)(?<!`)\1(?!`)"
    return F.array_join(F.transform(F.split(lines, r"\n(?:[ \t]*\n)+"), lambda p: F.regexp_replace(F.regexp_replace(p, indented, ""), span, " ")), "\n\n")


def is_calendar_date(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & s.try_cast("date").isNotNull(), F.lit(False))


def source_href(entry: Column) -> Column:
    """A whole http(s) url with a host, else null."""
    return F.when(entry.rlike(r"^https?://[^/?#\s]+[^\s]*$") & F.try_parse_url(entry, F.lit("HOST")).isNotNull(), entry)


def markdown_path(url: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(url, "^/docs", "/md"), "/+$", ""), F.lit(".md"))


def ceiling_slices(text: Column, size: int) -> Column:
    """The text in slices of at most size code points, as (ordinal, content), in one pass. Of no text there is one slice, null or empty like it."""
    slices = F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0)).otherwise(F.array(text))
    return F.transform(slices, lambda x, i: F.struct(i.alias("ordinal"), x.alias("content")))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits: the simple text-search configuration."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


@F.pandas_udf(T.StringType())
def _fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else format(v, f".{d}f") for v, d in zip(x, digits)], dtype=object)


def fixed(x: Column, digits: int) -> Column:
    """A double with so many decimals, rounded half to even on its exact binary value: 2.675 is 2.67, 0.0625 is 0.062.

    Spark's own formats round the shortest decimal that reads back as the number, which is another rule.
    """
    return _fixed(x, F.lit(digits))


@F.pandas_udf(T.DoubleType())
def _rounded(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits)], dtype="float64")


def rounded(x: Column, digits: int) -> Column:
    """A double rounded in the same way."""
    return _rounded(x, F.lit(digits))


@F.pandas_udf(T.StringType())
def shortest(x: pd.Series) -> pd.Series:
    """The fewest digits that read back as the double, with a point or an exponent: 1.0, 1e-05."""
    return pd.Series([None if pd.isna(v) else repr(float(v)) for v in x], dtype=object)
