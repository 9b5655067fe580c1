"""Windows of a document: whole sections within a budget, and the cursor to what comes next."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from ..config import DOCUMENT_BUDGET_CHARS


def _top(path: str, levels: int = 1) -> str:
    return "/".join(path.split("/")[:levels])


def _under(path: str, heading: str) -> bool:
    return path == heading or path.startswith(heading + "/")


_NUMBERED = re.compile(r".*#([0-9]+)", re.DOTALL)


def start_of(paths: list[str], cursor: str | None) -> int:
    """The place that a cursor names: the number behind its #, else the first chunk of its section; the beginning without one."""
    named = _NUMBERED.fullmatch(cursor or "")
    at = int(named[1]) if named else next((i for i, p in enumerate(paths) if not cursor or _under(p, cursor)), len(paths))
    if cursor and at >= len(paths):
        raise ValueError(f"the document has no place {cursor!r}")
    return at if cursor else 0


def _fitting(sizes: list[list[int]], budget: int) -> int:
    """How many of the first groups fit whole; a group is its chunks' sizes."""
    spent = 0
    for n, group in enumerate(sizes):
        spent += sum(group)
        if spent > budget:
            return n
    return len(sizes)


def window_end(paths: list[str], sizes: list[int], budget: int, start: int) -> int:
    """Where the window from `start` ends: whole top sections, else whole parts of the first, else whole chunks, at least one."""
    lo, hi = start, len(paths)
    for levels in (1, 2):
        groups = [[i for _, i in g] for _, g in groupby(((_top(paths[i], levels), i) for i in range(lo, hi)), key=lambda x: x[0])]
        n = _fitting([[sizes[i] for i in g] for g in groups], budget)
        if n:
            return groups[n - 1][-1] + 1
        hi = groups[0][-1] + 1
    return lo + max(1, _fitting([[sizes[i]] for i in range(lo, hi)], budget))


def cursor_at(paths: list[str], at: int) -> str | None:
    """The cursor to a position; a bare heading where it alone leads there."""
    if at >= len(paths):
        return None
    first = next(i for i, p in enumerate(paths) if _under(p, paths[at]))
    return paths[at] if paths[at] and first == at else f"{paths[at]}#{at}"


def windows(paths: list[str], sizes: list[int], budget: int) -> list[tuple[int, int, str | None]]:
    """All windows of a document: start, end and the cursor to the next."""
    out, at = [], 0
    while at < len(paths):
        end = window_end(paths, sizes, budget, at)
        out.append((at, end, cursor_at(paths, end)))
        at = end
    return out


def windowed(chunks: DataFrame, key: str, budget: int = DOCUMENT_BUDGET_CHARS, order: str = "ordinal", path: str = "heading_path_text", size: str = "chars") -> DataFrame:
    """Windows of every document: key, window, start, end, chars, next_cursor.

    One document's chunk sizes meet in a task, not their texts.
    """
    kind = chunks.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        paths, sizes = [p or "" for p in pdf[path]], [int(s) for s in pdf[size]]
        rows = [(pdf[key].iloc[0], n, a, b, sum(sizes[a:b]), c) for n, (a, b, c) in enumerate(windows(paths, sizes, budget))]
        return pd.DataFrame(rows, columns=[key, "window", "start", "end", "chars", "next_cursor"])

    return chunks.select(key, order, path, size).groupBy(key).applyInPandas(one, f"{key} {kind}, window long, start long, end long, chars long, next_cursor string")
