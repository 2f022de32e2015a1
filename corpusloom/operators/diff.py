"""Line diffs of pairs of texts, by longest common subsequences in linear memory.

A pair's lines become numbers. Where the lines that are left on either side are many, a sweep from the
end keeps two rows of the table: how long the common rest is, and where the way from each place
crosses the middle line. The crossing parts the pair in two smaller ones, and so on; so the memory
grows with the lines, and the operations are those that the whole table would give.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a table that is held whole.
WHOLE = 1 << 14
#: Fixed value: a side with more lines is replaced as a whole, unless asked otherwise.
MOST_LINES = 3000
#: Fixed value: unchanged lines that stay beside each change.
CONTEXT = 2


def lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _row(same: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The row of the table above ``below``: how long the common rest is from each column."""
    best = np.maximum(below[:-1], (below[1:] + 1) * same)
    return np.maximum.accumulate(np.append(best, 0)[::-1])[::-1]


def _table(a: np.ndarray, b: np.ndarray) -> str:
    """The way through a small table: ``=`` for a line of both, ``-`` for one that goes, ``+`` for one that comes."""
    rows = [np.zeros(len(b) + 1, np.int64)]
    for x in a[::-1]:
        rows.append(_row(b == x, rows[-1]))
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append("=")
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            out.append("-")
            i += 1
        else:
            out.append("+")
            j += 1
    return "".join(out) + "-" * (len(a) - i) + "+" * (len(b) - j)


def _crossing(a: np.ndarray, b: np.ndarray, middle: int) -> int:
    """The column at which the way from the start comes to row ``middle``."""
    row, cross = np.zeros(len(b) + 1, np.int64), None
    for i in range(len(a) - 1, -1, -1):
        if i == middle - 1:
            cross = np.arange(len(b) + 1)
        same = b == a[i]
        above = _row(same, row)
        if cross is not None:
            # down and right over a common line, down if the rest is as long there, else right
            known = np.append(same | (row[:-1] >= above[1:]), True)
            to = np.append(np.where(same, cross[1:], cross[:-1]), cross[-1])
            at = np.where(known, np.arange(len(known)), len(known))
            cross = to[np.minimum.accumulate(at[::-1])[::-1]]
        row = above
    return int(cross[0])


def way(a: np.ndarray, b: np.ndarray) -> str:
    """The operations that make lines ``b`` of lines ``a`` (as numbers), those lines first that go."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ii, j, jj = todo.pop()
        while i < ii and j < jj and a[i] == b[j]:
            out.append("=")
            i, j = i + 1, j + 1
        if i == ii or j == jj:
            out.append("-" * (ii - i) + "+" * (jj - j))
        elif ii - i == 1 or (ii - i) * (jj - j) <= WHOLE:
            out.append(_table(a[i:ii], b[j:jj]))
        else:
            middle = (ii - i) // 2
            at = j + _crossing(a[i:ii], b[j:jj], middle)
            todo += [(i + middle, ii, at, jj), (i, i + middle, j, at)]
    return "".join(out)


def difference(before: str | None, after: str | None, most: int | None = MOST_LINES) -> list[tuple[str, str]]:
    """``same``, ``add`` or ``del`` and the line, in order. With more than ``most`` lines on a side all go and all come."""
    a, b = lines(before), lines(after)
    if most is not None and max(len(a), len(b)) > most:
        return [("del", x) for x in a] + [("add", x) for x in b]
    number = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    out, i, j = [], 0, 0
    for op in way(np.array([number[x] for x in a], np.int64), np.array([number[x] for x in b], np.int64)):
        if op == "+":
            out.append(("add", b[j]))
        else:
            out.append(("same" if op == "=" else "del", a[i]))
        i, j = i + (op != "+"), j + (op != "-")
    return out


def folded(ops: Iterable[tuple[str, str]], context: int = CONTEXT) -> list[tuple[str, str | None, int]]:
    """``type, text, count``: long runs of unchanged lines become one ``skip`` with their number, but for ``context`` lines beside a change."""
    out: list[tuple[str, str | None, int]] = []
    run: list[str] = []
    edited = False

    def flush(last: bool) -> None:
        front, back = context if edited else 0, 0 if last else context
        if len(run) > front + back + 1:
            hidden = len(run) - front - back
            out.extend(("same", x, 1) for x in run[:front])
            out.append(("skip", None, hidden))
            out.extend(("same", x, 1) for x in run[front + hidden :])
        else:
            out.extend(("same", x, 1) for x in run)
        run.clear()

    for kind, text in ops:
        if kind == "same":
            run.append(text)
        else:
            flush(False)
            edited = True
            out.append((kind, text, 1))
    flush(True)
    return out


def line_diffs(pairs: DataFrame, key: str, before: str, after: str, fold: bool = True, context: int = CONTEXT, most: int | None = MOST_LINES) -> DataFrame:
    """``key, place, type, text, count``: a row for each operation of each pair, in order of ``place``.

    A null text has no lines, like an empty one. Each pair is taken by itself, so a task holds one pair's
    lines beside its batch of rows; equal pairs have no rows when folded but one ``skip``.
    """
    rows = pairs.select(F.col(key).alias("key"), F.col(before).cast("string").alias("before"), F.col(after).cast("string").alias("after"))

    def run(batches):
        for batch in batches:
            for k, a, b in zip(batch["key"], batch["before"].to_pylist(), batch["after"].to_pylist(), strict=True):
                ops = difference(a, b, most)
                got = folded(ops, context) if fold else [(*x, 1) for x in ops]
                if got:
                    kind, text, count = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(got), k.type), pa.array(range(len(got)), pa.int32()), pa.array(kind), pa.array(text, pa.string()), pa.array(count, pa.int64())], [key, "place", "type", "text", "count"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, place int, type string, text string, count long")
