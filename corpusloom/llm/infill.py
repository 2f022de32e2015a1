"""Fill-in-middle transformation on the bytes of whole texts.

A text is cut twice and its three parts are put in another order behind markers, so that a
model learns to fill the middle. All work is on UTF-8 bytes. What a byte place is in code
points, and the other way round, tells a sparse index of exceptions: only characters of
more than one byte are recorded, by their places and by the bytes that they have in
excess; a binary search finds how many stand before a cut, and all else is a subtraction.
Texts in ASCII have an empty index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, utf8

#: What stands before the prefix, the suffix and the middle.
MARKERS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
#: Bytes beyond the first that a character has, by its first byte; 0 for bytes that start none.
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:0xF8] = 1, 2, 3


class Exceptions:
    """The characters of more than one byte in a text."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        excess = _EXCESS[data[lead]]
        #: Excess bytes before each exception, and of all.
        self.before = np.concatenate([[0], np.cumsum(excess)])
        #: Places of the exceptions in bytes and in code points.
        self.byte, self.char = lead, lead - self.before[:-1]

    def chars(self, at):
        """Code points before byte places that start a character or end the text."""
        return at - self.before[np.searchsorted(self.byte, at)]

    def bytes(self, at):
        """Byte places of code points."""
        return at + self.before[np.searchsorted(self.char, at)]


def token_ends(data: np.ndarray) -> np.ndarray:
    """Where the tokens of a text's bytes end: words with the white space before them, and white space at the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    live = ~_SEP[data]
    return np.append(np.flatnonzero(live[:-1] & ~live[1:]) + 1, len(data))


def arranged(text: bytes, form: str, first: int, last: int) -> bytes:
    """The text with its middle, from byte ``first`` to ``last``, at the end."""
    a, b, c = text[:first], text[first:last], text[last:]
    if form == "psm":
        return PREFIX + a + SUFFIX + c + MIDDLE + b
    return SUFFIX + c + PREFIX + a + MIDDLE + b if form == "spm" else text


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` put in a form. Texts with a marker in them stay plain, so each marker is where it is first met."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    a = output.index(second)
    b = output.index(MIDDLE, a)
    one, two, middle = output[3:a], output[a + 3 : b], output[b + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


def _cut(text: bytes, data: np.ndarray, h: list[int], unit: str, rate: int, suffix_first: int) -> tuple:
    """``n, form, first, last`` in bytes, ``first, last`` in code points; the latter four null if plain."""
    index = None
    if unit == "char":
        index = Exceptions(data)
        n = int(index.chars(len(data)))
    else:
        ends = token_ends(data)
        n = len(ends)
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    index = index or Exceptions(data)
    if unit == "char":
        chars = a, b
        first, last = (int(x) for x in index.bytes(np.array(chars)))
    else:
        first, last = (int(ends[x - 1]) if x else 0 for x in (a, b))
        chars = (int(x) for x in index.chars(np.array([first, last])))
    return n, "spm" if h[3] % 100 < suffix_first else "psm", first, last, *chars


#: What ``transform`` can give beside ``doc_id``.
COLUMNS = {
    "n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64()), "prefix_bytes": ("long", pa.int64()), "middle_bytes": ("long", pa.int64()),
    "output": ("string", pa.string()), "output_sha256": ("string", pa.string()), "restored_sha256": ("string", pa.string()),
}


def transform(docs: DataFrame, columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"), unit: str = "token", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id`` and ``columns`` of each row of ``docs`` (doc_id, text), without a shuffle.

    ``n`` is the number of units (``token`` or ``char``), ``form`` plain, psm or spm;
    ``prefix_chars`` and ``middle_chars`` are lengths in code points, ``prefix_bytes`` and
    ``middle_bytes`` in bytes, all null where the text stays plain. ``output`` is the
    transformed text; the sha256 are of its UTF-8 and of the text rebuilt from it.

    Cuts and form follow from the sha256 of ``seed:doc_id``, so repeated rows of an id and
    a text come out alike; a null doc_id counts as an empty one and stays null. Null texts
    are empty; empty texts, and those with a marker in them, stay plain. Texts of any
    length are held one at a time beside their Arrow batch; an empty table gives an empty
    result, and other columns don't matter.
    """
    by_task(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    drawn = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), drawn.alias("h"))

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw, out = memoryview(data), {c: [] for c in columns}
            for k, h in enumerate(batch.column(2).to_pylist()):
                a, b = int(offs[k]), int(offs[k + 1])
                text = bytes(raw[a:b])
                n, form, first, last, c, d = _cut(text, data[a:b], h, unit, rate, suffix_first)
                made = arranged(text, form, first, last)
                plain = form == "plain"
                got = {"n": n, "form": form, "prefix_chars": c, "middle_chars": None if plain else d - c, "prefix_bytes": first, "middle_bytes": None if plain else last - first}
                if "output" in out:
                    got["output"] = made.decode()
                if "output_sha256" in out:
                    got["output_sha256"] = hashlib.sha256(made).hexdigest()
                if "restored_sha256" in out:
                    got["restored_sha256"] = hashlib.sha256(restored(made, form)).hexdigest()
                for name, values in out.items():
                    values.append(got[name])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, COLUMNS[c][1]) for c, v in out.items())], ["doc_id", *columns])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))


#: What the query reports.
REPORT = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")

#: DuckDB SQL with the rows of ``transform(documents, REPORT)``.
REPORT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, CAST('0x' || s[1:8] AS UBIGINT) AS h1, CAST('0x' || s[9:16] AS UBIGINT) AS h2, CAST('0x' || s[17:24] AS UBIGINT) AS h3, CAST('0x' || s[25:32] AS UBIGINT) AS h4 FROM d),
f AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
