"""Words of whole Arrow text columns, hashed in numpy without a Python string each.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z. Its hash is a
polynomial in the bytes modulo 2**64 over a fixed random table, mixed at the end, so
the hash of a prefix costs no second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the working memory whatever the length of a text.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = _BYTE[_FOLD]
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; nulls are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def windows(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = _SEP) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK bytes that end where no word is cut."""
    a, end = int(offs[0]), int(offs[-1])
    while a < end:
        b = min(a + CHUNK, end)
        if b < end:
            i = int(np.searchsorted(offs, b, "right")) - 1
            row = int(offs[i])
            cuts = np.flatnonzero(sep[data[max(a, row) : b]])
            if row > a and not len(cuts):
                b = row
            elif len(cuts):
                b = max(a, row) + int(cuts[-1]) + 1
            else:  # one word longer than a chunk: to its end
                stop = int(offs[i + 1])
                more = np.flatnonzero(sep[data[b:stop]])
                b = b + int(more[0]) + 1 if len(more) else stop
        yield a, b
        a = b


def words(texts: pa.Array, prefixes: tuple[int, ...] = (), sep: np.ndarray = _SEP) -> tuple[np.ndarray, ...]:
    """Word hashes of all rows in order, the offsets of the rows in them, and for each
    asked length the hashes of the words' prefixes (0 for words no longer than it). ``sep`` marks the bytes that part words."""
    data, offs = utf8(texts)
    got: list[list[np.ndarray]] = [[] for _ in range(2 + len(prefixes))]
    for a, b in windows(data, offs, sep):
        part = data[a:b]
        live = ~sep[part]
        first = live.copy()
        first[1:] &= ~live[:-1]
        edges = offs[np.searchsorted(offs, a, "left") : np.searchsorted(offs, b, "left")] - a
        edges = edges[edges < len(part)]
        first[edges] = live[edges]
        last = live.copy()
        last[:-1] &= ~live[1:] | first[1:]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        length = (stop - start).astype(np.uint64)
        got[0].append(mix((total[stop] - total[start]) * down[start] + length))
        got[1].append(start + a)
        for k, n in enumerate(prefixes):
            cut = np.minimum(start + n, stop)
            h = mix((total[cut] - total[start]) * down[start] + _U(n), 7 + n)
            got[2 + k].append(np.where(stop - start > n, h, _U(0)))
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64 if k == 1 else np.uint64) for k, x in enumerate(got)]
    bounds = np.searchsorted(flat[1], offs, "left")
    return flat[0], bounds, *flat[2:]


def shingles(word: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, sorted; of the whole if shorter."""
    n = len(word)
    if not n:
        return word
    w = min(width, n)
    h = np.zeros(n - w + 1, np.uint64)
    for i in range(w):
        h = h * _U(0xD6E8FEB86659FD93) + word[i : n - w + 1 + i]
    return np.unique(mix(h, 3 if w == width else 100 + w))


def by_task(spark, rows: int = 512) -> None:
    """Holds the rows of an Arrow batch low enough that very long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
