"""Vectorised scanning of Arrow string columns: characters, words and rolling hashes as numpy arrays."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

TOP = 0x110000
#: Code points from here on (rare ideographs, tags, private use) neither fold nor count as space, punctuation or symbol.
LATE = 0x20000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows in a row, offset of each row's first one); null rows have none.

    Bytes that are no valid UTF-8 count as U+FFFD.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
    try:
        codes = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(starts)])
        return codes, before[offsets - offsets[0]]
    except UnicodeDecodeError:
        rows = [bytes(raw[a - offsets[0] : b - offsets[0]]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@cache
def _skips() -> np.ndarray:
    """True for code points that don't count: white space, punctuation and symbols."""
    out = np.zeros(TOP, bool)
    out[:LATE] = [unicodedata.category(c := chr(i))[0] in "PSZ" or c.isspace() for i in range(LATE)]
    return out


@cache
def word_table() -> np.ndarray:
    """For each code point 0 if it stands between words, else its folded code point."""
    table = np.arange(TOP, dtype=np.uint32)
    table[:LATE] = 0
    for i in range(LATE):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            table[i] = ord(c.lower()[0])
    return table


@cache
def _fold_tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """(contribution of each code point, its steps, the base) of a rolling hash; skipped code points have 0 steps.

    A code point that folds to several ones (such as sharp s) contributes all of them in one lookup.
    """
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & (2**64 - 1))
    own = mix(np.arange(TOP, dtype=np.uint64) + np.uint64(seed * 0x5851F42D4C957F2D & (2**64 - 1)))
    value, steps = own.copy(), np.ones(TOP, np.int64)
    for i in range(LATE):
        c = chr(i)
        f = c.casefold()
        if f != c:
            total = np.uint64(0)
            for k in reversed(f):
                with np.errstate(over="ignore"):
                    total = total * base + own[ord(k)]
            value[i], steps[i] = total, len(f)
    skip = _skips()
    value[skip], steps[skip] = 0, 0
    return value, steps, base


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def folded_hashes(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rolling polynomial hash, counted length) of each row under skip-and-fold; no canonical string is made."""
    codes, rows = characters(column)
    value, steps, base = _fold_tables(seed)
    step = steps[codes]
    at = np.concatenate([[0], np.cumsum(step)])
    length = at[rows[1:]] - at[rows[:-1]]
    exponent = at[:-1] - np.repeat(at[rows[:-1]], np.diff(rows))
    terms = value[codes] * powers(base, int(length.max(initial=0)) + 1)[exponent]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return sums[rows[1:]] - sums[rows[:-1]], length


def _folds(c: str) -> str:
    return "" if unicodedata.category(c)[0] in "PSZ" or c.isspace() else c.casefold()


def same_but_for_writing(a: str | None, b: str | None) -> bool:
    """Two-pointer comparison that skips what doesn't count and folds case; null equals null only."""
    if a is None or b is None:
        return a is b
    i = j = 0
    held_a = held_b = ""
    while True:
        if not held_a and not held_b:
            while i < len(a) and a[i : i + 64] == b[j : j + 64] and j < len(b):  # equal stretches need no folding
                i, j = i + 64, j + 64
        while not held_a and i < len(a):
            held_a, i = _folds(a[i]), i + 1
        while not held_b and j < len(b):
            held_b, j = _folds(b[j]), j + 1
        if not held_a or not held_b:
            return not held_a and not held_b
        if held_a[0] != held_b[0]:
            return False
        held_a, held_b = held_a[1:], held_b[1:]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offset of each row's first word, start and end of each word in code points).

    Words are runs of letters, digits and marks, in lower case; all else stands between words. Start and
    end count from the first row's first code point.
    """
    codes, rows = characters(column)
    folded = word_table()[codes]
    inside = folded > 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = rows[1:-1]
    split = cuts[(cuts > 0) & (cuts < len(codes))]
    split = split[inside[split] & inside[split - 1]] if len(split) else split
    if len(split):  # a word that ends a row and one that begins the next
        split = np.unique(split)
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    base = np.uint64(0x9E3779B97F4A7C15)
    length = ends - starts
    at = np.cumsum(np.concatenate([[0], inside]))
    kept = folded[inside].astype(np.uint64)
    first = at[starts]
    exponent = np.arange(len(kept)) - np.repeat(first, length)
    terms = mix(kept) * powers(base, int(length.max(initial=0)) + 1)[exponent]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    hashes = mix(sums[first + length] - sums[first]) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, rows), starts, ends


def pieces(batch: pa.RecordBatch, *columns: int, limit: int = 500_000) -> list[pa.RecordBatch]:
    """The batch cut into slices of about `limit` bytes of text in all these columns, or of one row where a row has more."""
    lengths = sum((pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns), np.ones(batch.num_rows, np.int64))
    at = np.concatenate([[0], np.cumsum(lengths)])
    out, i = [], 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        out.append(batch.slice(i, j - i))
        i = j
    return out
