"""Letters and words of many sequences at once: a batch of texts is one array of codes, so that tasks count words and runs by sorts and sums of arrays instead of a pattern match for each place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAIRS

#: Letters whose codes are held at once; a longer sequence is one piece.
LETTERS = 1 << 20
#: Codes: A, C, G, T are 0 to 3, their lower case 4 to 7, any other letter 8.
OTHER = 8
TABLE = np.full(256, OTHER, dtype=np.uint8)
TABLE[list(b"ACGTacgt")] = np.arange(8)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, one after another, and where each begins, with the end; a null is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters of all texts, and where each text begins, with the end; both in code points."""
    raw, at = texts(column)
    first = (raw & 0xC0) != 0x80
    if not first.all():
        raw, at = raw[first], np.concatenate([[0], np.cumsum(first)])[at]
    return TABLE[raw], at


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about LETTERS bytes, one text at least."""
    _, at = texts(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + LETTERS, side="right")) - 1)
        yield first, last
        first = last


def slices(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of n slices of each text begins, with the end: equal lengths, the last takes the rest."""
    width = np.diff(at) // n
    return np.append((at[:-1, None] + width[:, None] * np.arange(n)[None]).ravel(), at[-1])


def parts(at: np.ndarray) -> np.ndarray:
    """The part that each letter is in."""
    return np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))


def counted(code: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the parts that begin at `at`: (part, word, n, total) of each word of k known letters of either case, in that order.

    A word is a number in base four; words do not cross parts. total is the number of words in the part.
    """
    n, part = len(code) - k + 1, parts(at)
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    whole = part[:n] == part[k - 1 :]
    small = (len(at) << (2 * k)) < 1 << 31
    word, letter = np.zeros(n, dtype=np.int32 if small else np.int64), code & 3
    for j in range(k):
        whole &= code[j : n + j] < OTHER
        word = (word << 2) | letter[j : n + j]
    key = (part[:n].astype(word.dtype) << (2 * k) | word)[whole]
    totals = np.bincount(key >> (2 * k), minlength=len(at) - 1)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    held = key[first].astype(np.int64)
    where = held >> (2 * k)
    return where, held & (4**k - 1), np.diff(np.append(first, len(key))), totals[where]


def spelled(word: np.ndarray, k: int) -> pa.Array:
    """Words from their numbers."""
    letter = np.frombuffer(b"ACGT", dtype=np.uint8)[(word[:, None] >> (2 * np.arange(k - 1, -1, -1))[None]) & 3]
    ends = np.arange(len(word) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(word), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letter)))


def runs(code: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, code, length) of the runs of one code inside a part."""
    if not len(code):
        return part, code, np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
    return part[first], code[first], np.diff(np.append(first, len(code)))


def longest(code: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """(n, 4): the longest run of each upper-case letter in each part."""
    where, letter, size = runs(code, part)
    known = letter < 4
    out = np.zeros((n, 4), dtype=np.int64)
    np.maximum.at(out, (where[known], letter[known]), size[known])
    return out


def in_pairs(code: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """Letters in runs of four and more, and in pairs of PAIRS repeated four times and more, each pattern by itself."""
    where, letter, size = runs(code, part)
    held = (letter < 4) & (size >= 4)
    out = np.bincount(where[held], size[held], minlength=n).astype(np.int64)
    if len(code) < 8:
        return out
    together = part[1:] == part[:-1]
    for x, y in {tuple(sorted(map("ACGT".index, p))) for p in PAIRS}:
        one, two = code == x, code == y
        turns = together & ((one[:-1] & two[1:]) | (two[:-1] & one[1:]))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], turns.view(np.int8), [0]])))
        # A stretch of letters that take turns is one longer than its turns.
        first, letters = edge[::2], edge[1::2] - edge[::2] + 1
        long = letters >= 8
        first, letters = first[long], letters[long]
        for p in PAIRS:
            if set(map("ACGT".index, p)) == {x, y}:
                times = (letters - (code[first] != "ACGT".index(p[0]))) // 2
                out += np.bincount(part[first], np.where(times >= 4, 2 * times, 0), minlength=n).astype(np.int64)
    return out


MEASURES = ("n", *"acgt", "cg", "longest", "in_runs", "in_pairs")


def measured(column: pa.Array) -> pa.Array:
    """Of each text: letters, those of A, C, G and T, CG, the longest run, letters in runs of three and more, and those of in_pairs."""
    out = []
    for first, last in pieces(column):
        code, at = codes(column.slice(first, last - first))
        n, part = last - first, parts(at)
        letters = np.bincount(part.astype(np.int64) * (OTHER + 1) + code, minlength=n * (OTHER + 1)).reshape(n, -1)
        cg = (code[:-1] == 1) & (code[1:] == 2) & (part[1:] == part[:-1])
        where, letter, size = runs(code, part)
        held = (letter < 4) & (size >= 3)
        in_runs = np.bincount(where[held], size[held], minlength=n)
        most = longest(code, part, n).max(axis=1, initial=1)
        out.append(np.stack([np.diff(at), *letters[:, :4].T, np.bincount(part[:-1][cg], minlength=n), most, in_runs, in_pairs(code, part, n)]))
    every = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((len(MEASURES), 0), dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(v) for v in every], list(MEASURES))


def measures(s: Column) -> Column:
    """Struct of `measured`, in longs; of a null as of an empty text."""

    def run(column: pa.Array) -> pa.Array:
        return measured(column)

    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    return F.arrow_udf(run, kind)(s)


def listed(sizes: np.ndarray, i: np.ndarray, v: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """array<struct<i, v>> of so many entries each; null where told."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    ends = pa.array(ends, mask=np.append(none, False)) if none is not None and none.any() else pa.array(ends)
    entries = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(v.astype(np.float64))], ["i", "v"])
    return pa.ListArray.from_arrays(ends, entries)


def shares(s: Column, k: int, start: int = 0) -> Column:
    """Entries (i, v) of the known words of k letters: place by the word in base four, share of the words; null gives null."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for first, last in pieces(column):
            piece = column.slice(first, last - first)
            where, word, n, total = counted(*codes(piece), k)
            out.append(listed(np.bincount(where, minlength=last - first), word + start, n / total, piece.is_null().to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(out) if out else listed(np.zeros(0), np.zeros(0), np.zeros(0))

    kind = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())]))
    return F.arrow_udf(run, kind)(s)
