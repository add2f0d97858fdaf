"""Vectorised byte-level text helpers shared by the corpus operators.

All of them take a list of texts (one Arrow batch) and work on one concatenated byte buffer, so
the cost per byte is a few NumPy operations and no Python object is made for a word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)

#: ASCII white space as the word pattern `[^\x20\x09-\x0D]+` sees it.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte unchanged (UTF-8 continuation bytes are never in A-Z).
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (xor-shift-multiply), so that sums stay well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the life of the Python worker and grown by doubling."""
    n = int(n)
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, (n - 1).bit_length())
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def bound_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Lets the session send Python no larger batches than `max_bytes`: Spark's own bound of 64 MB is held several times by each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # a session's own choice stays
        spark.conf.set(key, f"{max_bytes}b")


def sliced(batches: Iterable[pa.RecordBatch], text_col: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `max_bytes` of text (a longer text is a slice of its own), to bound a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def concatenate(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one blank, and the offset where each begins (one more at the end)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8) if parts else np.zeros(0, np.uint8), starts


def word_spans(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words, the runs of bytes that are not blank, begin and end."""
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    return begin, np.append(end, len(blank)) if len(end) < len(begin) else end


def hash_words(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: polynomials in their bytes' random values modulo 2**64, scrambled at the end.

    A hash depends on the word alone and not on where it stands.
    """
    hashes = np.empty(len(begin), np.uint64)
    step = 1 << 18  # words are hashed in slices, so that the temporary arrays stay small
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + step)))
        a, z = begin[lo], end[hi - 1]
        run = np.empty(z - a + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE_VALUES[low[a:z]] * _power_table(_RADIX, z - a), out=run[1:])
        s, e = begin[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = (run[e] - run[s]) * _power_table(_RADIX_INVERSE, z - a)[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix64(hashes)


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z only) words `[^\\x20\\x09-\\x0D]+`, and each text's first word's index."""
    raw, starts = concatenate(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    low = np.frombuffer(raw.tobytes().translate(LOWER_ASCII), np.uint8)
    begin, end = word_spans(_SPACE[low])
    return hash_words(low, begin, end), np.searchsorted(begin, starts)


def shingles_of(texts, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `width`-word shingles; the whole sequence if it has fewer words.

    A text without words gives an empty array.
    """
    words, first = words_of(texts)
    if not len(words):
        return [np.zeros(0, np.uint64) for _ in range(len(first) - 1)]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    full = np.zeros(len(words), np.uint64)
    for i in range(width):
        full = full * np.uint64(_RADIX) + padded[i : i + len(words)]
    full = mix64(full + np.uint64(width))
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(full[a : z - width + 1]))
        elif z > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:z]:
                h = h * np.uint64(_RADIX) + w
            out.append(mix64(h + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
