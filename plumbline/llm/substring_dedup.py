"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes: it takes one shift and one addition a byte, and its upper bits depend on the last 16
bytes only. Where they are zero, a chunk ends; so what stands in a passage decides where it is cut, and an insertion before
it shifts the bytes but not the cuts. A stretch without such places (text that repeats a short period, mostly) is cut where its hash is
greatest, which is the same place in every period. Chunks are deduplicated by a 96-bit digest: the first occurrence (in the order of
identifiers) stays, the others can go. Single repeated chunks are left alone; a run of them with at least `min_words` words is
a repeated passage and is cut out.

Occurrences are merged in levels: those of a slice of text, then those of a task, in which the commonest chunks wait for all its later
slices, and last those of a digest. Each level sends only the first of them on and settles the others where they are; so the most
common chunk reaches its digest's task about once for each task that reads texts, whatever the number of its occurrences.

Null and empty texts have no chunks, and come back as they are; so does a text that no other shares a passage with. An empty table gives an
empty result. Texts may be of any length. Of the other columns none is read, whatever their names. Rows alike in
identifier (null too) are told apart by the order in which they were read, so of alike rows the first read stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, concatenate, mix64, sliced
from plumbline.plans.storage import Scratch

_WINDOW = 16
_CUT_BITS = 4
_NEAREST = 8
_LONGEST = 512
_STEP = 64
#: Chunks of a task that wait to be merged, and how many of the commonest wait on for its later slices.
_HELD, _COMMON = 1 << 19, 1 << 16

#: One random 16-bit value for each byte.
_GEAR = (mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2*h[i-1] + GEAR[data[i]] modulo 2**16, for all i; by doubling the window four times instead of a loop."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint16(width)
        h = h + shifted
    return h


def _stretch_ends(data: np.ndarray, h: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Where to cut a stretch in which no hash ends a chunk. In text of a period each cut is a number of periods from the one before."""
    ends = []
    while end - begin > _LONGEST:
        inside = (data[begin + _STEP : begin + _LONGEST + 1] & 0xC0) == 0x80
        begin += _STEP + int(np.argmax(np.where(inside, -1, h[begin + _STEP - 1 : begin + _LONGEST].astype(np.int32))))
        ends.append(begin)
    return np.array(ends, np.int64)


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of concatenated texts end, and the text that each belongs to.

    starts: where texts begin, with the end of the last; each text is followed by one separator, which belongs to no chunk.
    A cut needs `_CUT_BITS` zero bits, no other such place in the `_NEAREST` bytes before, and a character's end. Of a stretch of over
    `_LONGEST` bytes, the first of the greatest hashes at `_STEP` to `_LONGEST` bytes from its begin ends a chunk, until it is no longer.
    """
    if len(starts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear_hash(data)
    found = np.flatnonzero(h >> np.uint16(16 - _CUT_BITS) == 0) + 1
    text = np.searchsorted(starts, found, side="left") - 1
    # only places whose window lies in the text count, so that its neighbours have no say
    own = found - starts[text] >= _WINDOW
    found, text = found[own], text[own]
    far = np.append(True, (np.diff(found) >= _NEAREST) | (text[1:] != text[:-1]))[: len(found)]
    cut = found[far & (found < starts[text + 1] - 1)]
    cut = cut[(data[cut] & 0xC0) != 0x80]
    ends = starts[1:] - 1
    cut = np.union1d(cut, ends[ends > starts[:-1]])
    owner = np.searchsorted(starts, cut, side="left") - 1
    begin = np.where(np.append(-1, owner[:-1]) == owner, np.append(0, cut[:-1]), starts[owner])
    long = np.flatnonzero(cut - begin > _LONGEST)
    if len(long):
        extra = np.concatenate([_stretch_ends(data, h, int(begin[i]), int(cut[i])) for i in long])
        cut = np.union1d(cut, extra)
        owner = np.searchsorted(starts, cut, side="left") - 1
    return cut, owner


_POSTED = "digest long, key long, place long"
_LATER = 2
_Chunks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _first_and_later(parts: list[_Chunks]) -> tuple[_Chunks, np.ndarray, np.ndarray]:
    """(digest, check, key, at, times) of each chunk's first occurrence, with the sum of `times`; key and mark of the others, which can go."""
    digest, check, key, at, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((at, key, check, digest))
    digest, check, key, at, times = (c[order] for c in (digest, check, key, at, times))
    new = np.append(True, (digest[1:] != digest[:-1]) | (check[1:] != check[:-1]))
    first = np.flatnonzero(new)
    return (digest[first], check[first], key[first], at[first], np.add.reduceat(times, first)), key[~new], at[~new] * 2 + 1


def _rows(digest: np.ndarray, check: np.ndarray, key: np.ndarray, at: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    """place: 32 more bits of the digest, 30 bits for the chunk's number in its text, and its state: met again (1), `_LATER`, or neither (0)."""
    place = check.astype(np.int64) << 32 | at.astype(np.int64) << 2 | state
    return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(key), pa.array(place)], ["digest", "key", "place"])


def _sent(firsts: _Chunks, key: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the digests' tasks, and rows, dealt by document, for chunks that need no other task's answer."""
    yield _rows(*firsts[:4], firsts[4] > 1)
    yield _rows(mix64(key.view(np.uint64)).view(np.int64), np.zeros(len(key), np.int32), key, mark >> 1, np.full(len(key), _LATER))


def _chunks_of(batch: pa.RecordBatch) -> _Chunks | None:
    data, starts = concatenate(batch.column("t").to_pylist())
    cut, owner = chunk_ends(data, starts)
    if not len(cut):
        return None
    fresh = np.append(True, owner[1:] != owner[:-1])
    begin = np.where(fresh, starts[owner], np.append(0, cut[:-1]))
    first = np.flatnonzero(fresh)
    at = np.arange(len(cut)) - np.repeat(first, np.diff(np.append(first, len(cut))))
    raw, digest128 = memoryview(data), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest128(raw[a:z]) for a, z in zip(begin.tolist(), cut.tolist(), strict=True)]), np.int64)
    return both[0::2], both[1::2].astype(np.int32), batch.column("key").to_numpy()[owner], at.astype(np.int32), np.ones(len(cut), np.int32)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct chunk's first occurrence, and one, dealt by its document, for each later one. A task holds `_HELD` chunks and one slice."""
    parts: list[_Chunks] = []
    for batch in sliced(batches, "t", 4 << 20):
        if (chunks := _chunks_of(batch)) is None:
            continue
        parts.append(chunks)
        if sum(len(p[0]) for p in parts) < _HELD:
            continue
        firsts, key, mark = _first_and_later(parts)
        again = np.flatnonzero(firsts[-1] > 1)
        waits = np.zeros(len(firsts[0]), bool)
        waits[again[np.argsort(-firsts[-1][again], kind="stable")[:_COMMON]]] = True
        parts = [tuple(c[waits] for c in firsts)]
        yield from _sent(tuple(c[~waits] for c in firsts), key, mark)
    if parts:
        yield from _sent(*_first_and_later(parts))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, mark) of each repeated chunk of one partition of digests: mark is its place in the text, doubled, plus 1 if it can go."""
    parts, keys, marks = [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        digest, key, place = (batch.column(c).to_numpy() for c in ("digest", "key", "place"))
        at, state = ((place & 0xFFFFFFFF) >> 2).astype(np.int32), (place & 3).astype(np.int32)
        later = state == _LATER
        keys.append(key[later])
        marks.append(at[later] * 2 + 1)
        first = ~later
        if first.any():
            parts.append((digest[first], (place[first] >> 32).astype(np.int32), key[first], at[first], state[first] + 1))
    if parts:
        (_, _, key, at, times), later, mark = _first_and_later(parts)
        keys += [key[times > 1], later]
        marks += [at[times > 1] * 2, mark]
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(marks).astype(np.int32))], ["key", "mark"])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RESULT = "key long, n_chunks int, n_repeated int, repeated array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>, kept_text string"


def _runs(text: bytes, begin: np.ndarray, end: np.ndarray, chosen: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Byte spans of maximal runs of chosen chunks that hold at least min_words words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], chosen.astype(np.int8), [0]])))
    spans = [(int(begin[a]), int(end[z - 1])) for a, z in zip(edge[0::2], edge[1::2], strict=True)]
    return [(a, z) for a, z in spans if len(text[a:z].split()) >= min_words]


def _in_characters(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": len(text[:a].decode("utf-8", "surrogatepass")), "end": len(text[:z].decode("utf-8", "surrogatepass"))} for a, z in spans]


def _cleaned(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "t"):
        texts, marks = batch.column("t").to_pylist(), batch.column("marks").to_pylist()
        data, starts = concatenate(texts)
        cut, owner = chunk_ends(data, starts)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        n_chunks, n_repeated, repeated, removed, kept = [], [], [], [], []
        for i, (text, own) in enumerate(zip(texts, marks, strict=True)):
            n = int(first[i + 1] - first[i])
            n_chunks.append(n)
            n_repeated.append(len(own or ()))
            if not own:
                repeated.append([])
                removed.append([])
                kept.append(text)
                continue
            raw = data[starts[i] : starts[i + 1] - 1].tobytes()
            end = cut[first[i] : first[i + 1]] - starts[i]
            begin = np.append(0, end[:-1])
            again, can_go = np.zeros(n, bool), np.zeros(n, bool)
            marked = np.array(own)
            again[marked >> 1] = True
            can_go[marked[marked & 1 == 1] >> 1] = True
            out = _runs(raw, begin, end, can_go, min_words)
            repeated.append(_in_characters(raw, _runs(raw, begin, end, again, min_words)))
            removed.append(_in_characters(raw, out))
            keep, at = [], 0
            for a, z in out:
                keep.append(raw[at:a])
                at = z
            kept.append(b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass"))
        columns = [batch.column("key"), pa.array(n_chunks, pa.int32()), pa.array(n_repeated, pa.int32()), pa.array(repeated, _SPAN), pa.array(removed, _SPAN), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n_chunks", "n_repeated", "repeated", "removed", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Per row: id_col, n_chunks, n_repeated, repeated and removed (spans of characters), and kept_text.

    repeated: passages of at least min_words words that occur elsewhere too; removed: those that occur earlier and so are
    cut out of kept_text. The marks are joined back to the texts by a plain join, so Spark broadcasts them only if the
    table that holds them is small; else the texts are shuffled once. Nearly all documents have some repeated chunk, so no filter
    in front of that join would spare them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("t"))
    facts = source.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("ids"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    unique = facts["n"] == facts["ids"]
    if not unique:
        # identifiers don't tell the rows apart: number them, in a table, so that the numbers stay
        source = scratch.table(source.select(F.col("key").alias("id"), "t", F.monotonically_increasing_id().alias("key")), "rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts["bytes"] // (32 << 20)))
    posted = source.select("key", F.coalesce("t", F.lit("")).alias("t")).mapInArrow(_posted, _POSTED)
    marks = posted.repartition(parts, "digest").mapInArrow(_settled, "key long, mark int")
    marked = scratch.table(marks.groupBy("key").agg(F.collect_list("mark").alias("marks")), "marks")
    joined = source.join(marked, "key", "left").select("key", "t", "marks")
    cleaned = joined.mapInArrow(partial(_cleaned, min_words=min_words), _RESULT)
    if not unique:
        names = scratch.table(source.select("key", "id"), "names")
        cleaned = cleaned.join(names, "key").drop("key").withColumnRenamed("id", "key")
    return cleaned.select(F.col("key").alias(id_col), "n_chunks", "n_repeated", "repeated", "removed", "kept_text")
