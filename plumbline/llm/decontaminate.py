"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are cut into lower-cased words, and the search runs on words instead of characters. Patterns are the windows
of `window` consecutive words of each benchmark item (an item with fewer words is one window). For each pattern length:

* a shift table, looked up by the hash of a block of two words, tells how far the block's last place is from the end of the
  patterns that hold it; a block that is in no pattern lets the search jump over the whole window;
* where the shift is 0, the patterns that end with that block are in a bucket of its hash, in the order of their own hashes,
  and those with the hash of the window at hand are picked from it;
* each of them is compared with the text, byte for byte, which confirms the occurrence.

The search moves many cursors at once, each through a stretch of a text. Its tables are arrays: the benchmark's words once,
and some 20 bytes for each window. The benchmark is searched in parts of about `part_bytes` of text (all items with one id are
in one part). With a single part the documents are read once and nothing is shuffled. With several, the texts are numbered in a table;
each part's pass over it writes what it found and its tables are given up before the next part is built, so that only one
part is ever held, by the driver or a task.

Documents may be of any length; null, empty and wordless documents have no words and no hits; null items or items without words match
nothing. Repeated rows are judged alike; an item id that stands on several rows is one item. Of the other columns, those
named in `keep` are carried along; by default all, but for those that have a result's name. Empty tables give an empty result,
or no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, concatenate, hash_words, mix64, sliced, word_spans
from plumbline.plans.storage import Scratch

_PART_BYTES = 16 << 20
_STRETCH = 128
_BLOCK_RADIX = np.uint64(0x9E3779B97F4A7C15)
_WINDOW_RADIX = np.uint64(0xD6E8FEB86659FD93)

#: Digits, letters (A-Z lower-cased) and every byte of a non-ASCII character stay; all else separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class Words:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts after lower-casing A-Z.

    data: their bytes, with one blank between two words; begin, end: where each lies; hashes; first: each text's first word.
    """

    def __init__(self, texts: Sequence[str | None]):
        raw, starts = concatenate(texts)
        low = np.frombuffer(raw.tobytes().translate(_WORD_BYTES), np.uint8)
        blank = low == 32
        keep = ~blank
        keep[1:] |= keep[:-1]
        self.data = low[keep]
        self.begin, self.end = word_spans(self.data == 32)
        self.hashes = hash_words(self.data, self.begin, self.end)
        self.first = np.searchsorted(self.begin, np.concatenate([[0], np.cumsum(keep)])[starts]) if len(texts) else np.zeros(1, np.int64)

    def blocks(self, ends: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the blocks of one or two words that end at words `ends` (exclusive)."""
        last = self.hashes[ends - 1]
        return mix64(last if size == 1 else self.hashes[ends - 2] * _BLOCK_RADIX + last)

    def windows(self, ends: np.ndarray, length: int) -> np.ndarray:
        total = np.zeros(len(ends), np.uint64)
        for i in range(length, 0, -1):
            total = total * _WINDOW_RADIX + self.hashes[ends - i]
        return mix64(total)

    def span(self, end: int, length: int) -> bytes:
        return self.data[self.begin[end - length] : self.end[end - 1]].tobytes()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), one after the other, and the range that each is of."""
    size = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


def _places(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, behind: bool) -> np.ndarray:
    """Per entry of `wanted`, its place (or the one behind it) in values[low:high], which ascend."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        up = values[middle] <= wanted[open_] if behind else values[middle] < wanted[open_]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
    return low


class WordSearch:
    """Shift table and suffix buckets of the windows of one length, which end at words `ends` (exclusive) of `words`."""

    def __init__(self, words: Words, length: int, ends: np.ndarray, starts: np.ndarray):
        """starts: the first word of the item that each window is of."""
        self.words, self.length, self.block = words, length, min(2, length)
        self.jump = length - self.block + 1
        suffix = words.blocks(ends, self.block)
        window = words.windows(ends, length)
        order = np.lexsort((window, suffix))
        self.suffix, self.window, self.ends = suffix[order], window[order], ends[order].astype(np.int32)
        # every block of an item is as far from a window's end as from the end of the first window that holds it, or not at all
        opening = np.flatnonzero(ends - starts == length)
        place, item = _ranges(starts[opening] + self.block, ends[opening])
        bits = max(10, int(4 * (len(ends) + len(place))).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.jump, np.uint8 if self.jump < 256 else np.int32)
        np.minimum.at(self.shift, words.blocks(place, self.block) & self.mask, (ends[opening][item] - place).astype(self.shift.dtype))
        self.shift[suffix & self.mask] = 0

    def candidates(self, text: Words) -> np.ndarray:
        """Where windows may end in the texts: the places at which the shift is 0, by as many cursors as there are stretches."""
        lo, hi = text.first[:-1] + self.length, text.first[1:]
        pieces = np.maximum(0, -(-(hi - lo + 1) // _STRETCH))
        piece, owner = _ranges(np.zeros(len(lo), np.int64), pieces)
        at = lo[owner] + piece * _STRETCH
        stop = np.minimum(at + _STRETCH - 1, hi[owner])
        found = []
        while len(at):
            shift = self.shift[text.blocks(at, self.block) & self.mask].astype(np.int64)
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at <= stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def find(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(end in the text, end in the benchmark's words) of each occurrence of a window."""
        at = self.candidates(text)
        suffix, window = text.blocks(at, self.block), text.windows(at, self.length)
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        entry, owner = _ranges(_places(self.window, window, low, high, False), _places(self.window, window, low, high, True))
        real = [self.words.span(int(self.ends[e]), self.length) == text.span(int(at[o]), self.length) for e, o in zip(entry.tolist(), owner.tolist(), strict=True)]
        real = np.array(real, bool)
        return at[owner[real]], self.ends[entry[real]]


class Part:
    """The searches of a part of the benchmark, one for each window length that occurs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        items = sorted(items)
        words = Words([text for _, text in items])
        n_words = np.diff(words.first)
        self.items, self.first, self.searches = [i for i, _ in items], words.first, []
        length = np.minimum(window, n_words)
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            ends, owner = _ranges(words.first[own] + n, words.first[own + 1] + 1)
            self.searches.append(WordSearch(words, n, ends, words.first[own][owner]))
        # what only the building needs isn't sent to the tasks
        words.hashes, words.begin, words.end = None, words.begin.astype(np.int32), words.end.astype(np.int32)

    def find(self, texts: Sequence[str | None]) -> pa.StructArray:
        """Number of words, merged spans of hit words, and ids of the items found, of each text."""
        text = Words(texts)
        begins, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [set() for _ in texts]
        for search in self.searches:
            at, source = search.find(text)
            begins.append(at - search.length)
            ends.append(at)
            doc = np.searchsorted(text.first, at - 1, side="right") - 1
            item = np.searchsorted(self.first, source - 1, side="right") - 1
            for d, i in zip(*np.divmod(np.unique(doc * len(self.items) + item), max(1, len(self.items))), strict=True):
                found[d].add(self.items[i])
        begin, end = merge_spans(np.concatenate(begins), np.concatenate(ends), text.first)
        doc = np.searchsorted(text.first, begin, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(x - text.first[doc], pa.int32()) for x in (begin, end)], ["start", "end"])
        offsets = np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32)
        columns = [pa.array(np.diff(text.first), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array([sorted(f) for f in found], pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, ["n_words", "spans", "items"])


def merge_spans(begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, cut where texts begin (at the places `first`)."""
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.subtract.at(edge, end, 1)
    hit = np.cumsum(edge)[:-1] > 0
    opens = hit & np.append(True, ~hit[:-1])[: len(hit)]
    inner = first[:-1][first[:-1] < len(hit)]
    opens[inner] = hit[inner]
    closes = hit & np.append(~hit[1:] | opens[1:], True)[: len(hit)]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _searcher(shared: Broadcast) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def search(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            done = [shared.value.find(b.column("t").to_pylist()) for b in sliced([pa.RecordBatch.from_arrays([texts], ["t"])], "t")]
            yield pa.concat_arrays(done or [shared.value.find([])])

    return search


def parts_of(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> tuple[int, Callable[[int], list]]:
    """How many parts of about `part_bytes` of text there are, and a function that fetches the items of one."""
    keyed = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    return parts, lambda part: [tuple(r) for r in keyed.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]


def _hits(spans: Column) -> Column:
    """How many words ascending spans cover together; they may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")
    )
    return F.aggregate(spans, start, step, lambda a: a["n"])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    part_bytes: int = _PART_BYTES,
) -> DataFrame:
    """The columns `keep` of `docs` with n_words, n_hit and items for every row.

    n_words: words of the document; n_hit: its words inside any occurrence of a window; items: ids of the
    items with occurring windows, as sorted strings. By default all columns are kept that don't have one of these names. Only the
    texts go to Python; the other columns stay in the JVM.
    """
    context = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")] if keep is None else list(keep)
    parts, fetch = parts_of(benchmark, item_col, item_text_col, part_bytes)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    result = lambda n_words, spans, items: ["_row.*", n_words.alias("n_words"), _hits(spans).alias("n_hit"), items.alias("items")]
    if parts == 1:
        shared = context.broadcast(Part(fetch(0), window))
        # not to be computed again where a filter is pushed down
        search = F.arrow_udf(_searcher(shared), _FOUND).asNondeterministic()
        found = rows.select("_row", search("_text").alias("_f"))
        return found.select(*result(F.col("_f.n_words"), F.col("_f.spans"), F.col("_f.items")))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    numbered = scratch.table(rows.withColumn("_n", F.monotonically_increasing_id()), "texts")
    passes = []
    for part in range(parts):
        shared = context.broadcast(Part(fetch(part), window))
        search = F.arrow_udf(_searcher(shared), _FOUND).asNondeterministic()
        found = numbered.select("_n", search("_text").alias("_f")).select("_n", "_f.*")
        # each document's number of words is wanted once
        passes.append(scratch.table(found if part == 0 else found.where("size(items) > 0"), f"part-{part}"))
        shared.destroy()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    gathered = every.groupBy("_n").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.sort_array(F.flatten(F.collect_list("items"))).alias("found"),
    )
    return numbered.join(gathered, "_n").select(*result(F.col("n_words"), F.col("spans"), F.col("found")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted item ids) and contaminated."""
    whole = docs.select(F.struct(F.col(id_col).alias("id")).alias("_id"), F.col(options.get("text_col", "text")).alias("_t"))
    found = decontaminate(whole, benchmark, keep=["_id"], **{**options, "text_col": "_t"})
    return found.select(
        F.col("_id.id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
