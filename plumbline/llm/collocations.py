"""Phrases whose words stand together more often than apart, mined with double-array tries.

1. Words are counted; those frequent enough set bits of a bitmap of fixed size. Pairs of such words are counted by 64-bit hashes: a bucket's
   count bounds that of each phrase in it, so buckets below the least count drop only phrases that can't be candidates (Park, Chen and Yu's
   sieve of Apriori). The bitmap of the buckets left admits phrases of one word more, and so on.
2. One more pass over the texts deals the phrases that the bitmaps admit to parts by their hashes: a task counts equal ones by their bytes
   first and packs those of a part into one row, so a part gets a common phrase about once for each reading task.
3. Each part's phrases go into double-array tries over their bytes, at most `block` a trie; the states of all phrases advance together by
   one byte at a time, and bincounts of the accepting states are the phrases' counts. A phrase lies in one part, so these are final.
4. Scores are exact (38-digit decimals). The parts of a phrase that is frequent are frequent, so their counts are known.

The texts are read `max_words` + 1 times, however many candidates there are. Broadcast are bitmaps of 2^27 bits; they don't grow with the data.
A word or language with a third of all rows is counted in each task before anything is shuffled. Null texts are empty, a null
language is `und`. Texts, words and languages may be of any length. Repeated rows count as often as they occur, ties in score and count go by the phrase's
bytes, other columns are ignored, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.textkit import _RADIX, bound_batches, hash_words, mix64, sliced, word_spans
from plumbline.plans.storage import Scratch

_BLOCK = 1 << 20
_BITS = 27
_FLUSH_WORDS, _FLUSH_BUCKETS, _FLUSH_PHRASES = 300_000, 1 << 21, 1 << 19
#: Occurrences of phrases that go to a part, and how many phrases walk a trie at a time.
_PART, _AT_ONCE = 1 << 21, 1 << 17

#: A-Z lower-cased, tabs to blanks, and the bytes `.,;:!?` and 0A to 0D to a line feed: what ends a piece.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))


class Words:
    """The words of some texts: `buf` has each word and one blank behind it; `left` are the words up to the end of the piece."""

    def __init__(self, texts: Sequence[str | None]):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        low = np.frombuffer((b"\n".join(parts) + b"\n").translate(_TABLE), np.uint8)
        breaks = np.flatnonzero(low == 10)
        word = (low != 10) & (low != 32)
        begin, end = word_spans(~word)
        word[end] = True  # a text's last word is followed by a line feed at least
        low = low.copy()
        low[end] = 32
        self.buf = low[word]
        size = end - begin
        self.begin = np.cumsum(size + 1) - size - 1
        self.end = self.begin + size
        # words that come first behind the end of a piece
        first = np.append(0, np.searchsorted(begin, breaks))
        first = first[np.append(True, first[1:] != first[:-1]) & (first < len(begin))]
        per_piece = np.diff(np.append(first, len(begin)))
        self.left = np.repeat(first + per_piece, per_piece) - np.arange(len(begin))
        self.text = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(begin, starts)))

    def __len__(self) -> int:
        return len(self.begin)


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _phrase_hashes(words: np.ndarray, lang: np.ndarray, width: int) -> np.ndarray:
    """Of the phrase that begins at each word (of no use where it would pass the end)."""
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = lang.copy()
    for i in range(width):
        out = out * np.uint64(_RADIX) + padded[i : i + len(words)]
    return mix64(out + np.uint64(width))


def _place(hashes: np.ndarray) -> np.ndarray:
    """The place of a phrase in the bitmap: the first `_BITS` bits of its hash."""
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = _place(hashes)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], Words, np.ndarray]]:
    """Languages, words and each word's language, with rows of a language together."""
    for batch in sliced(batches, "text"):
        langs = batch.column("lang").to_pylist()
        own = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(own)}
        of = np.array([number[lang] for lang in langs], np.int32)
        order = np.argsort(of, kind="stable")
        texts = batch.column("text").to_pylist()
        words = Words([texts[i] for i in order])
        yield own, words, of[order][words.text]


_WORDS = "lang string, phrase string, n long"
_WORDS_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_PACKED = "part int, lang string, text binary, size binary, n binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("text", pa.binary()), ("size", pa.binary()), ("n", pa.binary())])
_PHRASES = "lang string, phrase string, width int, f long"
_PHRASES_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("width", pa.int32()), ("f", pa.int64())])


def _parts(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    for lo in range(0, whole.num_rows, 50_000):
        yield whole.slice(lo, 50_000)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language with counts; a row without a word counts all of them."""
    counted: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counted.items():
            names = [w.decode("utf-8", "surrogatepass") for w in own]
            yield from _parts([[lang] * (len(names) + 1), [*names, None], [*own.values(), sum(own.values())]], _WORDS_ARROW)
        counted.clear()

    for own, words, of in _slices(batches):
        for i, lang in enumerate(own):
            lo, hi = np.searchsorted(of, i), np.searchsorted(of, i, side="right")
            if hi > lo:
                counted.setdefault(lang, Counter()).update(words.buf[words.begin[lo] : words.end[hi - 1]].tobytes().split(b" "))
        if sum(map(len, counted.values())) >= _FLUSH_WORDS:
            yield from flush()
    yield from flush()


def _hashed(own: list[str], words: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their languages."""
    return hash_words(words.buf, words.begin, words.end), np.array([_language_hash(name) for name in own], np.uint64)[of]


def _sieve(batches: Iterable[pa.RecordBatch], width: int, shared) -> Iterator[pa.RecordBatch]:
    """Hashes of the phrases of `width` words, both of whose parts without an end word may be frequent by the bitmap, with counts."""
    held: list[np.ndarray] = []
    bitmap, schema = shared.value, pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def flush() -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        yield from _parts([found.view(np.int64), n], schema)

    for own, words, of in _slices(batches):
        if len(words):
            hashes, lang = _hashed(own, words, of)
            may = _in_bitmap(bitmap, _phrase_hashes(hashes, lang, width - 1))
            held.append(_phrase_hashes(hashes, lang, width)[(words.left >= width) & may & np.append(may[1:], False)])
            if sum(map(len, held)) >= _FLUSH_BUCKETS:
                yield from flush()
    if held:
        yield from flush()


def _binaries(data: np.ndarray | bytes, size: np.ndarray) -> pa.LargeBinaryArray:
    """Values of the given sizes that follow one another."""
    offsets = np.append(0, np.cumsum(size, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of values of about `most` bytes together; a longer value is a run of its own."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


class _Tally:
    """Phrases of one language, each with a blank behind every word, with counts and the parts they go to. Equal ones are told by their bytes."""

    def __init__(self):
        self.keys: list[pa.Array] = []
        self.n: list[np.ndarray] = []
        self.part: list[np.ndarray] = []

    def add(self, keys: pa.Array, n: np.ndarray | None, part: np.ndarray) -> None:
        coded = keys.dictionary_encode()
        at, size = coded.indices.to_numpy(), len(coded.dictionary)
        own = np.empty(size, np.int32)
        own[at] = part
        self.keys.append(coded.dictionary)
        self.n.append(np.bincount(at, n, size).astype(np.int64))
        self.part.append(own)

    def merge(self) -> None:
        keys, n, part = pa.concat_arrays(self.keys), np.concatenate(self.n), np.concatenate(self.part)
        self.__init__()
        self.add(keys, n, part)


def _pack(batches: Iterable[pa.RecordBatch], parts: int, shared) -> Iterator[pa.RecordBatch]:
    """The phrases that the bitmaps (by width) admit, with counts, packed by part and language."""
    held: dict[str, _Tally] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, tally in held.items():
            order = np.argsort(tally.part[0], kind="stable")
            data, start, size = _bytes_of(pa.chunked_array([tally.keys[0].take(pa.array(order))]))
            part, n = tally.part[0][order], tally.n[0][order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            last = np.append(first[1:], len(part))
            ends = np.append(start, start[-1] + size[-1])
            for lo, hi in _runs(ends[last] - ends[first], 32 << 20):
                rows = list(zip(first[lo:hi].tolist(), last[lo:hi].tolist(), strict=True))
                columns = [part[first[lo:hi]], [lang] * (hi - lo), [data[ends[i] : ends[k]].tobytes() for i, k in rows], [size[i:k].astype(np.int64).tobytes() for i, k in rows], [n[i:k].tobytes() for i, k in rows]]
                yield from _parts(columns, _PACKED_ARROW)
        held.clear()

    def count() -> int:
        return sum(len(k) + (k.nbytes >> 7) for tally in held.values() for k in tally.keys)

    for own, words, of in _slices(batches):
        if not len(words):
            continue
        hashes, lang = _hashed(own, words, of)
        for width, bitmap in shared.value.items():
            full = _phrase_hashes(hashes, lang, width)
            at = np.flatnonzero((words.left >= width) & _in_bitmap(bitmap, full))
            part, begin = (full[at] % np.uint64(parts)).astype(np.int32), words.begin[at]
            size, bounds = words.end[at + width - 1] + 1 - begin, np.searchsorted(of[at], np.arange(len(own) + 1))
            for name, a, z in zip(own, bounds, bounds[1:], strict=False):
                for lo, hi in _runs(size[a:z], 1 << 20):
                    lo, hi = a + lo, a + hi
                    held.setdefault(name, _Tally()).add(_binaries(_gathered(words.buf, begin[lo:hi], size[lo:hi]), size[lo:hi]), None, part[lo:hi])
        if count() >= 2 * _FLUSH_PHRASES:
            for tally in held.values():
                tally.merge()
            if count() >= _FLUSH_PHRASES:
                yield from flush()
    for tally in held.values():
        tally.merge()
    yield from flush()


def _gathered(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the given stretches, one after the other."""
    ends = np.cumsum(size)
    return buf[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]


class Trie:
    """A double array: from state s, byte c leads to base[s] + c where check says s. Children of a state lie in a span of its own, so
    the arrays are made without search; `accept` numbers the keys."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Distinct keys in ascending order, as bytes, where each begins and how long it is."""
        keys = len(size)
        node = np.zeros(keys, np.int32)  # level by level: the node where each key stands
        parents, symbols = [np.array([-1], np.int32)], [np.zeros(1, np.uint8)]
        made, active, depth = 1, np.arange(keys, dtype=np.int32), 0
        while len(active):
            c = text[start[active] + depth]
            at = node[active]
            new = np.ones(len(active), bool)
            new[1:] = (at[1:] != at[:-1]) | (c[1:] != c[:-1])
            parents.append(at[new])
            symbols.append(c[new])
            node[active] = made - 1 + np.cumsum(new, dtype=np.int32)
            made += int(new.sum())
            depth += 1
            active = active[size[active] > depth]
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        del parents, symbols
        least, most = np.full(made, 256, np.int16), np.full(made, -1, np.int16)
        np.minimum.at(least, parent[1:], symbol[1:].astype(np.int16))
        np.maximum.at(most, parent[1:], symbol[1:].astype(np.int16))
        span = np.maximum(most - least + 1, 0)
        total = 512 + int(span.sum(dtype=np.int64))
        shift = (256 + np.cumsum(span, dtype=np.int32) - span - least).astype(np.int32)  # from a child's byte to its place
        place = np.zeros(made, np.int32)
        place[1:] = shift[parent[1:]] + symbol[1:]
        self.base, self.check, self.accept = np.zeros(total, np.int32), np.full(total, -1, np.int32), np.full(total, -1, np.int32)
        inner = most >= 0
        self.base[place[inner]] = shift[inner]
        self.check[place[1:]] = place[parent[1:]]
        self.accept[place[node]] = np.arange(keys)

    def root(self, prefix: bytes) -> int:
        """The state that a prefix leads to, or -1."""
        state = 0
        for c in prefix:
            to = int(self.base[state]) + c
            if self.check[to] != state:
                return -1
            state = to
        return state

    def numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the given keys, or -1: all their states advance together, one byte at a time."""
        out, at = np.full(len(start), -1, np.int32), np.flatnonzero(size > 0)
        state, depth = np.zeros(len(at), np.int32), 0
        while len(at):
            to = self.base[state] + data[start[at] + depth]
            ok = self.check[to] == state
            at, state, depth = at[ok], to[ok], depth + 1
            over = size[at] == depth
            out[at[over]] = self.accept[state[over]]
            at, state = at[~over], state[~over]
        return out


def _count(packed: pa.Table, least: int, block: int) -> pa.Table:
    """A part's phrases that occur `least` times, with counts."""
    found: list[tuple[str, bytes, int]] = []
    langs = packed.column("lang").to_numpy(zero_copy_only=False)
    for lang in sorted(set(langs)):
        own = packed.filter(pa.array(langs == lang))
        text, size, n = (b"".join(own.column(c).to_pylist()) for c in ("text", "size", "n"))
        data, size, n = np.frombuffer(text, np.uint8), np.frombuffer(size, np.int64), np.frombuffer(n, np.int64)
        start, keys = np.cumsum(size) - size, _binaries(text, size).unique()
        keys = keys.take(pc.sort_indices(keys))
        for lo in range(0, len(keys), block):
            some = keys.slice(lo, block)
            trie, total = Trie(*_bytes_of(pa.chunked_array([some]))), np.zeros(len(some), np.int64)
            for k in range(0, len(size), _AT_ONCE):
                number = trie.numbers(data, start[k : k + _AT_ONCE], size[k : k + _AT_ONCE])
                total += np.bincount(number[number >= 0], n[k : k + _AT_ONCE][number >= 0], len(some)).astype(np.int64)
            often = np.flatnonzero(total >= least)
            found += [(lang, key, f) for key, f in zip(some.take(pa.array(often)).to_pylist(), total[often].tolist(), strict=True)]
    columns = [[x[0] for x in found], [x[1][:-1].decode("utf-8", "surrogatepass") for x in found], [x[1].count(b" ") for x in found], [x[2] for x in found]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PHRASES_ARROW, strict=True)], schema=_PHRASES_ARROW)


def phrase_counts(docs: DataFrame, scratch: Scratch, max_words: int, min_count: int, block: int = _BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, f) of all phrases of up to `max_words` words that occur `min_count` times, single words too; and (lang, n), all words."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).where("text IS NOT NULL")
    share = spark.sparkContext.broadcast

    def bitmap_of(places: DataFrame) -> np.ndarray:
        """Bits set at the column `p`; made by Spark in at most 4,097 chunks of 4 KB."""
        bits = np.zeros(1 << (_BITS - 3), np.uint8)
        for r in places.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toLocalIterator():
            _fill(bits, r.k, bytes(r.bits))
        return bits

    found = scratch.table(texts.mapInArrow(_count_words, _WORDS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= min_count)), "words")
    words = found.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(1).alias("width"), F.col("n").alias("f"))
    sizes = found.where("phrase IS NULL").select("lang", "n")
    bits = bitmap_of(words.select("lang", "phrase").mapInArrow(_places_of_words, "p long").distinct())
    bitmaps, occurrences = {}, 0
    for width in range(2, max_words + 1):
        shared = share(bits)
        sieved = texts.mapInArrow(partial(_sieve, width=width, shared=shared), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        buckets = scratch.table(sieved.where(F.col("n") >= min_count), f"buckets-{width}")
        shared.destroy()
        bits = bitmaps[width] = bitmap_of(buckets.select(F.shiftrightunsigned("bucket", 64 - _BITS).alias("p")))
        occurrences += buckets.agg(F.sum("n")).first()[0] or 0
        scratch.drop(f"buckets-{width}")
    if not bitmaps:
        return words, sizes
    parts = max(spark.sparkContext.defaultParallelism, -(-occurrences // _PART))
    shared = share(bitmaps)
    packed = texts.mapInArrow(partial(_pack, parts=parts, shared=shared), _PACKED)
    phrases = scratch.table(packed.groupBy("part").applyInArrow(lambda own: _count(own, min_count, block), _PHRASES), "phrases")
    shared.destroy()
    return words.union(phrases), sizes


def _places_of_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the bitmap has the words, each a phrase of one."""
    for batch in batches:
        for own, words, of in _slices([batch.rename_columns(["lang", "text"])]):
            place = _place(_phrase_hashes(*_hashed(own, words, of), 1))
            yield pa.RecordBatch.from_arrays([pa.array(place)], ["p"])


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, where each value begins and how long it is."""
    array = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _fill(bitmap: np.ndarray, number: int, bits: bytes) -> None:
    """Spark's chunk `number` holds positions 1 + 32768 (number - 1) and on, 1 standing at its first bit; chunk 0 holds position 0 as its first."""
    raw = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    places = np.flatnonzero(raw) + (1 + (number - 1) * len(raw) if number > 0 else 0)
    np.bitwise_or.at(bitmap, places >> 3, (1 << (places & 7)).astype(np.uint8))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside: int = 50, top: int = 2000, block: int = _BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `max_words` words that occur `min_count` times.

    score is floor(1000000 a^2 / (l r)) at the lowest-scoring cut into two parts with l and r occurrences. A phrase inside a longer candidate
    with at least `inside` percent of its occurrences is dropped.
    """
    counts, sizes = phrase_counts(docs, Scratch(docs.sparkSession, "collocations"), max_words, min_count, block)
    candidates = counts.where("width > 1").withColumn("w", F.split("phrase", " ", -1))
    cut = candidates.withColumn("cut", F.explode(F.expr("sequence(1, width - 1)")))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, width - cut), ' ')").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    exact = cut.select("lang", "phrase", "cut", *[v.alias(c) for c, v in wide.items()]).withColumn("score", F.expr("(1000000 * a * a) div (l * r)"))
    scored = exact.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    inner = candidates.where("width > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, width - 1), k -> transform(sequence(1, width - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    # no language's phrases meet in one task but for the best of each of 64 parts
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(F.col("s.score").desc(), F.col("a").desc(), "phrase")
    ahead = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return ranked.join(sizes, "lang").select("lang", long("rank", "rank"), "phrase", long("a", "a"), long("s.l", "l"), long("s.r", "r"), "n", long("s.score", "score"))
