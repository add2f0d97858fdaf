"""Packing of tokenised documents into sequences of a fixed length: reduction by dominance, then best fit.

1. Tokenise: each document's ids, with an end id, in one pass over the texts. A document of more than `capacity` ids is
   cut so that only its first piece is shorter than `capacity`; what is left to decide is where pieces go.
2. Count the pieces of each length. There are at most `capacity` lengths, so these counts state the whole packing problem
   exactly, and stay as small on any number of documents.
3. Reduce (Martello and Toth): a set of lengths that dominates every other set that can hold a certain piece is fixed
   for good, as many times as the counts allow. Fixed here: a piece that nothing fits beside; a pair that fills a sequence
   exactly; a pair or triple that dominates because more pieces don't fit.
4. Pack the rest by best fit, longest first, again on counts: many equal sequences are filled in one step.
5. Number the pieces of each length (in buckets, so no length is numbered by one task) and look up each piece's place.

Texts are read and tokenised once; after that only (id, piece, length, checksum) rows move. Null texts are empty documents:
one piece with the end id. Texts may be of any length: they become more pieces. Rows alike in all are packed one by one, ties between equally
long pieces go by identifier and checksum, other columns are ignored, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, sliced
from plumbline.plans.ranks import gapless_rank
from plumbline.plans.storage import Scratch

Pattern = tuple[tuple[int, int], ...]

_ROWS_PER_BUCKET = 1000
_PIECES = "id long, n long, lengths array<int>, crcs array<long>"

_encoders: dict[str, tuple] = {}


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stand for themselves, the rest follow at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the splitting pattern of byte-level BPE with `use_regex`.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE and nothing else, with merges in the order of the ids that they make."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in made and all(a < b for a, b in zip(made, made[1:], strict=False))


def encoder(path: str):
    """A function from a list of texts to their id arrays: those of `tokenizers` with add_special_tokens=False and else its defaults.

    Where the file is plain byte-level BPE, its own vocabulary is loaded into a second BPE engine that gives the same ids
    about three times faster. It is trusted only if it encodes every entry of the vocabulary as `tokenizers` does, and it never sees a
    text that holds the string of an added token (such as `<|endoftext|>`, which is one id): those go to `tokenizers`.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        slow, fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        if _plain_byte_level(spec):
            stand_in = _byte_of_symbol()
            ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            entries = (raw.decode("utf-8", "replace") for raw in ranks)
            if any(fast.encode_ordinary(e) != slow.encode(e, add_special_tokens=False).ids for e in entries if not any(a in e for a in added)):
                fast = None
        _encoders[path] = slow, fast, added
    slow, fast, added = _encoders[path]

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if fast is None or any(a in text for a in added):
                yield np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                yield np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n >= 1 ids: all are `capacity`, but for the first."""
    head = (n - 1) % capacity + 1
    return [head, *[capacity] * ((n - head) // capacity)]


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    end = np.array([end_id], dtype="<u4")
    for batch in sliced(batches, "t"):
        sizes, all_lengths, all_crcs = [], [], []
        for ids in encode(batch.column("t").to_pylist()):
            ids = np.concatenate([ids, end])
            lengths = cut(len(ids), capacity)
            raw, at, crcs = memoryview(ids).cast("B"), 0, []
            for n in lengths:
                crcs.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at += n
            sizes.append(len(ids))
            all_lengths.append(lengths)
            all_crcs.append(crcs)
        columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(all_lengths, pa.list_(pa.int32())), pa.array(all_crcs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "lengths", "crcs"])


def _largest(count: list[int], limit: int, without: int = 0) -> int:
    """The largest length up to `limit` that is left when one piece of length `without` is taken; 0 if there is none."""
    return next((s for s in range(min(limit, len(count) - 1), 0, -1) if count[s] - (s == without) > 0), 0)


def _smallest(count: list[int], k: int, without: int) -> list[int]:
    """The k smallest lengths left, with repeats."""
    out: list[int] = []
    for s in range(1, len(count)):
        out += [s] * min(k - len(out), count[s] - (s == without))
        if len(out) >= k:
            break
    return out


def dominating(count: list[int], j: int) -> tuple[int, ...] | None:
    """A set of lengths with j that dominates every feasible set with j, or None if these rules find none.

    A set dominates another if the other's pieces can be split into groups that each fit into the place of one of its own.
    """
    room = len(count) - 1 - j
    k = _largest(count, room, j)
    if not k:
        return (j,)
    if k == room:
        return (j, k)
    least = _smallest(count, 3, j)
    if len(least) < 2 or least[0] + least[1] > room:
        return (j, k)
    if len(least) == 3 and sum(least) <= room:
        return None
    # at most two pieces fit beside j: compare the largest single piece with the pairs
    best_sum, best_second = 0, 0
    for y in range(1, room // 2 + 1):
        if count[y] - (y == j) <= 0:
            continue
        own = count[y] - (y == j)
        x = _largest(count, room - y, j)
        if x > y or x == y and own > 1:
            best_sum, best_second = max(best_sum, x + y), y
    if k >= best_sum:
        return (j, k)
    b = _largest([c - (s == k) for s, c in enumerate(count)], room - k, j)
    if b and b <= k and best_second <= b:
        return (j, k, b)
    return None


def reduce_by_dominance(count: list[int]) -> tuple[list[tuple[Pattern, int]], list[int]]:
    """Fixed (pattern, how many sequences) and the counts that are left. count[s]: pieces of length s; capacity: len - 1."""
    count, fixed, changed = list(count), [], True
    while changed:
        changed = False
        for j in range(len(count) - 1, 0, -1):
            while count[j] and (chosen := dominating(count, j)):
                need = {s: chosen.count(s) for s in chosen}
                times = min(count[s] // m for s, m in need.items())
                for s, m in need.items():
                    count[s] -= m * times
                fixed.append((tuple(need.items()), times))
                changed = True
    return fixed, count


def best_fit(count: list[int]) -> list[tuple[Pattern, int]]:
    """Best fit, longest first: each piece goes where it leaves least room. Returns (pattern, how many sequences)."""
    capacity = len(count) - 1
    bins: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for size in range(capacity, 0, -1):
        left = count[size]
        while left:
            room = next((r for r in range(size, capacity) if bins[r]), capacity)
            # having taken one, a sequence still has the least room that is enough, so it takes as many as fit
            each = room // size
            pattern, there = bins[room].pop() if room < capacity else ((), max(1, left // each))
            if left >= each:
                times = min(there, left // each)
                took = each
            else:
                times, took = 1, left
            if there > times and room < capacity:
                bins[room].append((pattern, there - times))
            bins[room - took * size].append(((*pattern, (size, took)), times))
            left -= times * took
    return [b for group in bins for b in group]


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, first offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, m in pattern:
            rows.append((size, used.get(size, 0), m, sequence, offset))
            used[size] = used.get(size, 0) + m * times
            offset += m * size
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_RANK_BITS = np.int64(48)


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    keys = (table[:, 0] << _RANK_BITS) + table[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        own = table[np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1]
        turn = rank - own[:, 1]
        placed = [pa.array(own[:, 3] + turn // own[:, 2]), pa.array(own[:, 4] + turn % own[:, 2] * length)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), *placed], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_bucket: int = _ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    What the driver gets are the counts of at most `capacity` lengths, and what it broadcasts is the places' table,
    of at most a few rows for each length.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    tokens = scratch.table(texts.mapInArrow(lambda batches: _tokenised(batches, tokenizer_path, end_id, capacity), _PIECES), "tokens")
    pieces = tokens.select(
        "id", F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "own"), F.element_at("lengths", 1).alias("head")
    ).select(
        "id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("head") + (F.col("piece") - 1).cast("long") * capacity).cast("long").alias("start"),
        F.col("own.lengths").cast("long").alias("length"),
        F.col("own.crcs").alias("ids_crc32"),
    )
    histogram = [0] * (capacity + 1)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    fixed, rest = reduce_by_dominance(histogram)
    table = places(fixed + best_fit(rest))
    # a length's pieces are numbered in as many buckets as it needs; `histogram` has one entry for each length
    buckets = F.element_at(F.lit([1 + n // rows_per_bucket for n in histogram[1:]]), F.col("length").cast("int"))
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), buckets)
    order = [F.col(c).asc_nulls_first() for c in ("id", "piece", "ids_crc32", "start")]
    ranked = gapless_rank(pieces, ["length"], bucket, order, "rank")
    wide = docs.sparkSession.sparkContext.broadcast(table)
    out = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(lambda batches: _placed(batches, wide.value, names), out).withColumnRenamed("id", id_col)
