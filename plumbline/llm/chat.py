"""Conversations as training windows of bounded size, with a loss mask.

1. A turn is written as `### role:`, a line break, its text and `</turn>`, a line break. Inside texts and roles every backslash is doubled, and
   each `### ` and `</turn>` gets a backslash in front (in roles colons too), so no text can end a turn or begin one, and reading back is exact.
2. Each turn's tokens are counted once. Prefix sums of them choose the windows: a window begins with the system turn (the conversation's first, if its
   role is `system`), repeats as many turns before its own as `history` tokens hold, and takes own turns up to `budget` tokens in all, cut behind the last
   assistant turn among them. History gives way where not even one own turn fits. A turn that alone passes the budget is a window of its own; nothing is cut.
3. The mask covers the texts of the assistant turns that a window has as its own. Repeated turns are masked, so each assistant text is learnt once.

Windows are planned in segments of `SEGMENT` turns of a conversation, and history stays inside a segment. So an ordinary conversation is one
segment, and the segments of one with a large part of all rows are planned by different tasks: its turns are numbered in ranges, and its
system turn is copied for each. That changes where the work is done, not the windows.

Turns are ordered by `turn` (nulls first), then role, then a hash of the text, so repeated rows are turns of their own. Rows with null conv_id are
one conversation. Null roles and texts are empty; texts may be of any length. Other columns are ignored, whatever their names, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.packing import encoder
from plumbline.llm.textkit import bound_batches, sliced
from plumbline.plans.storage import Scratch

#: Turns that are planned together.
SEGMENT = 1024
_HOT_TURNS = 4096
_HOT_SHARE = 10_000
_HEAD, _END = "### ", "</turn>"

_WINDOWS = "conv_id long, segment long, window int, text string, n_tokens int, system boolean, n_history int, n_own int, mask array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32()), ("system", pa.bool_()), ("n_history", pa.int32()), ("n_own", pa.int32()), ("mask", pa.list_(_SPAN))]
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(_HEAD, "\\" + _HEAD).replace(_END, "\\" + _END)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\")
    out, i = [parts[0]], 1
    while i < len(parts):
        if not parts[i] and i + 1 < len(parts):  # a doubled backslash
            out.append("\\" + parts[i + 1])
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return "".join(out)


def _unescaped_at(text: str, what: str, begin: int) -> int:
    """Where `what` stands next with an even number of backslashes before it."""
    at = text.find(what, begin)
    while at >= 0:
        back = at
        while back > begin and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at = text.find(what, at + 1)
    return at


def header(role: str) -> str:
    return f"{_HEAD}{escape(role).replace(':', chr(92) + ':')}:\n"


def read_window(text: str) -> list[tuple[str, int, int]]:
    """(role, begin, end) of the turns of a window; the text between begin and end is still escaped."""
    out, at = [], 0
    while at < len(text):
        colon = _unescaped_at(text, ":\n", at + len(_HEAD))
        end = _unescaped_at(text, _END + "\n", colon + 2)
        out.append((unescape(text[at + len(_HEAD) : colon]), colon + 2, end))
        at = end + len(_END) + 1
    return out


def plan(tokens: np.ndarray, assistant: np.ndarray, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first repeated, first own, behind the last own) of each window over turns with so many tokens; `system` are taken already."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    room, out, own = max(0, budget - system), [], 0
    answers = np.flatnonzero(assistant) + 1
    while own < len(tokens):
        first = max(np.searchsorted(sums, sums[own] - history), np.searchsorted(sums, sums[own + 1] - room))
        first = min(int(first), own)
        end = max(own + 1, int(np.searchsorted(sums, sums[first] + room, side="right")) - 1)
        if end < len(tokens):
            k = int(np.searchsorted(answers, end, side="right"))
            if k and answers[k - 1] > own:
                end = int(answers[k - 1])
        out.append((first, own, end))
        own = end
    return out


def _segments(batches: Iterable[pa.RecordBatch], segment: int) -> Iterator[tuple[object, int, object, list]]:
    """(conv_id, segment, system turn or None, turns as (head, text, role)) of sorted rows; the system turn is one of the turns in segment 0 only."""
    key, seen, system, turns = (object(), 0), 0, None, []
    for batch in (s for b in batches for s in sliced([b], "text")):
        for conv, given, carried, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "carried", "role", "text")), strict=True):
            if (conv, given) != key or seen == segment:
                if turns:
                    yield key[0], number, system, turns
                number, seen, turns = (number + 1 if (conv, given) == key else given), 0, []
                if (conv, given) != key:
                    key, system = (conv, given), None
            turn = (role, text)
            if carried:
                system = turn
                continue
            if number == 0 and not seen and role == "system":
                system = turn
            turns.append(turn)
            seen += 1
    if turns:
        yield key[0], number, system, turns


def _format(batches: Iterable[pa.RecordBatch], path: str, budget: int, history: int, segment: int, held_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    rows: list[tuple] = []
    size = 0
    for conv, number, system, turns in _segments(batches, segment):
        begin = int(system is not None and number == 0)  # the system turn is one of its own turns there
        every = ([system] if system is not None and not begin else []) + turns
        heads, texts = [header(r) for r, _ in every], [escape(t) for _, t in every]
        written = [f"{h}{t}{_END}\n" for h, t in zip(heads, texts, strict=True)]
        tokens = np.array([len(ids) for ids in encode(written)], np.int64)
        lead = int(system is not None)
        body = tokens[lead:]
        taken = int(tokens[0]) if lead else 0
        found = plan(body, np.array([r == "assistant" for r, _ in every[lead:]], bool), taken, budget, history) or [(0, 0, 0)]
        for w, (first, own, end) in enumerate(found):
            at, mask, parts = 0, [], []
            for i in [*range(lead), *range(lead + first, lead + end)]:
                if i >= lead + own and every[i][0] == "assistant":
                    mask.append({"start": at + len(heads[i]), "end": at + len(heads[i]) + len(texts[i])})
                parts.append(written[i])
                at += len(written[i])
            n_own = end - own + (begin if w == 0 else 0)
            rows.append((conv, number, w, "".join(parts), int(taken + body[first:end].sum()), bool(lead), own - first, n_own, mask))
            size += at
            if size >= held_bytes:
                yield _batch(rows, _ARROW)
                rows, size = [], 0
    if rows:
        yield _batch(rows, _ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt(hot: DataFrame, segment: int, scratch: Scratch) -> DataFrame:
    """Turns of conversations of any length with their segments, and the system turn copied for each segment but the first."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("text")]
    ranged = hot.repartitionByRange(F.col("conv_id"), *order[:3]).sortWithinPartitions("conv_id", *order)
    ranged = scratch.table(ranged.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "hot")
    # at most one row for each task and conversation
    starts = ranged.groupBy("conv_id", "task").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    before, shifts = {}, []
    for r in sorted(starts, key=lambda r: r.task):
        shifts.append((r.conv_id, r.task, before.get(r.conv_id, 0) - r.least))
        before[r.conv_id] = before.get(r.conv_id, 0) + r.n
    shift = hot.sparkSession.createDataFrame(shifts, "c long, task int, shift long")
    ranked = ranged.join(F.broadcast(shift), (F.col("conv_id").eqNullSafe(F.col("c"))) & (ranged["task"] == shift["task"])).select(
        "conv_id", "turn", "role", "h", "text", (F.col("place") + F.col("shift")).alias("rank")
    )
    turns = ranked.select("conv_id", F.floor(F.col("rank") / segment).alias("segment"), F.lit(False).alias("carried"), "turn", "role", "h", "text")
    sizes = hot.sparkSession.createDataFrame([(c, (n - 1) // segment) for c, n in before.items()], "c long, others long")
    system = ranked.where("rank = 0 AND role = 'system'").join(F.broadcast(sizes), F.col("conv_id").eqNullSafe(F.col("c"))).where("others > 0")
    copies = system.select("conv_id", F.explode(F.sequence(F.lit(1).cast("long"), "others")).alias("segment"), F.lit(True).alias("carried"), "turn", "role", "h", "text")
    return turns.unionByName(copies)


def _windows(conversations: DataFrame, path: str, budget: int, history: int, segment: int, hot_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """Windows of ordinary conversations, whole and in order in one task each, and those of the longest ones, dealt over tasks."""
    spark = conversations.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.xxhash64(text).alias("h"), text.alias("text"))
    run = partial(_format, path=path, budget=budget, history=history, segment=segment)
    inner = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("text")]
    given = ["conv_id", "segment", "carried", "role", "text"]
    # fewer than 10,000 conversations can have more than that share of all turns, whatever the data's size
    counts = conversations.groupBy(F.col("conv_id").cast("long").alias("c")).count()
    total = conversations.count()
    hot = counts.where(F.col("count") > max(hot_turns, total // _HOT_SHARE)).select("c")
    names = [r.c for r in hot.collect()]
    if not names:
        common, longest = rows, None
    else:
        chosen = F.broadcast(spark.createDataFrame([(n,) for n in names], "c long"))
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        common, longest = rows.join(chosen, same, "left_anti"), rows.join(chosen, same, "left_semi")
    plain = common.withColumns({"segment": F.lit(0).cast("long"), "carried": F.lit(False)})
    done = plain.repartition("conv_id").sortWithinPartitions("conv_id", *inner).select(given).mapInArrow(run, _WINDOWS)
    if longest is None:
        return done, None
    parts = _dealt(longest, segment, Scratch(spark, "chat"))
    placed = parts.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.col("carried").desc(), *inner)
    return done, placed.select(given).mapInArrow(run, _WINDOWS)


def chat_windows(conversations: DataFrame, path: str, budget: int = 1024, history: int = 256, segment: int = SEGMENT, hot_turns: int = _HOT_TURNS) -> DataFrame:
    """conv_id, segment and window (its place), text, n_tokens, system (whether it begins with the system turn), n_history, n_own, mask (spans of
    the text, in code points, that are learnt). `path` is a tokenizer file; a window's tokens are those of its turns, encoded one by one."""
    common, hot = _windows(conversations, path, budget, history, segment, hot_turns)
    return common if hot is None else common.unionByName(hot)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows of each conversation say, read from their texts; rows are sorted by conversation, segment and window."""
    key, rows = object(), []
    n = loss = chars = 0
    turns = learnt = None

    def close() -> None:
        if turns is not None:
            rows.append((key, n, turns.hexdigest(), loss, learnt.hexdigest(), chars))

    for batch in batches:
        names = ("conv_id", "segment", "window", "text", "system", "n_history", "n_own", "mask")
        for conv, segment, window, text, system, n_history, n_own, mask in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if conv != key:
                close()
                key, n, loss, chars, turns, learnt = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            found = read_window(text)
            fresh = segment == 0 and window == 0  # the system turn is new there only
            skipped = n_history + int(system and not fresh)
            own = ([found[0]] if system and fresh else []) + found[int(system) + n_history :]
            if len(found) != skipped + n_own or len(own) != n_own:
                raise ValueError("a window doesn't read back")
            for role, begin, end in own:
                turns.update(f"{role}\n{unescape(text[begin:end])}\n".encode("utf-8", "surrogatepass"))
            n, chars = n + n_own, chars + len(text)
            for span in mask:
                said = unescape(text[span["start"] : span["end"]])
                loss += len(said)
                learnt.update(said.encode("utf-8", "surrogatepass"))
        if rows:
            yield _batch(rows, _DIGEST_ARROW)
            rows.clear()
    close()
    if rows:
        yield _batch(rows, _DIGEST_ARROW)


def chat_digest(conversations: DataFrame, path: str, budget: int = 1024, history: int = 256, segment: int = SEGMENT, hot_turns: int = _HOT_TURNS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows.

    Windows of an ordinary conversation are read where they are made. SHA-256 needs a text in order, so the windows of a long one stream through one
    task, sorted, and are not held there.
    """
    common, hot = _windows(conversations, path, budget, history, segment, hot_turns)
    out = common.mapInArrow(_read_back, _DIGEST)
    if hot is None:
        return out
    return out.unionByName(hot.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window").mapInArrow(_read_back, _DIGEST))
