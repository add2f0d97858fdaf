"""A trie of the conversations' beginnings, by vertical bitmaps.

1. Conversations lie in ranges of their identifiers; a range is cut into shards of about `shard_conversations`. A shard is one task's
   work at a time: it indexes every (position, turn) to a bitset over its conversations and walks depth first, where a
   child is the parent's bitset and the posting of the next turn; the lowest bit left names the next posting, so only postings
   that have members are looked at. Popcounts, least members and the lists of conversations that end in a node come from the bitsets.
2. A node that several shards have is recognised by the digest of its path. Counts are summed, and the shard with
   the least member owns the node.
3. Sums over subtrees are differences of running sums in a shard's preorder, over the nodes that it owns, and are summed over
   the shards. So no round per level is needed, however deep the trie is, and a node below which a third of all conversations
   lie has one row per shard. End lists of such nodes are hashed shard by shard, in order, without being held.

Texts never move, only 16 bytes of each turn's digest, its length and order. Rows of one conversation with equal turn numbers go by digest. Rows
without conv_id belong to no conversation. Null roles and texts are empty, and texts may be of any length. Repeated rows are turns of their
own. Other columns are ignored, whatever their names. Without conversations there is no root and the result is empty. What one task holds
are the turns of a shard (24 bytes and one posting each), or those of a single family of conversations where that is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches
from plumbline.plans.storage import Scratch

_SHARD = 2048
_SHARD_TURNS = 1 << 18
_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()

Turn = tuple[bytes, int]
Rebuild = Callable[[list[tuple[int, list[Turn]]]], Iterable[tuple[int, list[Turn]]]]

_LOCAL = pa.schema(
    [("shard", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("node", pa.binary()), ("n", pa.int32())]
    + [("conv_id", pa.int64()), ("n_bytes", pa.int64()), ("inner", pa.bool_()), ("ends", pa.string())]
)
_LOCAL_DDL = "shard long, pre int, last int, parent int, depth int, node binary, n int, conv_id long, n_bytes long, inner boolean, ends string"


def head_of(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family: the CRC of its decimal, modulo 9."""
    return zlib.crc32(str(conv_id).encode()) % 9


def share_heads(family: list[tuple[int, list[Turn]]], base: int) -> Iterator[tuple[int, list[Turn]]]:
    """Each conversation of a family, rebuilt: the first h turns of conversation `base`, then its own after its first h."""
    first = next((turns for c, turns in family if c == base), [])
    for c, turns in family:
        h = head_of(c)
        yield c, first[:h] + turns[h:]


def walk(conversations: list[tuple[int, list[Turn]]]) -> dict[str, list]:
    """The trie of some conversations (ascending identifiers) in preorder; `last` is the index behind a node's subtree."""
    ids, turns = [c for c, _ in conversations], [t for _, t in conversations]
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    ending: dict[int, int] = {}
    for k, own in enumerate(turns):
        bit = 1 << k
        for at, (digest, _) in zip(postings, own, strict=False):
            at[digest] = at.get(digest, 0) | bit
        ending[len(own)] = ending.get(len(own), 0) | bit
    out: dict[str, list] = {name: [] for name in ("last", "parent", "depth", "node", "n", "conv_id", "n_bytes", "inner", "ends")}
    stack = [((1 << len(ids)) - 1, 0, _ROOT, -1, 0)]
    while stack:
        members, depth, node, parent, n_bytes = stack.pop()
        at = len(out["node"])
        ended = members & ending.get(depth, 0)
        rest = members ^ ended
        out["last"].append(1)
        out["parent"].append(parent)
        out["depth"].append(depth)
        out["node"].append(node)
        out["n"].append(members.bit_count())
        out["conv_id"].append(ids[(members & -members).bit_length() - 1])
        out["n_bytes"].append(n_bytes)
        out["inner"].append(rest != 0)
        names = []
        while ended:
            low = ended & -ended
            names.append(str(ids[low.bit_length() - 1]))
            ended ^= low
        out["ends"].append(",".join(names))
        while rest:
            digest, size = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][digest]
            rest &= ~child
            stack.append((child, depth + 1, hashlib.blake2b(node + digest, digest_size=16).digest(), at, size))
    last, parents = out["last"], out["parent"]
    for i in range(len(last) - 1, 0, -1):  # sizes of the subtrees, children before parents
        last[parents[i]] += last[i]
    for i in range(len(last)):
        last[i] += i
    return out


def _families(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, list[Turn]]]]]:
    """(family, its conversations) of rows sorted by family, conv_id and turn."""
    family, found = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for f, c, digest, size in zip(*columns, strict=True):
            if f != family:
                if found:
                    yield family, found
                family, found = f, []
            if not found or found[-1][0] != c:
                found.append((c, []))
            found[-1][1].append((digest, size))
    if found:
        yield family, found


def _local(batches: Iterable[pa.RecordBatch], rebuild: Callable, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, list[Turn]]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        found = walk(held)
        n = len(found["node"])
        found |= {"shard": np.full(n, held[0][0]), "pre": np.arange(n, dtype=np.int32)}
        whole = pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in _LOCAL], schema=_LOCAL)
        for lo in range(0, n, 8192):
            yield whole.slice(lo, 8192)

    for family, conversations in _families(batches):
        for c, turns in rebuild(conversations, family):
            held.append((c, turns))
            size += len(turns)
        if len(held) >= most or size >= _SHARD_TURNS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


_SUMS = "node binary, depth int, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SUMS_ARROW = pa.schema([("node", pa.binary()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string())])


def _shard_sums(table: pa.Table) -> pa.RecordBatch:
    """One shard's nodes in preorder, with the parts of the sums that this shard owns."""
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    last, parent, total, least, first = (get(c).astype(np.int64) for c in ("last", "parent", "total", "least", "shard"))
    owned = get("owner").astype(np.int64) == first
    below = lambda w: np.append(0, np.cumsum(w))
    leaves, saved = below(owned & ~get("any_inner").astype(bool)), below(np.where(owned, (total - 1) * get("n_bytes").astype(np.int64), 0))
    here = np.arange(len(last))
    children = np.bincount(parent[1:][owned[1:]], minlength=len(last))
    of_parent = pa.array(least[np.maximum(parent, 0)], mask=~owned | (parent < 0))
    alone = get("shards") == 1
    digests = [hashlib.sha256(e.encode()).hexdigest() if own else None for e, own in zip(table.column("ends").to_pylist(), alone.tolist(), strict=True)]
    columns = [table.column("node").combine_chunks(), table.column("depth").combine_chunks(), least, total, of_parent, children, leaves[last] - leaves[here], saved[last] - saved[here], digests]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SUMS_ARROW, strict=True)], schema=_SUMS_ARROW)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        whole = _shard_sums(pa.Table.from_batches(held))
        for lo in range(0, whole.num_rows, 8192):
            yield whole.slice(lo, 8192)

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                if held and held[-1].column("shard")[0].as_py() != shards[lo]:
                    yield from flush()
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, joined by commas; rows are sorted by node and shard."""
    node, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "joined"])
    for batch in batches:
        for n, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if n != node:
                if state is not None:
                    yield done()
                node, state = n, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    if state is not None:
        yield done()


def _digest(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def prefix_trie(
    conversations: DataFrame, family: Column | None = None, rebuild: Callable | None = None, shard_conversations: int = _SHARD
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct beginning of a conversation.

    `rebuild(conversations, family)` may turn the conversations of a family, [(conv_id, [(digest, bytes)])], into others with the same
    identifiers; by default each is a family of its own and stays as it is. Families have to be ascending with conv_id.
    """
    bound_batches(conversations.sparkSession)
    scratch = Scratch(conversations.sparkSession, "trie")
    c = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(n), F.lit("")) for n in ("role", "text"))
    narrow = conversations.where(c.isNotNull()).select((family if family is not None else c).alias("family"), c.alias("conv_id"), F.col("turn"), _digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    dealt = narrow.repartitionByRange("family").sortWithinPartitions("family", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    run = partial(_local, rebuild=rebuild or (lambda found, _: found), most=shard_conversations)
    local = scratch.table(dealt.select("family", "conv_id", "digest", "n_bytes").mapInArrow(run, _LOCAL_DDL), "local")
    every = local.groupBy("node").agg(
        F.sum("n").alias("total"), F.min("conv_id").alias("least"), F.min("shard").alias("owner"), F.max("inner").alias("any_inner"), F.count(F.lit(1)).alias("shards")
    )
    every = scratch.table(every, "nodes")
    placed = local.drop("n", "inner", "conv_id").join(every, "node")
    parts = placed.repartition("shard").sortWithinPartitions("shard", "pre").mapInArrow(_summed, _SUMS)
    total = lambda name: F.sum(name).alias(name)
    same = lambda name: F.max(name).alias(name)
    nodes = parts.groupBy("node").agg(*map(same, ("depth", "conv_id", "n_convs", "parent_conv_id", "ends_sha256")), *map(total, ("n_children", "n_leaves", "saved_tokens")))
    shared = local.where("ends <> ''").join(every.where("shards > 1").select("node"), "node").select("node", "shard", "ends")
    joined = shared.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_hashed, "node binary, joined string")
    empty = F.sha2(F.lit(""), 256)
    return nodes.join(joined, "node", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "joined", empty).alias("ends_sha256")
    )


def shared_head_trie(conversations: DataFrame, shard_conversations: int = _SHARD) -> DataFrame:
    """The trie of conversations that take their first turns from the first of their family of five."""
    c = F.col("conv_id").cast("long")
    return prefix_trie(conversations, c - c % 5, share_heads, shard_conversations)
