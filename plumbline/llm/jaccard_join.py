"""N-gram Jaccard join of all documents by a size-aware heavy-light join, and the groups that its links form.

A document is the set of its distinct word n-grams; two documents link when num/den of their union is shared. The
result is exact. The work follows from what a link needs:

1. Sets. One pass over the texts gives each document its set's size, a 128-bit digest and the least quarter of its
   hashed n-grams. Documents with equal digests are one class, so groups of copies never multiply.
2. Sift. A partner holds at least num/den of a set, so at least a known number of its least hashes must be among another
   set's least ones as well, whatever the sizes of the two. Counting who else has them, of each batch's most common
   n-grams only two at a time, leaves the few sets that can have a partner; only their texts are read again.
3. Order. Among what is left, n-grams are counted exactly; those of one set alone can't be shared. The rest are
   ordered from rare to frequent.
4. Light and heavy. Small sets enumerate their subsets of exactly the size that a link needs; sets that share one meet. Large
   sets post their rarest n-grams, as many as a link can't avoid, to inverted lists, and those in one list meet. The
   boundary between small and large is where enumerating and scanning together cost least on the counts at hand.
5. Links. In each list, all sets are first compared with its most typical one. Sets that this connects need no
   more comparisons among themselves; only sets of different components of a list are compared, so a group of near copies
   costs work in proportion to its size, and no link between different components is lost.

No list, n-gram, set or group of copies is one task's alone: facts of common keys are broadcast (at most 10,000 of them), the pairs of
one set are dealt over tasks with copies of the set, and a long list meets in pairs of blocks.

Documents without words are alone. Null texts have no words. Null identifiers never name a component. Texts may be of any length.
Repeated rows are one set. Columns other than the two named are ignored (`keep_one` keeps them all, whatever their names), and an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, mix64, shingles_of, sliced
from plumbline.plans.components import components
from plumbline.plans.lookup import join_dealt, join_facts
from plumbline.plans.storage import Scratch

_SKETCH = "id long, n int, d1 long, d2 long, low array<long>"
_FULL = "d1 long, d2 long, n int, tokens array<long>"
_NO_ID = -(1 << 63)
_MAX_SMALL = 24


class Rule:
    """Two sets of sizes n and m link when den * |intersection| >= num * |union|."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be in (0, 1]")
        self.num, self.den = num, den

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n: int) -> int:
        """Least intersection with any partner."""
        return -(-self.num * n // self.den)

    def overlap_sql(self, n: str, m: str) -> str:
        whole = self.num + self.den
        return f"CAST(floor(({self.num} * CAST({n} + {m} AS BIGINT) + {whole - 1}) / {whole}) AS INT)"

    def least_sql(self, n: str) -> str:
        return f"CAST(floor(({self.num} * CAST({n} AS BIGINT) + {self.den - 1}) / {self.den}) AS INT)"

    def need_sql(self, n: str, share: float) -> str:
        """How many of its least hashes a set of size n shares with the least hashes of any partner, at least.

        Of i shared n-grams, a side's low ones hold the least low - (size - i), so both sides' hold the smaller of these two
        numbers. The set's own is least for its smallest partner. That of a partner of size m, without rounding, is concave in
        m, so it is least for the smallest or the largest partner; rounding makes the result at most one too low.
        """
        r = self.num / self.den
        low = f"least({n}, CAST(ceil({share} * {n}) AS INT) + 1)"
        largest = f"least({n}, {n} + 1 - {(1 - share) / r!r}D * {n})"
        smallest = f"least({r!r}D * {n}, {share * r!r}D * {n} + 1)"
        return f"least({low} - ({n} - {self.least_sql(n)}), CAST(ceil(least({largest}, {smallest}) - 1e-6D) AS INT))"

    def linked_sql(self, i: str, n: str, m: str) -> str:
        return f"{self.den} * CAST({i} AS BIGINT) >= {self.num} * CAST({n} + {m} - {i} AS BIGINT)"


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _low_size(n: int, share: float) -> int:
    return min(n, math.ceil(share * n) + 1)


def _sketched(batches: Iterator[pa.RecordBatch], width: int, share: float) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "t"):
        n, d1, d2, low = [], [], [], []
        for tokens in shingles_of(batch.column("t").to_pylist(), width):
            own = _digest(tokens)
            n.append(len(tokens))
            d1.append(own[0])
            d2.append(own[1])
            low.append(tokens[: _low_size(len(tokens), share)].view(np.int64))
        columns = [batch.column("id"), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "low"])


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and, for each, its row."""
    column = batch.column(name)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


_POSTED = "key long, d1 long, credit int"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (n-gram, set, 0) for each low n-gram of the batch's distinct sets.

    Of an n-gram that more than two sets of the batch have, two post it, which tells the others' tasks that it is shared;
    the other sets get their credit here, as rows (set, set, credit).
    """
    for batch in batches:
        _, at = np.unique(batch.column("d1").to_numpy(), return_index=True)
        batch = batch.take(pa.array(np.sort(at)))
        d1 = batch.column("d1").to_numpy()
        token, row = _flat(batch, "low")
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        turn = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
        post = turn < 2
        credit = np.bincount(row[~post], minlength=len(d1))
        has = np.flatnonzero(credit)
        keys = np.concatenate([token[post], d1[has]])
        sets = np.concatenate([d1[row[post]], d1[has]])
        credits = np.concatenate([np.zeros(post.sum(), np.int32), credit[has].astype(np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sets), pa.array(credits)], ["key", "d1", "credit"])


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For one partition of n-grams: how many of a set's n-grams another set has posted too."""
    parts = [(b.column("key").to_numpy(), b.column("d1").to_numpy(), b.column("credit").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    key, d1, credit = (np.concatenate(p) for p in zip(*parts, strict=True))
    ready = credit > 0
    sets, amounts = [d1[ready]], [credit[ready].astype(np.int64)]
    key, d1 = key[~ready], d1[~ready]
    order = np.lexsort((d1, key))
    key, d1 = key[order], d1[order]
    if len(key):
        fresh = np.append(True, (key[1:] != key[:-1]) | (d1[1:] != d1[:-1]))
        key, d1 = key[fresh], d1[fresh]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same)
        sets.append(d1[shared])
        amounts.append(np.ones(int(shared.sum()), np.int64))
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.bincount(place, np.concatenate(amounts), len(ids)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["d1", "credit"])


def _full(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "t"):
        sets = shingles_of(batch.column("t").to_pylist(), width)
        own = [_digest(s) for s in sets]
        columns = [
            pa.array([d for d, _ in own], pa.int64()),
            pa.array([d for _, d in own], pa.int64()),
            pa.array([len(s) for s in sets], pa.int32()),
            pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n", "tokens"])


_KEYS = "key long, cid long, n int, u int, pos int"


def subset_sizes(n: int, boundary: int, rule: Rule) -> list[int]:
    """Sizes of the subsets that a set of n n-grams enumerates: what it has to share with each size up to the boundary."""
    sizes = {rule.overlap(n, m) for m in range(1, boundary + 1) if rule.overlap(n, m) <= min(n, m)}
    return sorted(sizes)


def _subset_keys(batches: Iterator[pa.RecordBatch], boundary: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    sizes = {n: subset_sizes(n, boundary, rule) for n in range(1, boundary + 1)}
    for batch in batches:
        keys, cid, n_of, u_of = [], [], [], []
        rows = zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), batch.column("u").to_pylist(), batch.column("tokens").to_pylist(), strict=True)
        for c, n, u, tokens in rows:
            mixed = mix64(np.array(tokens, dtype=np.int64).view(np.uint64))
            for size in sizes[n]:
                if size <= len(mixed):
                    chosen = np.array(list(itertools.combinations(range(len(mixed)), size)))
                    own = mix64(mixed[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(size)).view(np.int64)
                    keys.append(own)
                    cid.append(np.full(len(own), c))
                    n_of.append(np.full(len(own), n, np.int32))
                    u_of.append(np.full(len(own), u, np.int32))
        if keys:
            columns = [np.concatenate(x) for x in (keys, cid, n_of, u_of)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.full(len(columns[0]), -1, np.int32))], ["key", "cid", "n", "u", "pos"])


def choose_boundary(scan: dict[int, int], sets: dict[int, int], rule: Rule) -> int:
    """The size up to which enumerating subsets and scanning lists beyond it cost least.

    scan[n]: rows in the lists that sets of size n post to; sets[n]: how many sets there are.
    """

    def enumerated(boundary: int) -> int:
        return sum(k * sum(math.comb(n, c) for c in subset_sizes(n, boundary, rule)) for n, k in sets.items() if n <= boundary)

    cost = [enumerated(b) + sum(w for n, w in scan.items() if n > b) for b in range(_MAX_SMALL + 1)]
    return cost.index(min(cost))


def _small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast when it has at most `bound` rows, else as Spark sees fit."""
    return F.broadcast(df) if rows <= bound else df


class JaccardJoin:
    """The steps of one join; `groups` gives its result."""

    def __init__(self, spark: SparkSession, width: int, num: int, den: int, share: float = 0.25, boundary: int | None = None, broadcast_rows: int = 1_000_000, list_block: int = 1000):
        self.rule, self.width, self.boundary, self.broadcast_rows, self.list_block = Rule(num, den), width, boundary, broadcast_rows, list_block
        # the sift has to look at more n-grams than two linked sets may differ in
        self.share = max(share, 1 - num / den + 0.02)
        self.scratch = Scratch(spark, "jaccard")
        self.spark = spark
        bound_batches(spark)

    def sift(self, sketch: DataFrame, classes: DataFrame) -> DataFrame:
        """The classes that can have a partner: cid, d1, d2, n, fetch."""
        low = f"least(n, CAST(ceil({self.share} * n) AS INT) + 1)"
        total = classes.selectExpr(f"coalesce(sum(CAST({low} AS BIGINT)), 0)").first()[0]
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2_000_000))
        posted = sketch.where("n > 0").select("d1", "low").mapInArrow(_posted, _POSTED)
        credit = posted.repartition(parts, "key").mapInArrow(_credited, "d1 long, credit long").groupBy("d1").agg(F.sum("credit").alias("credit"))
        return self.scratch.table(classes.join(credit, "d1").where(f"credit >= {self.rule.need_sql('n', self.share)}").drop("credit", "min_id", "copies"), "sifted")

    def ordered(self, docs: DataFrame, sifted: DataFrame) -> DataFrame:
        """cid, n, u (n-grams of this set alone) and tokens (the others, rare ones first) of sets that can have a partner."""
        count = sifted.count()
        fetch = _small(sifted.select(F.col("fetch").alias("_fetch")).distinct(), count, self.broadcast_rows)
        texts = docs.join(fetch, F.coalesce("id", F.lit(_NO_ID)) == F.col("_fetch"), "left_semi").select("t")
        full = texts.mapInArrow(partial(_full, width=self.width), _FULL)
        named = full.join(_small(sifted.select("d1", "d2", "cid"), count, self.broadcast_rows), ["d1", "d2"])
        sets = self.scratch.table(named.select("cid", "n", "tokens"), "sets")
        tokens = sets.select("cid", "n", F.explode("tokens").alias("token"))
        known = self.scratch.table(tokens.groupBy("token").count().where("count > 1").withColumnRenamed("count", "df"), "frequencies")
        total = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        shared = join_facts(tokens, known, ["token"], "df", total).groupBy("cid", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("own"))
        rare_first = shared.select("cid", "n", (F.col("n") - F.size("own")).alias("u"), F.transform("own", lambda x: x["token"]).alias("tokens"))
        return self.scratch.table(rare_first.where(f"size(tokens) >= {self.rule.least_sql('n')}"), "ordered")

    def keys(self, sets: DataFrame) -> DataFrame:
        """Where sets meet: key, cid, n, u, pos (place in the order; -1 for a subset)."""
        prefix = f"least(size(tokens), greatest(0, n - {self.rule.least_sql('n')} + 1 - u))"
        posted = sets.selectExpr("cid", "n", "u", f"posexplode(slice(tokens, 1, {prefix})) AS (at, key)").selectExpr("key", "cid", "n", "u", "u + at AS pos")
        boundary = self.boundary
        if boundary is None:
            lengths = posted.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
            small = posted.where(F.col("n") <= 2 * _MAX_SMALL).join(lengths, "key").groupBy("n").agg(F.sum("length").alias("work"))
            scan = {r["n"]: r["work"] for r in small.collect()}
            held = {r["n"]: r["count"] for r in sets.where(F.col("n") <= 2 * _MAX_SMALL).groupBy("n").count().collect()}
            boundary = choose_boundary(scan, held, self.rule)
        heavy = posted.where(f"n > {boundary} OR {self.rule.least_sql(str(boundary + 1))} <= n")
        light = sets.where(F.col("n") <= boundary).mapInArrow(partial(_subset_keys, boundary=boundary, rule=self.rule), _KEYS)
        return self.scratch.table(heavy.union(light) if boundary else heavy, "keys")

    def verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (u, v) of cids that link, by their whole sets. The pairs of one set are dealt over many tasks."""
        pairs = self.scratch.table(pairs, f"{name}-pairs")
        total = pairs.count()
        both = pairs
        for side in ("u", "v"):
            own = sets.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"t_{side}"))
            both = join_dealt(both, own, side, pairs.groupBy(side).count(), total)
        found = both.withColumn("i", F.size(F.array_intersect("t_u", "t_v"))).where(self.rule.linked_sql("i", "n_u", "n_v"))
        links = self.scratch.table(found.select("u", "v"), name)
        self.scratch.drop(f"{name}-pairs")
        return links

    def links(self, keys: DataFrame, sets: DataFrame) -> DataFrame:
        """(node, label): components of all links between different sets."""
        total = keys.count()
        order = F.struct("u", "cid", "n")
        lists = keys.groupBy("key").agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("k"))
        lists = self.scratch.table(lists.where("k > 1"), "lists")
        near = join_facts(keys, lists, ["key"], "k", total).where("cid <> c.cid AND " + self._may_link("n", "c.n"))
        pairs = near.select(F.least("cid", "c.cid").alias("u"), F.greatest("cid", "c.cid").alias("v")).distinct()
        stars = self.verified(pairs, sets, "star-links")
        labels = self.scratch.table(components(stars, self.scratch, "stars"), "star-labels")
        named = keys.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        split = named.groupBy("key").agg(
            F.min("label").alias("a"), F.max("label").alias("z"), F.min(order).alias("c"), F.min_by("label", order).alias("heart"), F.count(F.lit(1)).alias("k")
        )
        split = self.scratch.table(split.where("a <> z").select("key", "c", "heart", "k"), "split")
        there = self.scratch.table(join_facts(named, split, ["key"], "k", total), "there")
        more = self.verified(self.across(there), sets, "other-links")
        joined = components(self.between(more, labels), self.scratch, "others").select(F.col("node").alias("label"), F.col("label").alias("joined"))
        fresh = more.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti")
        nodes = labels.unionByName(fresh.withColumn("label", F.col("node")))
        # a large component's nodes share their label, so they stay where they are
        new = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("k")).join(joined, "label", "left").select("label", "k", F.coalesce("joined", "label").alias("now"))
        return join_facts(nodes, new, ["label"], "k", nodes.count()).select("node", F.col("now").alias("label"))

    def across(self, there: DataFrame) -> DataFrame:
        """The pairs (u, v) of one list but of different components that can link.

        A list is cut into blocks of `list_block` sets, and each two blocks meet in a task of their own.
        """
        blocks = f"CAST(ceil(k / {self.list_block}) AS INT)"
        own = f"CAST(pmod(xxhash64(cid), {blocks}) AS INT)"
        x = there.where("label <> heart").selectExpr("key", f"{own} AS bx", f"explode(sequence(0, {blocks} - 1)) AS by", *[f"{c} AS {c}_x" for c in ("cid", "n", "pos", "label")])
        y = there.selectExpr(
            "key", f"{own} AS by", f"explode(sequence(0, {blocks} - 1)) AS bx", "heart", "c.cid AS centre", *[f"{c} AS {c}_y" for c in ("cid", "n", "pos", "label")]
        )
        need = self.rule.overlap_sql("n_x", "n_y")
        meet = (
            f"label_x <> label_y AND cid_y <> centre AND (label_y = heart OR cid_x < cid_y) AND {self._may_link('n_x', 'n_y')}"
            f" AND pos_x <= n_x - {need} AND pos_y <= n_y - {need}"
        )
        return x.join(y, ["key", "bx", "by"]).where(meet).select(F.least("cid_x", "cid_y").alias("u"), F.greatest("cid_x", "cid_y").alias("v")).distinct()

    @staticmethod
    def between(links: DataFrame, labels: DataFrame) -> DataFrame:
        """The links with each end replaced by its component. A set with very many links is no task of its own."""
        total = links.count()
        for side in ("u", "v"):
            ends = links.groupBy(side).agg(F.count(F.lit(1)).alias("k"))
            own = ends.join(labels.select(F.col("node").alias(side), "label"), side, "left").select(side, "k", F.coalesce("label", side).alias("_label"))
            links = join_facts(links, own, [side], "k", total).drop(side, "k").withColumnRenamed("_label", side)
        return links.select("u", "v")

    def _may_link(self, n: str, m: str) -> str:
        return f"{self.rule.overlap_sql(n, m)} <= least({n}, {m})"

    def groups(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id, n_shingles and component_id of every row."""
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        sketched = source.mapInArrow(partial(_sketched, width=self.width, share=self.share), _SKETCH)
        sketch = self.scratch.table(sketched.withColumn("row", F.monotonically_increasing_id()), "sketch")
        classes = sketch.where("n > 0").groupBy("d1", "d2", "n").agg(
            F.min("row").alias("cid"), F.min("id").alias("min_id"), F.coalesce(F.min("id"), F.lit(_NO_ID)).alias("fetch"), F.count(F.lit(1)).alias("copies")
        )
        classes = self.scratch.table(classes, "classes")
        rows = self.scratch.table(sketch.drop("low", "row"), "rows")
        sifted = self.sift(sketch, classes)
        self.scratch.drop("sketch")
        sets = self.ordered(source, sifted)
        self.scratch.drop("sets", "frequencies")
        labels = self.links(self.keys(sets), sets)
        named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        named = self.scratch.table(named.select("d1", "d2", "n", "min_id", "copies", "label"), "named")
        least = named.groupBy("label").agg(F.min("min_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
        members = join_facts(named, least, ["label"], "size", named.count())
        final = self.scratch.table(members.select("d1", "d2", "n", "component_id", "copies"), "final")
        self.scratch.drop("classes", "named", "sifted", "ordered", "keys", "lists", "star-links", "star-labels", "split", "there", "other-links")
        total = final.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        joined = join_facts(rows.where("n > 0"), final, ["d1", "d2", "n"], "copies", total).select("id", "n", "component_id")
        alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
        return joined.unionByName(alone).select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def jaccard_groups(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id_col, n_shingles (distinct n-grams) and component_id (the least identifier that links reach)."""
    return JaccardJoin(docs.sparkSession, width, num, den, **options).groups(docs, id_col, text_col).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay when of each group the one with the least identifier does.

    Identifiers should be unique: rows that share theirs stay or go together. Rows with null identifiers stay only if
    no row of their group has one.
    """
    groups = jaccard_groups(docs, width, num, den, id_col, text_col, **options)
    stay = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).cast("long").alias("_id")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_key"))
    return whole.join(stay, F.col("_key").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
