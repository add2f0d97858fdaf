"""URL filtering: a blocked Bloom filter in front of an exact hash join. DataFrame operations only.

The list holds canonical entries `host + path prefix`, such as `example.com/en/`; an entry covers its host and all
subdomains, and the paths that start with its path. A URL is looked up under every key that could be listed: its host's
suffixes with as many labels as listed hosts have, with its path's prefixes as long as listed paths are. The Bloom
filter drops the keys that are surely not listed; the few that pass meet the list in a hash join, which removes the
false positives. Of the entries that fit, the longest decides, and on equal lengths `block`.

The filter is an array of 64-bit blocks: one hash picks a key's block, others its bits in it, so a probe reads one
word. It has at most `MAX_BLOCKS` words (2 MB) however long the list is; beyond that its false positives grow, and the join
still removes them. Nulls and URLs without `://` have empty host and path, and fit nothing. URLs may be of any length. Repeated rows are
judged alike; a rule listed with both actions blocks. Of the pages' other columns only the identifier is kept, whatever their names,
and it may be null or repeated. An empty table gives an empty result, an empty list lets everything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lookup import join_facts
from plumbline.plans.storage import Scratch

MAX_BLOCKS = 1 << 18
_BITS_PER_KEY = 16
_PROBES = 4


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _UPPER.lower()), F.regexp_extract(url, _URL, 2)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    bits = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for probe in range(_PROBES):
        field = F.shiftrightunsigned(bits, 6 * probe).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), field))
    return mask


def canonical_entries(rules: DataFrame) -> DataFrame:
    """Distinct listed entries: key (host with A-Z lower-cased, then path), labels, path_chars, action; `block` beats `allow`."""
    slash = F.instr("rule", "/")
    host = F.translate(F.when(slash > 0, F.substring(F.col("rule"), F.lit(1), slash - 1)).otherwise(F.col("rule")), _UPPER, _UPPER.lower())
    path = F.when(slash > 0, F.substring(F.col("rule"), slash, F.char_length("rule"))).otherwise(F.lit(""))
    return (
        rules.where("rule is not null and rule <> ''")
        .select(F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.char_length(path).alias("path_chars"), "action")
        .groupBy("key", "labels", "path_chars")
        .agg(F.max("action").alias("action"))
    )


def bloom_blocks(entries: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """The filter as (block, word) rows, and its number of blocks, which never exceeds MAX_BLOCKS."""
    blocks = 1
    while blocks * 64 < n_entries * _BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    return entries.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word")), blocks


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_entries: int = 200_000
) -> DataFrame:
    """id, host, path, rule (the entry that decides, else null) and verdict for every row of `pages`.

    `rules` has the columns rule and action (`allow` or `block`). URLs that no entry covers get `default`: what is
    not on the list passes. The list is broadcast to the hash join up to `broadcast_entries` entries; beyond, only entries with a great
    part of all probes are, and the others are shuffled.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    entries = scratch.table(canonical_entries(rules), "entries")
    shape = entries.agg(F.count(F.lit(1)).alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_chars").alias("chars")).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    suffixes = F.array(*[F.when(F.size(F.split("host", r"\.")) >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])])
    prefixes = F.array(*[F.when(F.char_length("path") >= c, F.substring("path", 1, c)) for c in sorted(shape["chars"])])
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    probes = urls.where("host <> ''").select("row", F.explode(F.array_compact(keys)).alias("key"))
    words, blocks = bloom_blocks(entries, shape["n"])
    probes = probes.withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"))})
    # at most MAX_BLOCKS rows of two longs, whatever the list's length
    possible = probes.join(F.broadcast(words), "block").where(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).select("row", "key")
    listed = entries.select("key", "action")
    if shape["n"] <= broadcast_entries:
        exact = possible.join(F.broadcast(listed), "key")
    else:
        possible = scratch.table(possible, "possible")
        weights = scratch.table(possible.groupBy("key").agg(F.count(F.lit(1)).alias("probes")).join(listed, "key"), "listed-probes")
        exact = join_facts(possible, weights, ["key"], "probes", possible.count()).drop("probes")
    rank = F.struct(F.char_length("key"), F.col("action"), F.col("key"))
    decided = exact.groupBy("row").agg(F.max_by(F.struct(F.col("key").alias("rule"), "action"), rank).alias("best"))
    return urls.join(decided, "row", "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
