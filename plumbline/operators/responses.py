"""From the answer log to one row per respondent and item: filters, parsing, joins, three ways to dedupe, coverage.

A log has model_id, item_id, raw_text, error, and columns that order it. Where the order decides, it is an explicit column:
Spark tables have no file order. Missing answers (refusals, unparseable texts, errors) are NULL, never 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import unit_hash

#: Phrases that mark a refusal (fixed values).
REFUSAL_MARKERS = ("i cannot", "i can't", "unable to provide", "consult a", "not a substitute", "as an ai")
#: Phrases in an error text that mean a rate limit (fixed values).
RATE_LIMIT_MARKERS = ("429", "resource_exhausted", "rate_limit", "rate limit", "overloaded", "quota")

_ANSWER = r"(?i)Answer:\s*(benign|malignant)"
_CONFIDENCE = r"(?i)Confidence:\s*(low|medium|high)"
_REASONING = r"(?is)Reasoning:\s*(.+)"


def _contains_any(text: Column, markers: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.coalesce(F.greatest(*[low.contains(m.lower()) for m in markers], F.lit(False)), F.lit(False))


# -- rows of the registry and the log ---------------------------------------------------------------


def select_respondents(registry: DataFrame, include_optional: bool = False, sources: Sequence[str] | None = None, model_id: str | None = None) -> DataFrame:
    """Registry rows of a run: optional ones only on request, and those of some sources or one id. An empty panel is an error."""
    chosen = registry if include_optional else registry.where("NOT optional")
    if sources is not None:
        chosen = chosen.where(F.col("source").isin(list(sources)))
    if model_id is not None:
        chosen = chosen.where(F.col("id") == model_id)
    if chosen.isEmpty():
        raise ValueError("no respondent is left")
    return chosen


def drop_errors(log: DataFrame, policy: str = "strict") -> DataFrame:
    """Rows without an error. `strict`: error is NULL; `truthy`: an empty error text counts as none, too."""
    if policy not in ("strict", "truthy"):
        raise ValueError(policy)
    return log.where("error IS NULL" if policy == "strict" else "error IS NULL OR error = ''")


def parse_answers(log: DataFrame, markers: Sequence[str] = REFUSAL_MARKERS) -> DataFrame:
    """Adds label, confidence, reasoning and used_fallback.

    An answer makes the label, also beside a refusal marker; without one, a marker makes a refusal, and else the text is
    unparseable. Confidence and reasoning are NULL unless there is an answer. NULL texts are unparseable.
    """
    text = F.coalesce("raw_text", F.lit(""))
    answer = F.lower(F.regexp_extract(text, _ANSWER, 1))
    answered = answer != ""
    label = F.when(answered, answer).when(_contains_any(text, markers), "refusal").otherwise("unparseable")
    confidence = F.nullif(F.lower(F.regexp_extract(text, _CONFIDENCE, 1)), F.lit(""))
    reasoning = F.nullif(F.regexp_replace(F.regexp_extract(text, _REASONING, 1), r"^\s+|\s+$", ""), F.lit(""))
    return log.withColumns(
        {"label": label, "confidence": F.when(answered, confidence), "reasoning": F.when(answered, reasoning), "used_fallback": F.lit(False)}
    )


def score(parsed: DataFrame) -> DataFrame:
    """Adds y: 1 if the label agrees with `truth`, 0 if not, NULL without an answer."""
    return parsed.withColumn("y", F.when(F.col("label").isin("benign", "malignant"), ((F.col("label") == "malignant") == F.col("truth")).cast("int")))


def classify_errors(log: DataFrame, markers: Sequence[str] = RATE_LIMIT_MARKERS) -> DataFrame:
    """Failed rows by respondent and kind (`rate_limit` or `other`)."""
    failed = log.where("error IS NOT NULL AND error <> ''")
    return failed.groupBy("model_id", F.when(_contains_any(F.col("error"), markers), "rate_limit").otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def exclude_group(items: DataFrame, group: str) -> DataFrame:
    return items.where(~F.col("grp").eqNullSafe(F.lit(group)))


def short_name(column: Column, names: Sequence[tuple[str, str]]) -> Column:
    """The last part of a path-like id, or the display name of the first pattern it contains, without regard to case."""
    last = F.substring_index(column, "/", -1)
    out = None
    for pattern, name in names:
        hit = F.lower(last).contains(pattern.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return last if out is None else out.otherwise(last)


def restrict_panel(rows: DataFrame, model_ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the named respondents: a list, or a table with model_id of any size."""
    if isinstance(model_ids, DataFrame):
        return rows.join(model_ids.select("model_id"), "model_id", "left_semi")
    return rows.where(F.col("model_id").isin(list(model_ids)))


# -- joins ------------------------------------------------------------------------------------------


def attach_items(parsed: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """Adds the items' columns. `inner` drops answers to unknown items, `left` keeps them without a group."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    return parsed.join(items, "item_id", how)


def pending_pairs(registry: DataFrame, items: DataFrame, log: DataFrame) -> DataFrame:
    """Pairs of respondent and item without a success so far. The registry, a settings list, is broadcast to the items."""
    pairs = items.select("item_id").crossJoin(F.broadcast(registry.select(F.col("id").alias("model_id"))))
    return pairs.join(drop_errors(log).select("model_id", "item_id"), ["model_id", "item_id"], "left_anti")


def new_answers(predictions: DataFrame, log: DataFrame, model_id: str) -> DataFrame:
    """Predictions on items that this respondent hasn't answered yet."""
    done = log.where(F.col("model_id") == model_id).select("item_id")
    return predictions.join(done, "item_id", "left_anti")


def align_embeddings(embeddings: DataFrame, items: DataFrame) -> DataFrame:
    """Embeddings of known items; a vector with a NaN becomes zeros."""
    bad = F.exists("embedding", F.isnan)
    zeros = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return embeddings.join(items.select("item_id"), "item_id").withColumn("embedding", F.when(bad, zeros).otherwise(F.col("embedding")))


def circularity_flags(registry: DataFrame, embedding_family: str) -> DataFrame:
    """Each respondent, and whether it is of the family that made the embeddings."""
    return registry.select(F.col("id").alias("model_id"), F.col("family").eqNullSafe(F.lit(embedding_family)).alias("circular"))


def family_groups(groups: Mapping[str, Sequence[str]], registry: DataFrame) -> DataFrame:
    """(family, family_group) rows of a settings map."""
    rows = [(f, g) for g, families in groups.items() for f in families]
    return registry.sparkSession.createDataFrame(rows, "family string, family_group string")


def family_panel(cells: DataFrame, registry: DataFrame, groups: Mapping[str, Sequence[str]], min_models: int = 2) -> DataFrame:
    """Accuracy by family group and item group; families without a group, and groups of fewer than min_models respondents, are `other`.

    cells: model_id, grp, y.
    """
    named = registry.join(F.broadcast(family_groups(groups, registry)), "family", "left").select(F.col("id").alias("model_id"), "family_group")
    sizes = named.groupBy("family_group").agg(F.count_distinct("model_id").alias("models"))
    final = named.join(sizes, "family_group", "left").select("model_id", F.when(F.col("models") >= min_models, F.col("family_group")).otherwise("other").alias("family_group"))
    return cells.join(F.broadcast(final), "model_id").groupBy("family_group", "grp").agg(F.avg("y").alias("accuracy"), F.count("y").alias("n_answered"), F.count_distinct("model_id").alias("n_models"))


# -- one row per respondent and item ------------------------------------------------------------------


def first_success(log: DataFrame, order: str | Column = "ord", policy: str = "strict") -> DataFrame:
    """The first row without an error of each respondent and item, chosen before parsing: a refusal that comes first wins.

    `min_by` is aggregated in the tasks before the shuffle, so a pair with many rows moves as few. Rows that tie in the order
    must be alike.
    """
    rows = drop_errors(log, policy)
    rest = [c for c in rows.columns if c not in ("model_id", "item_id")]
    return rows.groupBy("model_id", "item_id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("model_id", "item_id", "_r.*")


def latest_success(log: DataFrame, ts: str = "ts", order: str = "ord", policy: str = "strict") -> DataFrame:
    """The success with the greatest timestamp; of equal ones the later row."""
    rows = drop_errors(log, policy)
    rest = [c for c in rows.columns if c not in ("model_id", "item_id")]
    return rows.groupBy("model_id", "item_id").agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("_r")).select("model_id", "item_id", "_r.*")


def response_cells(log: DataFrame, items: DataFrame, registry: DataFrame, order: str = "ord", markers: Sequence[str] = REFUSAL_MARKERS) -> DataFrame:
    """One row per pair with a success: y of the last answer that could be parsed, and whether any of them was a refusal.

    A refusal or unparseable text never erases an earlier y. Texts are parsed before the shuffle and don't take part in it.
    """
    known = registry.select(F.col("id").alias("model_id"))
    rows = drop_errors(log).join(F.broadcast(known), "model_id", "left_semi")
    scored = score(parse_answers(attach_items(rows, items.select("item_id", "truth")), markers)).select("model_id", "item_id", order, "y", (F.col("label") == "refusal").alias("r"))
    last = F.max_by("y", F.when(F.col("y").isNotNull(), F.col(order)))
    return scored.groupBy("model_id", "item_id").agg(last.alias("y"), F.bool_or("r").alias("refused"))


def to_matrix(cells: DataFrame, model_ids: Sequence[str]) -> DataFrame:
    """Items by respondents, for small panels; the columns are named, so there is no pass to find them."""
    return cells.groupBy("item_id").pivot("model_id", list(model_ids)).agg(F.first("y", ignorenulls=True))


def coverage(cells: DataFrame, min_n: int = 600) -> DataFrame:
    """Answers of each respondent, and whether they are enough."""
    return cells.groupBy("model_id").agg(F.count("y").alias("n_answered")).withColumn("kept", F.col("n_answered") >= min_n)


def keep_covered(cells: DataFrame, min_n: int = 600) -> DataFrame:
    """Cells of respondents with enough answers; none left is an error."""
    kept = coverage(cells, min_n).where("kept")
    if kept.isEmpty():
        raise ValueError("no respondent has enough answers")
    return cells.join(F.broadcast(kept.select("model_id")), "model_id", "left_semi")


def saturated_items(cells: DataFrame) -> DataFrame:
    """Per item: n_valid, n_correct, and whether all or none of its answers are right (also if it has none)."""
    counted = cells.groupBy("item_id").agg(F.count("y").alias("n_valid"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_correct"))
    return counted.withColumn("saturated", (F.col("n_correct") == 0) | (F.col("n_correct") == F.col("n_valid")))


def prune_saturated(cells: DataFrame) -> DataFrame:
    return cells.join(saturated_items(cells).where("saturated").select("item_id"), "item_id", "left_anti")


def log_summary(log: DataFrame) -> DataFrame:
    """Rows, successes, errors and distinct items by respondent, with the total in the row of NULL."""
    return log.rollup("model_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("error").isNull()).alias("n_success"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
        F.count_distinct("item_id").alias("n_items"),
    )


def holdout_split(items: DataFrame, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds holdout: exactly int(fraction * n) items, those with the least seeded hash.

    The hashes' upper 16 bits are counted; all items below the border's bits are in, and only those that share them are sorted.
    """
    keyed = items.withColumn("_h", unit_hash(F.lit(str(seed)), F.col("item_id").cast("string"))).withColumn("_b", F.shiftright("_h", 16))
    sizes = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    left, border = int(fraction * sum(sizes.values())), -1
    for border in sorted(sizes):
        if sizes[border] > left:
            break
        left -= sizes[border]
        border += 1
    last = keyed.where(F.col("_b") == border).select("item_id", "_h").orderBy("_h", "item_id").limit(left).select("item_id", F.lit(True).alias("_in"))
    joined = keyed.join(F.broadcast(last), "item_id", "left")
    return joined.withColumn("holdout", (F.col("_b") < border) | F.coalesce("_in", F.lit(False))).drop("_h", "_b", "_in")


def stratified_subset(items: DataFrame, strata: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """A balanced subset: the same number of items from each stratum, or all of a smaller one; those with the least seeded hash.

    Hashes are counted by their upper 16 bits, so a stratum with a third of all items isn't ranked by one task: buckets below the border's are in,
    those above are out, and only the items in each stratum's border bucket are ranked.
    """
    named = [F.col(c) for c in strata]
    keyed = items.withColumn("_h", unit_hash(F.lit(str(seed)), F.col("item_id").cast("string"))).withColumn("_b", F.shiftright("_h", 16))
    sizes = keyed.groupBy(*named, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_stratum = n // max(1, sizes.select(*strata).distinct().count())
    # at most 65,536 rows of a stratum meet here, however many items it has
    before = Window.partitionBy(*named).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < per_stratum)
    renamed = places.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)], F.col("_b").alias("_bucket"), (F.lit(per_stratum) - F.col("_before")).alias("_left"), (F.col("_before") + F.col("_n") > per_stratum).alias("_border"))
    same = F.col("_b") == F.col("_bucket")
    for i, c in enumerate(strata):
        same &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = keyed.join(renamed, same)
    inside = joined.where("NOT _border")
    order = Window.partitionBy(*named, "_b").orderBy("_h", "item_id")
    border = joined.where("_border").withColumn("_r", F.row_number().over(order)).where("_r <= _left").drop("_r")
    return inside.unionByName(border).select(*items.columns)


def panel_union(*logs: DataFrame) -> DataFrame:
    """Answers of several sources as one log; columns that one lacks are NULL."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


# -- states that follow a growing log ------------------------------------------------------------------


def log_state(log: DataFrame, items: DataFrame, registry: DataFrame, order: str = "ord", markers: Sequence[str] = REFUSAL_MARKERS) -> DataFrame:
    """One row per pair of respondent and item with all that cells, coverage and summaries need of its rows: n_rows, n_error,
    success (any), known (respondent and item are), last (order and y of the last answer that could be parsed) and refused."""
    known = F.broadcast(registry.select(F.col("id").alias("model_id"), F.lit(True).alias("_asked")).distinct())
    rows = log.join(known, "model_id", "left").join(items.select("item_id", "truth"), "item_id", "left")
    scored = score(parse_answers(rows, markers))
    ok, here = F.col("error").isNull(), F.col("_asked").isNotNull() & F.col("truth").isNotNull()
    answer = F.when(ok & here & F.col("y").isNotNull(), F.struct(F.col(order).alias("at"), F.col("y").alias("y")))
    return scored.groupBy("model_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("n_error"), F.bool_or(ok).alias("success"), F.bool_or(here).alias("known"),
        F.max(answer).alias("last"), F.bool_or(F.when(ok & here, F.col("label") == "refusal")).alias("refused"),
    )


def merge_states(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of all rows that some states stand for. Of the last answers, the one with the greatest order stays."""
    every = first
    for other in others:
        every = every.unionByName(other)
    return every.groupBy("model_id", "item_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_error").alias("n_error"), F.bool_or("success").alias("success"), F.bool_or("known").alias("known"),
        F.max("last").alias("last"), F.bool_or("refused").alias("refused"),
    )


def cells_of_state(state: DataFrame) -> DataFrame:
    """What `response_cells` gives for the whole log."""
    return state.where("success AND known").select("model_id", "item_id", F.col("last.y").alias("y"), "refused")


def summary_of_state(state: DataFrame) -> DataFrame:
    """What `log_summary` gives for the whole log: a pair is one item of its respondent."""
    by_model = state.groupBy("model_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_rows") - F.col("n_error")).alias("n_success"), F.sum("n_error").alias("n_error"), F.count(F.lit(1)).alias("n_items")
    )
    items = state.agg(F.count_distinct("item_id").alias("n_items"))
    total = by_model.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_success", "n_error")]).crossJoin(items)  # one row by one row
    return by_model.unionByName(total.withColumn("model_id", F.lit(None).cast("string")))
