"""The registered queries of the audit operators over the fixture views, and SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from functools import cached_property, partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.kernels import POISSON_STEPS
from plumbline.functions.network import MLP
from plumbline.operators import irt, regress, reports, responses, stats, vectors
from plumbline.plans import fixtures
from plumbline.plans.storage import Scratch
from plumbline.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Few rounds, replicates or respondents of registered queries, each with SQL for the same rows; only tests run them.
REDUCED: dict = {}

_PANEL = [f"m{i}" for i in range(9)]
_GROUPS = ["I-II", "III-IV", "V-VI"]


def _r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


class Views:
    """The fixture views of one folder, and the frames that most queries begin with."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def _part(self) -> DataFrame:
        return fixtures.parts(self.spark, self.folder)

    items = property(lambda self: fixtures.items(self.spark, self.folder, self._part))
    log = property(lambda self: fixtures.log(self.spark, self.folder, self._part))
    registry = property(lambda self: tables.registry(self.spark, fixtures.registry_rows()))
    second = property(lambda self: fixtures.second_items(self.spark, self.folder))
    embeddings = property(lambda self: fixtures.embeddings(self.spark, self.folder))
    cells = property(lambda self: responses.response_cells(self.log, self.items, self.registry))

    @property
    def answers(self) -> DataFrame:
        """First successes, parsed, with items, scored."""
        return responses.score(responses.attach_items(responses.parse_answers(responses.first_success(self.log)), self.items))

    @property
    def proportions(self) -> tuple[DataFrame, DataFrame]:
        """Difficulties and abilities from shares of right answers: a fit that SQL can compute."""
        logit = F.log((F.sum("y") + 0.5) / (F.count("y") - F.sum("y") + 0.5))
        answered = self.cells.where("y IS NOT NULL")
        return answered.groupBy("item_id").agg((-logit).alias("b")), answered.groupBy("model_id").agg(logit.alias("theta"))

    @property
    def residuals(self) -> DataFrame:
        return regress.residualize(self.proportions[0], self.items)

    @property
    def asked(self) -> DataFrame:
        """The respondents with answers, with their settings, and n_rows of the log."""
        counts = self.log.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows"))
        return self.registry.join(counts.withColumnRenamed("model_id", "id"), "id")

    def once(self, df: DataFrame) -> DataFrame:
        """A table, for frames that a query reads more than once."""
        return Scratch(self.spark, "query").table(df, "frame")


_ANSWER = "lower(regexp_extract(raw_text, '(?i)Answer:\\s*(benign|malignant)', 1))"
_REFUSES = " OR ".join(f"contains(lower(raw_text), '{m.replace(chr(39), chr(39) * 2)}')" for m in responses.REFUSAL_MARKERS)
_LABEL = f"CASE WHEN {_ANSWER} <> '' THEN {_ANSWER} WHEN {_REFUSES} THEN 'refusal' ELSE 'unparseable' END"
_Y = "CASE WHEN label IN ('benign', 'malignant') THEN CAST((label = 'malignant') = truth AS INT) END"
_BASE = f"""WITH RECURSIVE {fixtures.SQL_VIEWS}, {fixtures.SECOND_SQL},
  ok AS (SELECT * FROM log WHERE error IS NULL),
  first AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, item_id ORDER BY ord) AS rn FROM ok) WHERE rn = 1),
  answers AS (SELECT *, {_Y} AS y FROM (SELECT *, {_LABEL} AS label FROM first JOIN items USING (item_id))),
  scored AS (SELECT *, {_Y} AS y FROM (SELECT *, {_LABEL} AS label FROM ok JOIN items USING (item_id))),
  cells AS (SELECT model_id, item_id, CAST(arg_max(y, ord) FILTER (WHERE y IS NOT NULL) AS INT) AS y, bool_or(label = 'refusal') AS refused FROM scored GROUP BY 1, 2),
  item_fit AS (SELECT item_id, -ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)) AS b FROM cells WHERE y IS NOT NULL GROUP BY 1),
  model_fit AS (SELECT model_id, ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)) AS theta FROM cells WHERE y IS NOT NULL GROUP BY 1),
  fitted AS (SELECT item_id, b, grp, category, truth, truth::INT - avg(truth::INT) OVER (PARTITION BY category) AS dt, b - avg(b) OVER (PARTITION BY category) AS db FROM item_fit JOIN items USING (item_id)),
  asked AS (SELECT registry.*, n_rows FROM registry JOIN (SELECT model_id AS id, count(*) AS n_rows FROM log GROUP BY 1) USING (id)),
  resid AS (SELECT item_id, grp, category, truth, b, db - dt * (SELECT coalesce(sum(dt * db) / nullif(sum(dt * dt), 0), 0) FROM fitted) AS resid FROM fitted)
"""


def _register(name: str, build, sql: str | None = None, base: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir, b=build: b(Views(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = (_BASE if base else "") + sql


def _reduced(name: str, build, sql: str) -> None:
    REDUCED[name] = (lambda spark, sf_dir, b=build: b(Views(spark, sf_dir)), _BASE + sql)


# -- sources and sinks ------------------------------------------------------------------------------


def _root(v: Views, name: str) -> str:
    return Scratch(v.spark, name).root


def _src1(v: Views) -> DataFrame:
    path = _root(v, "src1") + "/items"
    v.items.selectExpr("CAST(item_id AS STRING) AS DDI_file", "grp_raw AS skin_tone", "category AS disease", "truth AS malignant").write.option("header", True).csv(path)
    return tables.read_items(v.spark, path).select("item_id", "grp_raw", "category", "truth", "grp")


def _logged(v: Views) -> DataFrame:
    return v.log.selectExpr("model_id", "CAST(item_id AS STRING) AS item_id", "raw_text", "CAST(NULL AS DOUBLE) AS elapsed_s", "CAST(unix_date(ts) AS DOUBLE) AS timestamp", "error")


def _src2(v: Views) -> DataFrame:
    """A log with malformed and blank lines between the rows, read leniently."""
    path = _root(v, "src2") + "/log"
    lines = _logged(v).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    broken = v.items.where("item_id % 10 = 0").select(F.lit('{"model_id": "m0", "item').alias("value")).union(v.items.where("item_id % 10 = 1").select(F.lit("").alias("value")))
    lines.union(broken).write.text(path)
    return tables.read_log(v.spark, path).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_error"), F.sum(F.length("raw_text")).alias("chars"))


def _src3(v: Views) -> DataFrame:
    path = _root(v, "src3") + "/embeddings"
    v.embeddings.select(F.col("item_id").cast("string"), "embedding").write.parquet(path)
    return tables.read_embeddings(v.spark, path).select("item_id", F.size("embedding").alias("width"), _r(F.element_at("embedding", 1).cast("double")).alias("first_value"))


def _snk1(v: Views, respondents: list[str] | None = None) -> DataFrame:
    """A batch for each respondent (all of the log by default), the first of which is written twice, as after a failure."""
    path = _root(v, "snk1") + "/log"
    names = respondents or sorted(r["model_id"] for r in v.log.select("model_id").distinct().collect())
    for m in [*names[:1], *names]:
        tables.append_log(_logged(v).where(F.col("model_id") == m), path, m)
    return tables.read_log(v.spark, path, "strict").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


def _resumed(v: Views) -> DataFrame:
    """The state of the log after three batches, each taken in by itself."""
    root = _root(v, "resumed")
    log = v.once(v.log.selectExpr("model_id", "CAST(item_id AS STRING) AS item_id", "raw_text", "error", "ord"))
    items = v.once(v.items.select(F.col("item_id").cast("string"), "truth"))
    state = tables.LogState(v.spark, f"{root}/state", items, v.registry, "model_id STRING, item_id STRING, raw_text STRING, error STRING, ord STRING")
    for k in range(3):
        tables.append_log(log.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == k), f"{root}/log", f"b{k}")
        state.update(f"{root}/log")
    return state.read()


def _snk2(v: Views) -> DataFrame:
    path = _root(v, "snk2")
    tables.write_fit(*v.proportions, path)
    item_fit, model_fit = tables.read_fit(v.spark, path)
    return item_fit.agg(F.count(F.lit(1)).alias("n_items"), _r(F.avg("b")).alias("mean_b")).crossJoin(model_fit.agg(F.count(F.lit(1)).alias("n_models"), _r(F.avg("theta")).alias("mean_theta")))


def _snk3(v: Views) -> DataFrame:
    path = _root(v, "snk3")
    report = reports.base_rate(v.items)
    tables.write_report(report, path + "/json")
    tables.write_report(report, path + "/csv", "csv")
    schema = "grp STRING, base_rate DOUBLE, n_items BIGINT"
    back = [v.spark.read.schema(schema).json(path + "/json"), v.spark.read.schema(schema).option("header", True).csv(path + "/csv")]
    return back[0].withColumn("kind", F.lit("json")).union(back[1].withColumn("kind", F.lit("csv"))).withColumn("base_rate", _r("base_rate"))


_register("src1_read_items", _src1, "SELECT item_id::VARCHAR AS item_id, grp_raw, category, truth, grp FROM items")
_register("src2_read_log", _src2, "SELECT model_id, count(*) AS n, count(error) AS n_error, sum(length(raw_text))::BIGINT AS chars FROM log GROUP BY 1")
_register("src3_read_embeddings", _src3, "SELECT vec_id::VARCHAR AS item_id, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) + 0 AS first_value FROM embeddings", False)
_register("src4_registry", lambda v: v.asked, "SELECT * FROM asked")
_register("snk1_append_log", _snk1, "SELECT model_id, count(*) AS n FROM log GROUP BY 1")
_reduced("snk1_append_log", partial(_snk1, respondents=["m0", "m1"]), "SELECT model_id, count(*) AS n FROM log WHERE model_id IN ('m0', 'm1') GROUP BY 1")
_register(
    "snk2_write_fit",
    _snk2,
    "SELECT * FROM (SELECT count(*) AS n_items, round(avg(b), 6) + 0 AS mean_b FROM item_fit), (SELECT count(*) AS n_models, round(avg(theta), 6) + 0 AS mean_theta FROM model_fit)",
)
_register("snk3_write_report", _snk3, "SELECT grp, round(avg(truth::INT), 6) + 0 AS base_rate, count(*) AS n_items, kind FROM items, (VALUES ('json'), ('csv')) AS k(kind) GROUP BY grp, kind")

# -- projections and filters ------------------------------------------------------------------------

_register(
    "prj1_select_respondents",
    lambda v: responses.select_respondents(v.asked, sources=["huggingface", "api-openai"]).select("id", "family", "source", "n_rows"),
    "SELECT id, family, source, n_rows FROM asked WHERE NOT optional AND source IN ('huggingface', 'api-openai')",
)
_register(
    "prj2_drop_errors",
    lambda v: responses.drop_errors(v.log).groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).withColumn("policy", F.lit("strict"))
    .union(responses.drop_errors(v.log, "truthy").groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).withColumn("policy", F.lit("truthy"))),
    """SELECT model_id, count(*) AS n, 'strict' AS policy FROM log WHERE error IS NULL GROUP BY 1
       UNION ALL SELECT model_id, count(*), 'truthy' FROM log WHERE error IS NULL OR error = '' GROUP BY 1""",
)
_register(
    "prj3_parse_answers",
    lambda v: responses.parse_answers(responses.drop_errors(v.log)).select("model_id", "item_id", "ord", "label", "confidence", "reasoning", "used_fallback"),
    f"""SELECT model_id, item_id, ord, label, CASE WHEN answered THEN nullif(lower(regexp_extract(raw_text, '(?i)Confidence:\\s*(low|medium|high)', 1)), '') END AS confidence,
          CASE WHEN answered THEN nullif(regexp_replace(regexp_extract(raw_text, '(?is)Reasoning:\\s*(.+)', 1), '^\\s+|\\s+$', '', 'g'), '') END AS reasoning, false AS used_fallback
        FROM (SELECT *, {_LABEL} AS label, {_ANSWER} <> '' AS answered FROM ok)""",
)
_register(
    "prj4_score",
    lambda v: v.answers.groupBy("model_id", "label", "truth").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("right")),
    'SELECT model_id, label, truth, count(*) AS n, sum(y)::BIGINT AS "right" FROM answers GROUP BY ALL',
)
_register(
    "prj5_classify_errors",
    lambda v: responses.classify_errors(v.log),
    """SELECT model_id, CASE WHEN lower(error) LIKE '%429%' OR lower(error) LIKE '%resource_exhausted%' OR lower(error) LIKE '%rate_limit%' OR lower(error) LIKE '%rate limit%'
         OR lower(error) LIKE '%overloaded%' OR lower(error) LIKE '%quota%' THEN 'rate_limit' ELSE 'other' END AS kind, count(*) AS n FROM log WHERE error <> '' GROUP BY ALL""",
)
_register("prj6_exclude_group", lambda v: responses.exclude_group(v.items, "III-IV").select("item_id", "grp", "category"), "SELECT item_id, grp, category FROM items WHERE grp <> 'III-IV'")
_register(
    "prj7_short_name",
    lambda v: v.asked.select("id", "n_rows", responses.short_name(F.concat(F.lit("hub/"), "source", F.lit("/"), "family"), [("clip", "CLIP"), ("gpt", "GPT"), ("dino", "DINO")]).alias("name")),
    """SELECT id, n_rows, CASE WHEN family LIKE '%clip%' THEN 'CLIP' WHEN family LIKE '%gpt%' THEN 'GPT' WHEN family LIKE '%dino%' THEN 'DINO' ELSE family END AS name FROM asked""",
)
_register(
    "prj8_restrict_panel",
    lambda v: responses.restrict_panel(v.cells, ["m3", "m4", "m5", "m6", "m7"]).groupBy("model_id").agg(F.count("y").alias("n"), F.sum("y").alias("correct")),
    "SELECT model_id, count(y) AS n, sum(y)::BIGINT AS correct FROM cells WHERE model_id IN ('m3', 'm4', 'm5', 'm6', 'm7') GROUP BY 1",
)

# -- joins --------------------------------------------------------------------------------------------

_register(
    "jn1_attach_items",
    lambda v: responses.attach_items(responses.drop_errors(v.log), v.items.where("item_id % 3 <> 0"), "left").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("n_known")),
    "SELECT i.grp, count(*) AS n, count(i.category) AS n_known FROM ok LEFT JOIN (SELECT * FROM items WHERE item_id % 3 <> 0) i USING (item_id) GROUP BY 1",
)
_register(
    "jn2_pending_pairs",
    lambda v: responses.pending_pairs(v.registry, v.items, v.log),
    "SELECT id AS model_id, item_id FROM registry, items EXCEPT SELECT model_id, item_id FROM ok",
)
_register(
    "jn3_new_answers",
    lambda v: responses.new_answers(v.items.select("item_id", F.lit("Answer: benign").alias("raw_text")), responses.drop_errors(v.log), "m8"),
    "SELECT item_id, 'Answer: benign' AS raw_text FROM items WHERE item_id NOT IN (SELECT item_id FROM ok WHERE model_id = 'm8')",
)
_register(
    "jn4_align_embeddings",
    lambda v: responses.align_embeddings(
        v.embeddings.withColumn("embedding", F.when(F.col("item_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))), v.items
    ).select("item_id", F.size("embedding").alias("width"), _r(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total")),
    """SELECT vec_id AS item_id, len(embedding)::INT AS width, round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) END, 6) + 0 AS total
       FROM embeddings JOIN items ON vec_id = item_id""",
)
_register(
    "jn5_circularity_flags",
    lambda v: v.cells.join(responses.circularity_flags(v.asked, "dinov3"), "model_id").groupBy("circular").agg(F.count_distinct("model_id").alias("n_models"), F.count("y").alias("n_answers")),
    "SELECT family = 'dinov3' AS circular, count(DISTINCT model_id) AS n_models, count(y) AS n_answers FROM cells JOIN asked ON id = model_id GROUP BY 1",
)
_RANKED = "(SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {t})"


def _jn6(v: Views) -> DataFrame:
    item_fit, model_fit = v.proportions
    other = v.answers.where("grp <> 'III-IV'").select("model_id", "item_id", "y").where("y IS NOT NULL")
    logit = F.log((F.sum("y") + 0.5) / (F.count("y") - F.sum("y") + 0.5))
    return irt.compare_fits(item_fit, model_fit, other.groupBy("item_id").agg((-logit).alias("b")), other.groupBy("model_id").agg(logit.alias("theta"))).withColumn("rho", _r("rho"))


_register(
    "jn6_compare_fits",
    _jn6,
    f""", o AS (SELECT * FROM answers WHERE grp <> 'III-IV' AND y IS NOT NULL),
      ib AS (SELECT item_id, round(b, 12) AS x, round(-ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)), 12) AS y FROM o JOIN item_fit USING (item_id) GROUP BY item_id, b),
      mb AS (SELECT model_id, theta AS x, ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)) AS y FROM o JOIN model_fit USING (model_id) GROUP BY model_id, theta)
    SELECT 'items' AS over, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM {_RANKED.format(x='x', y='y', t='ib')}
    UNION ALL SELECT 'respondents', count(*), round(corr(rx, ry), 6) + 0 FROM {_RANKED.format(x='x', y='y', t='mb')}""",
)
_FAMILY = " UNION ALL ".join(f"SELECT '{f}' AS family, '{g}' AS family_group" for g, fs in fixtures.FAMILY_GROUPS.items() for f in fs)
_register(
    "jn7_family_panel",
    lambda v: responses.family_panel(v.cells.join(v.items.select("item_id", "grp"), "item_id"), v.registry, fixtures.FAMILY_GROUPS).withColumn("accuracy", _r("accuracy")),
    f""", fam AS ({_FAMILY}), named AS (SELECT id AS model_id, family_group, count(*) OVER (PARTITION BY family_group) AS k FROM registry LEFT JOIN fam USING (family))
    SELECT CASE WHEN k >= 2 THEN family_group ELSE 'other' END AS family_group, grp, round(avg(y), 6) + 0 AS accuracy, count(y) AS n_answered, count(DISTINCT model_id) AS n_models
    FROM cells JOIN items USING (item_id) JOIN named USING (model_id) GROUP BY 1, 2""",
)

# -- dedupe and the response matrix ---------------------------------------------------------------------

_register("dd1_first_success", lambda v: responses.first_success(v.log).select("model_id", "item_id", "ord", "raw_text"), "SELECT model_id, item_id, ord, raw_text FROM first")
_register(
    "dd2_latest_success",
    lambda v: responses.latest_success(v.log).select("model_id", "item_id", "ord", "raw_text"),
    "SELECT model_id, item_id, ord, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY model_id, item_id ORDER BY ts DESC, ord DESC) AS rn FROM ok) WHERE rn = 1",
)
_register("dd3_response_cells", lambda v: v.cells, "SELECT * FROM cells")
_register("dd3_response_cells_resumed", lambda v: responses.cells_of_state(_resumed(v)), "SELECT model_id, item_id::VARCHAR AS item_id, y, refused FROM cells")
_register(
    "dd4_to_matrix",
    lambda v: responses.to_matrix(v.cells, _PANEL),
    "SELECT item_id, " + ", ".join(f"max(y) FILTER (WHERE model_id = '{m}') AS {m}" for m in _PANEL) + " FROM cells GROUP BY 1",
)


def _min_n(v: Views) -> int:
    """The coverage bound scaled to the number of items: 91.5 % of them, rounded up."""
    n = v.items.count()
    return -(-915 * n // 1000)


_register(
    "dd5_coverage",
    lambda v: responses.coverage(v.cells, _min_n(v)),
    "SELECT model_id, count(y) AS n_answered, count(y) >= (SELECT ceil(0.915 * count(*)) FROM items) AS kept FROM cells GROUP BY 1",
)
_register(
    "dd6_saturated_items",
    lambda v: responses.saturated_items(v.cells),
    "SELECT item_id, count(y) AS n_valid, coalesce(sum(y), 0)::BIGINT AS n_correct, coalesce(sum(y), 0) IN (0, count(y)) AS saturated FROM cells GROUP BY 1",
)
_register(
    "dd7_log_summary",
    lambda v: responses.log_summary(v.log),
    "SELECT model_id, count(*) AS n_rows, count(*) FILTER (WHERE error IS NULL) AS n_success, count(error) AS n_error, count(DISTINCT item_id) AS n_items FROM log GROUP BY ROLLUP (model_id)",
)
_register(
    "dd7_log_summary_resumed",
    lambda v: responses.summary_of_state(_resumed(v)),
    "SELECT model_id, count(*) AS n_rows, count(*) FILTER (WHERE error IS NULL) AS n_success, count(error) AS n_error, count(DISTINCT item_id) AS n_items FROM log GROUP BY ROLLUP (model_id)",
)
_DRAW = "('0x' || substr(md5('{seed}|' || {key}::VARCHAR), 1, 8))::BIGINT"
_register(
    "dd8_holdout_split",
    lambda v: responses.holdout_split(v.items.select("item_id"), 0.2, 7),
    f"SELECT item_id, row_number() OVER (ORDER BY {_DRAW.format(seed=7, key='item_id')}, item_id) <= (SELECT floor(0.2 * count(*)) FROM items) AS holdout FROM items",
)
_register(
    "dd9_stratified_subset",
    lambda v: responses.stratified_subset(v.items, ["grp", "truth"], 100, 3).select("item_id", "grp", "truth"),
    f"""SELECT item_id, grp, truth FROM (SELECT *, row_number() OVER (PARTITION BY grp, truth ORDER BY {_DRAW.format(seed=3, key='item_id')}, item_id) AS r FROM items)
        WHERE r <= (SELECT 100 // count(*) FROM (SELECT DISTINCT grp, truth FROM items))""",
)

# -- reports ----------------------------------------------------------------------------------------------

_register(
    "ag1_contingency",
    lambda v: reports.contingency(v.items, "category", "grp", _GROUPS),
    """SELECT coalesce(category, 'Total') AS category, count(*) FILTER (WHERE grp = 'I-II') AS "I-II", count(*) FILTER (WHERE grp = 'III-IV') AS "III-IV",
         count(*) FILTER (WHERE grp = 'V-VI') AS "V-VI", count(*) AS "Total" FROM items GROUP BY ROLLUP (category)""",
)
_register(
    "ag1_contingency_second",
    lambda v: reports.contingency(v.second, "category", "grp", ["en", "de", "fr", "es"]),
    "SELECT coalesce(category, 'Total') AS category, " + ", ".join(f"count(*) FILTER (WHERE grp = '{g}') AS {g}" for g in ("en", "de", "fr", "es")) + ', count(*) AS "Total" FROM second GROUP BY ROLLUP (category)',
)
_register("ag2_base_rate", lambda v: reports.base_rate(v.items).withColumn("base_rate", _r("base_rate")), "SELECT grp, round(avg(truth::INT), 6) + 0 AS base_rate, count(*) AS n_items FROM items GROUP BY 1")
_ACC = """, acc AS (SELECT model_id, grp, avg(y) AS accuracy, count(y) AS n_answered, count(*) FILTER (WHERE label = 'refusal') AS n_refused, count(*) AS n_total FROM answers GROUP BY 1, 2)"""
_register(
    "ag3_stratified_accuracy",
    lambda v: (lambda acc: acc.join(reports.accuracy_gap(acc), "model_id"))(v.once(reports.stratified_accuracy(v.answers))).withColumn("accuracy", _r("accuracy")).withColumn("gap", _r("gap")),
    _ACC
    + """SELECT acc.* REPLACE (round(accuracy, 6) + 0 AS accuracy), round(max(CASE WHEN grp = 'V-VI' THEN accuracy END) OVER w - max(CASE WHEN grp = 'I-II' THEN accuracy END) OVER w, 6) + 0 AS gap
         FROM acc WINDOW w AS (PARTITION BY model_id)""",
)
_register(
    "ag4_pooled_macro_accuracy",
    lambda v: reports.pooled_macro_accuracy(reports.stratified_accuracy(v.answers)).withColumn("accuracy", _r("accuracy")),
    _ACC + "SELECT grp, round(avg(accuracy), 6) + 0 AS accuracy, count(accuracy) AS n_models FROM acc GROUP BY 1",
)
_register(
    "ag4_pooled_gap",
    lambda v: reports.pooled_gap(reports.stratified_accuracy(v.answers)).select(*[_r(c).alias(c) for c in ("focal", "reference", "gap")]),
    _ACC
    + """, p AS (SELECT avg(accuracy) FILTER (WHERE grp = 'V-VI') AS f, avg(accuracy) FILTER (WHERE grp = 'I-II') AS r FROM acc)
         SELECT round(f, 6) + 0 AS focal, round(r, 6) + 0 AS reference, round(f - r, 6) + 0 AS gap FROM p""",
)


def _wide_sql() -> str:
    parts = []
    for g in _GROUPS:
        at = f"FILTER (WHERE grp = '{g}')"
        parts += [f"round_even(avg(y) {at}, 3) AS \"acc_{g}\"", f"round_even(avg((label = 'malignant')::INT) {at}, 3) AS \"pred_mal_{g}\"", f"count(*) {at} AS \"n_{g}\""]
    return f"""SELECT *, round_even("acc_V-VI" - "acc_I-II", 3) AS gap FROM (SELECT model_id, {', '.join(parts)} FROM answers WHERE y IS NOT NULL GROUP BY 1)"""


_register("ag5_accuracy_wide", lambda v: reports.accuracy_wide(v.answers, _GROUPS), _wide_sql())
_register(
    "ag6_prediction_distribution",
    lambda v: reports.prediction_distribution(
        responses.attach_items(responses.parse_answers(responses.latest_success(v.log)), v.items), int(0.8 * v.items.count())
    ).select("model_id", "grp", *[_r(c).alias(c) for c in (*reports.LABELS, "true_share")], "n"),
    f""", latest AS (SELECT *, {_LABEL} AS label FROM (SELECT *, row_number() OVER (PARTITION BY model_id, item_id ORDER BY ts DESC, ord DESC) AS rn FROM ok) JOIN items USING (item_id) WHERE rn = 1)
    SELECT model_id, grp, """
    + ", ".join(f"round(avg((label = '{name}')::INT), 6) + 0 AS {name}" for name in reports.LABELS)
    + """, round(avg(truth::INT), 6) + 0 AS true_share, count(*) AS n FROM latest
        WHERE model_id IN (SELECT model_id FROM latest GROUP BY 1 HAVING count(*) >= (SELECT floor(0.8 * count(*)) FROM items)) GROUP BY 1, 2""",
)
_register(
    "ag7_refusal_rate",
    lambda v: reports.refusal_rate(v.cells, v.items, v.registry).withColumn("refusal_rate", _r("refusal_rate")).select("grp", "model_id", "n_refused", "n_items", "refusal_rate"),
    """SELECT grp, id AS model_id, count(*) FILTER (WHERE refused) AS n_refused, count(*) AS n_items, round(count(*) FILTER (WHERE refused) / count(*), 6) + 0 AS refusal_rate
       FROM registry CROSS JOIN items LEFT JOIN cells ON cells.model_id = id AND cells.item_id = items.item_id GROUP BY GROUPING SETS ((grp, id), (grp))""",
)
_register(
    "ag8_matched_gap",
    lambda v: reports.matched_gap(v.answers).select("n_categories", "n_items_focal", "n_items_reference", *[_r(c).alias(c) for c in ("acc_focal", "acc_reference", "matched_gap", "unmatched_gap")]),
    """, two AS (SELECT * FROM answers WHERE y IS NOT NULL AND grp IN ('I-II', 'V-VI')),
      shared AS (SELECT category FROM two WHERE grp = 'I-II' INTERSECT SELECT category FROM two WHERE grp = 'V-VI'),
      m AS (SELECT * FROM two WHERE category IN (SELECT category FROM shared)),
      a AS (SELECT avg(y) FILTER (WHERE grp = 'V-VI') AS f, avg(y) FILTER (WHERE grp = 'I-II') AS r, count(DISTINCT item_id) FILTER (WHERE grp = 'V-VI') AS nf, count(DISTINCT item_id) FILTER (WHERE grp = 'I-II') AS nr FROM m),
      u AS (SELECT avg(y) FILTER (WHERE grp = 'V-VI') - avg(y) FILTER (WHERE grp = 'I-II') AS g FROM two)
    SELECT (SELECT count(*) FROM shared) AS n_categories, nf AS n_items_focal, nr AS n_items_reference, round(f, 6) + 0 AS acc_focal, round(r, 6) + 0 AS acc_reference,
      round(f - r, 6) + 0 AS matched_gap, round(g, 6) + 0 AS unmatched_gap FROM a, u""",
)
_KAPPA = """, p AS (SELECT item_id, model_id, (label = 'malignant')::INT AS p FROM answers WHERE y IS NOT NULL),
  k AS (SELECT a.model_id AS model_a, b.model_id AS model_b, count(*) AS n, avg((a.p = b.p)::INT) AS o, avg(a.p) * avg(b.p) + (1 - avg(a.p)) * (1 - avg(b.p)) AS e
        FROM p a JOIN p b ON a.item_id = b.item_id AND a.model_id < b.model_id GROUP BY 1, 2)"""
_register(
    "ag9_kappa_matrix",
    lambda v: reports.kappa_matrix(v.answers).withColumn("kappa", _r("kappa")),
    _KAPPA + "SELECT model_a, model_b, n, round((o - e) / (1 - e), 6) + 0 AS kappa FROM k",
)
_register(
    "ag10_degeneracy_screen",
    lambda v: (lambda a: reports.degeneracy_screen(a, reports.kappa_matrix(a), 0.6, 0.2))(v.once(v.answers.select("model_id", "item_id", "label", "y", "truth"))).select(
        "model_id", *[_r(c).alias(c) for c in ("positive_share", "max_kappa", "majority_share", "constant_ability")], "flagged"
    ),
    _KAPPA
    + """, s AS (SELECT model_id, avg((label = 'malignant')::INT) AS q, avg(truth::INT) AS base FROM answers WHERE y IS NOT NULL GROUP BY 1),
      c AS (SELECT model_id, max((o - e) / (1 - e)) AS mk FROM (SELECT model_a AS model_id, o, e FROM k UNION ALL SELECT model_b, o, e FROM k) GROUP BY 1)
    SELECT model_id, round(q, 6) + 0 AS positive_share, round(mk, 6) + 0 AS max_kappa, round(greatest(q, 1 - q), 6) + 0 AS majority_share,
      round(CASE WHEN q >= 0.5 THEN ln(base / (1 - base)) ELSE ln((1 - base) / base) END, 6) + 0 AS constant_ability, greatest(q, 1 - q) >= 0.6 OR coalesce(mk >= 0.2, false) AS flagged
    FROM s LEFT JOIN c USING (model_id)""",
)


def _runs(v: Views) -> DataFrame:
    """A run for each respondent: the shift of its own answers between groups, standing for a seed."""
    gap = reports.accuracy_gap(reports.stratified_accuracy(v.answers))
    return gap.select(F.col("gap").alias("delta"), (F.col("gap") - 0.1).alias("ci_low"), (F.col("gap") + 0.2).alias("ci_high"), (0.5 + F.col("gap")).alias("auc"), F.when(F.col("gap") > 0, "up").otherwise("down").alias("decision"))


_register(
    "ag11_sweep_summary",
    lambda v: reports.sweep_summary(_runs(v)).select("n_runs", *[_r(c).alias(c) for c in ("median_delta", "min_delta", "max_delta", "iqr_delta", "median_ci_width", "median_auc")], "all_same"),
    _ACC
    + """, g AS (SELECT model_id, max(accuracy) FILTER (WHERE grp = 'V-VI') - max(accuracy) FILTER (WHERE grp = 'I-II') AS d FROM acc GROUP BY 1)
    SELECT count(*) AS n_runs, round(quantile_cont(d, 0.5), 6) + 0 AS median_delta, round(min(d), 6) + 0 AS min_delta, round(max(d), 6) + 0 AS max_delta,
      round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) + 0 AS iqr_delta, round(quantile_cont(d + 0.2 - (d - 0.1), 0.5), 6) + 0 AS median_ci_width,
      round(quantile_cont(0.5 + d, 0.5), 6) + 0 AS median_auc, count(DISTINCT d > 0) = 1 AS all_same FROM g""",
)
_register(
    "ag12_fit_summary",
    lambda v: reports.fit_summary(*v.proportions).select(*[_r(c).alias(c) for c in ("sd_b", "min_b", "max_b", "sd_theta")]),
    """SELECT round(stddev_pop(b), 6) + 0 AS sd_b, round(min(b), 6) + 0 AS min_b, round(max(b), 6) + 0 AS max_b, (SELECT round(stddev_pop(theta), 6) + 0 FROM model_fit) AS sd_theta FROM item_fit""",
)

# -- calibration ------------------------------------------------------------------------------------------

_PRUNED = "pruned AS (SELECT * FROM cells WHERE y IS NOT NULL AND item_id IN (SELECT item_id FROM cells GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(y)))"


def _solved_sql(source: str, steps: int = 12) -> str:
    """Difficulties b of packed items (js, ys) at the abilities th: Newton steps from 0, each nested in the next."""
    p = "1 / (1 + exp(b - th[js[i]]))"
    total = lambda x: f"list_sum(list_transform(range(1, len(js) + 1), lambda i: {x}))"
    step = f"greatest(-1, least(1, {total(f'ys[i] - {p}')} / greatest({total(f'{p} * (1 - {p})')}, 1e-6)))"
    out = f"SELECT item_id, js, ys, th, k, 0.0::DOUBLE AS b FROM {source}"
    for _ in range(steps):
        out = f"SELECT item_id, js, ys, th, k, greatest(-8, least(8, b - {step})) AS b FROM ({out})"
    return out


def _rasch_sql(source: str = "pruned", name: str = "", rounds: int = 200, steps: int = 12, tol: float = 1e-8) -> str:
    """Joint maximum likelihood by alternating rounds, as a recursion over one row of abilities: `panel`, `packed` and `last`, each with `name` before it."""
    last_round = f"(SELECT * FROM {name}rounds WHERE moved >= {tol} AND k < {rounds})"
    return f"""{name}panel AS MATERIALIZED (SELECT model_id, row_number() OVER (ORDER BY model_id) AS j FROM (SELECT DISTINCT model_id FROM {source})),
      {name}packed AS MATERIALIZED (SELECT item_id, list(j ORDER BY j) AS js, list(y::DOUBLE ORDER BY j) AS ys FROM {source} JOIN {name}panel USING (model_id) GROUP BY 1),
      {name}rounds AS (
        SELECT 0 AS k, list_transform(range((SELECT count(*) FROM {name}panel)), lambda x: 0.0::DOUBLE) AS th, 1.0::DOUBLE AS moved UNION ALL
        SELECT k + 1, list_transform(next, lambda x: x - list_avg(next)), moved FROM (SELECT k, list(theta + step ORDER BY j) AS next, max(abs(step)) AS moved FROM (
          SELECT k, j, any_value(theta) AS theta, greatest(-1, least(1, sum(y - p) / greatest(sum(p * (1 - p)), 1e-6))) AS step FROM (
            SELECT k, j, y, th[j] AS theta, 1 / (1 + exp(b - th[j])) AS p FROM (SELECT k, b, th, unnest(js) AS j, unnest(ys) AS y FROM ({_solved_sql(f"{name}packed, {last_round}", steps)})))
          GROUP BY k, j) GROUP BY k)),
      {name}last AS (SELECT k, th FROM {name}rounds ORDER BY k DESC LIMIT 1)"""


def _ir1(v: Views, **options) -> DataFrame:
    item_fit, model_fit = irt.fit_rasch(v.once(responses.prune_saturated(v.cells)), **options)
    return item_fit.select(F.lit("item").alias("kind"), F.col("item_id").cast("string").alias("id"), _r("b", 5).alias("value")).union(
        model_fit.select(F.lit("model"), "model_id", _r("theta", 5))
    )


_register(
    "ir1_fit_rasch",
    _ir1,
    f""", {_PRUNED}, {_rasch_sql()}
    SELECT 'item' AS kind, item_id::VARCHAR AS id, round(b, 5) + 0 AS value FROM ({_solved_sql("packed, last")}) UNION ALL SELECT 'model', model_id, round(th[j], 5) + 0 FROM panel, last""",
)


def _amortized(v: Views) -> irt.AmortizedFit:
    return irt.fit_amortized(v.once(responses.prune_saturated(v.cells)), v.embeddings)


_register("ir2_fit_amortized", lambda v: _amortized(v).model_fit(v.spark))
_register("ir3_score_difficulty", lambda v: irt.score_difficulty(_amortized(v), responses.align_embeddings(v.embeddings, v.items)))
_DIMS, _HIDDEN = 64, 3


def _ir3_given(v: Views) -> DataFrame:
    """Difficulties of all items with an embedding by a small network of given weights."""
    k = np.arange(_DIMS * _HIDDEN + _HIDDEN * _HIDDEN + 3 * _HIDDEN + 1)
    network = MLP(_DIMS, _HIDDEN, (k * 7919 % 1009) / 1009 - 0.5)
    return irt.score_difficulty(irt.AmortizedFit([], np.zeros(0), network, []), v.embeddings).withColumn("b", _r("b"))


def _weight(k: str) -> str:
    return f"((({k}) * 7919) % 1009 / 1009.0::DOUBLE - 0.5)"


def _network_sql() -> str:
    """e, outs and act: what the second layer gives for each item."""
    d, h = _DIMS, _HIDDEN
    gelu = """z * 0.5 * (1 + sign(z) * (1 - exp(-z * z / 2) * (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))))"""
    active = lambda source: f"(SELECT item_id, o, {gelu} AS g FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z / sqrt(2))) AS t FROM ({source})))"
    first = f"SELECT item_id, o, sum(x * {_weight(f'(i - 1) * {h} + o')}) + {_weight(f'{d * h} + o')} AS z FROM e, outs GROUP BY item_id, o"
    second = f"SELECT item_id, outs.o, sum(g * {_weight(f'{d * h + h} + a.o * {h} + outs.o')}) + {_weight(f'{d * h + h + h * h} + outs.o')} AS z FROM {active(first)} a, outs GROUP BY item_id, outs.o"
    return f"""e AS (SELECT vec_id AS item_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), outs AS (SELECT unnest(range({h})) AS o),
      act AS MATERIALIZED {active(second)}"""


_LAST = _DIMS * _HIDDEN + 2 * _HIDDEN + _HIDDEN * _HIDDEN
_GIVEN_B = f"SELECT item_id, sum(g * {_weight(f'{_LAST} + o')}) + {_weight(str(_LAST + _HIDDEN))} AS b FROM act GROUP BY item_id"


_register("ir3_score_given_network", _ir3_given, f"WITH {_network_sql()} SELECT item_id, round(b, 6) + 0 AS b FROM ({_GIVEN_B})", False)


def _ir2_given(v: Views) -> DataFrame:
    """The objective of the amortised fit and its slopes in the abilities and the network's last weights, at given values."""
    job = irt.AmortizedJob(v.once(responses.prune_saturated(v.cells)), v.embeddings, [{}], _HIDDEN)
    n = len(job.models[0])
    k = np.arange(_DIMS * _HIDDEN + _HIDDEN * _HIDDEN + 3 * _HIDDEN + 1)
    loss, slope = job.evaluate({0: np.concatenate([(np.arange(n) * 37 % 11 - 5) / 10, (k * 7919 % 1009) / 1009 - 0.5])})[0]
    job.close()
    rows = [("loss", loss), *((f"theta_{m}", float(g)) for m, g in zip(job.models[0], slope, strict=False)), *((f"w{i}", float(slope[n + len(k) - 1 - _HIDDEN + i])) for i in range(_HIDDEN + 1))]
    return v.spark.createDataFrame(rows, "term string, value double").withColumn("value", _r("value", 4))


_register(
    "ir2_objective_given",
    _ir2_given,
    f""", {_PRUNED}, {_network_sql()},
      ids AS (SELECT model_id, ((row_number() OVER (ORDER BY model_id) - 1) * 37 % 11 - 5) / 10.0::DOUBLE AS theta FROM (SELECT DISTINCT model_id FROM pruned)),
      fit AS (SELECT item_id, model_id, y::DOUBLE AS y, theta, b, theta - b AS z FROM pruned JOIN ids USING (model_id) JOIN ({_GIVEN_B}) USING (item_id)),
      item AS (SELECT item_id, any_value(b) AS b, -sum(1 / (1 + exp(-z)) - y) + 0.02 * any_value(b) AS slope FROM fit GROUP BY 1),
      ab AS (SELECT count(*) AS n, avg(theta) AS m, sum(theta * theta) AS tt FROM ids),
      ws AS (SELECT sum({_weight('k')} * {_weight('k')}) AS ww FROM range({_LAST + _HIDDEN + 1}) AS r(k))
    SELECT 'loss' AS term, round((SELECT sum(ln(1 + exp(z)) - y * z) FROM fit) + (SELECT 0.01 * sum(b * b) FROM item) + 0.01 * tt + 1000 * m * m + 0.00005 * ww, 4) + 0 AS value FROM ab, ws
    UNION ALL SELECT 'theta_' || model_id, round(sum(1 / (1 + exp(-z)) - y) + 0.02 * any_value(theta) + 2000 * any_value(m) / any_value(n), 4) + 0 FROM fit, ab GROUP BY model_id
    UNION ALL SELECT 'w' || o, round(sum(slope * g) + 0.0001 * any_value({_weight(f'{_LAST} + o')}), 4) + 0 FROM act JOIN item USING (item_id) GROUP BY o
    UNION ALL SELECT 'w{_HIDDEN}', round(sum(slope) + 0.0001 * {_weight(str(_LAST + _HIDDEN))}, 4) + 0 FROM item""",
)
_register(
    "ir4_predict_prob",
    lambda v: irt.predict_prob(v.proportions[1], v.proportions[0]).withColumn("p", _r("p")),
    "SELECT model_id, item_id, round(1 / (1 + exp(b - theta)), 6) + 0 AS p FROM model_fit, item_fit",
)
_AUC = """, s AS (SELECT y, round(1 / (1 + exp(b - theta)), 12) AS p FROM cells JOIN item_fit USING (item_id) JOIN model_fit USING (model_id) WHERE y IS NOT NULL),
  r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s),
  auc AS (SELECT (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc, count(*) AS n FROM r)"""


def _auc(v: Views) -> DataFrame:
    item_fit, model_fit = v.proportions
    return irt.heldout_auc(irt.cell_probabilities(v.cells, model_fit, item_fit))


_register("ir5_heldout_auc", lambda v: _auc(v).select(_r("auc").alias("auc"), "n"), _AUC + "SELECT round(auc, 6) + 0 AS auc, n FROM auc")
_INFIT = """, s AS (SELECT item_id, y, 1 / (1 + exp(b - theta)) AS p FROM cells JOIN item_fit USING (item_id) JOIN model_fit USING (model_id) WHERE y IS NOT NULL),
  fits AS (SELECT item_id, avg((y - p) * (y - p) / greatest(p * (1 - p), 1e-6)) AS outfit, sum((y - p) * (y - p)) / sum(p * (1 - p)) AS infit FROM s GROUP BY 1)"""


def _infit(v: Views) -> DataFrame:
    item_fit, model_fit = v.proportions
    return irt.infit_outfit(v.cells, model_fit, item_fit)


_register("ir6_infit_outfit", lambda v: _infit(v).select("item_id", _r("outfit", 5).alias("outfit"), _r("infit", 5).alias("infit")), _INFIT + "SELECT item_id, round(outfit, 5) + 0 AS outfit, round(infit, 5) + 0 AS infit FROM fits")
_register(
    "ir7_misfit_flags",
    lambda v: irt.misfit_flags(_infit(v)).select("item_id", "misfit"),
    _INFIT + "SELECT item_id, infit NOT BETWEEN 0.7 AND 1.3 OR outfit NOT BETWEEN 0.7 AND 1.3 AS misfit FROM fits",
)


def _ir8(v: Views) -> DataFrame:
    found = irt.calibrate(v.cells, v.items, v.embeddings, min_n=int(0.8 * v.items.count()))
    return found["item_fit"].crossJoin(found["fit_meta"])


_register("ir8_calibrate", _ir8)


def _ir9(v: Views, **options) -> DataFrame:
    return irt.configural_invariance(v.once(responses.prune_saturated(v.cells)), v.items, **options).select("n", _r("rho").alias("rho"), "invariant")


_register(
    "ir9_configural_invariance",
    _ir9,
    f""", {_PRUNED}, pa AS (SELECT pruned.* FROM pruned JOIN items USING (item_id) WHERE grp = 'I-II'), pb AS (SELECT pruned.* FROM pruned JOIN items USING (item_id) WHERE grp = 'V-VI'),
      {_rasch_sql('pa', 'a_')}, {_rasch_sql('pb', 'z_')},
      j AS (SELECT a_last.th[a_panel.j] AS x, z_last.th[z_panel.j] AS y FROM a_panel JOIN z_panel USING (model_id), a_last, z_last)
    SELECT count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho, corr(rx, ry) > 0.9 AS invariant FROM {_RANKED.format(x='x', y='y', t='j')}""",
)

_register("ir9_configural_invariance_amortized", lambda v: irt.configural_invariance_amortized(v.once(responses.prune_saturated(v.cells)), v.items, v.embeddings))


def _ir10(v: Views) -> DataFrame:
    """The shift between groups by the penalty on difficulty and the seed of the weights."""
    scratch = Scratch(v.spark, "sweep")
    cells = scratch.table(responses.prune_saturated(v.cells), "cells")
    items = scratch.table(v.items, "items")

    def run(fit: irt.AmortizedFit) -> DataFrame:
        return regress.group_shift(regress.residualize(irt.score_difficulty(fit, v.embeddings), items))

    return irt.sweep(cells, v.embeddings, [{"seed": s, "difficulty_l2": l2} for s, l2 in ((1, 1e-2), (2, 1e-2), (1, 1e-1))], run)


_register("ir10_sweep", _ir10)


def _ir11(v: Views) -> DataFrame:
    item_fit, _ = v.proportions
    other = v.answers.where("y IS NOT NULL").groupBy("item_id").agg((-F.log((F.sum("y") + 0.5) / (F.count("y") - F.sum("y") + 0.5))).alias("y"))
    rho = stats.spearman(item_fit.select("item_id", F.round("b", 9).alias("x")).join(other.withColumn("y", F.round("y", 9)), "item_id"), "x", "y")
    return irt.validation_gate(_auc(v), rho).select(_r("auc").alias("auc"), _r("rho").alias("rho"), "accepted", "use")


_register(
    "ir11_validation_gate",
    _ir11,
    _AUC
    + f""", j AS (SELECT round(b, 9) AS x, round(-ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)), 9) AS y FROM answers JOIN item_fit USING (item_id) WHERE y IS NOT NULL GROUP BY item_id, b),
      rho AS (SELECT corr(rx, ry) AS rho FROM {_RANKED.format(x='x', y='y', t='j')})
    SELECT round(auc, 6) + 0 AS auc, round(rho, 6) + 0 AS rho, auc >= 0.65 AND rho >= 0.7 AS accepted, CASE WHEN auc >= 0.65 AND rho >= 0.7 THEN 'amortized' ELSE 'rasch' END AS use FROM auc, rho""",
)


def _ir11_fits(v: Views) -> DataFrame:
    """The gate between the two calibrations themselves: AUC on held-out items of the fit on the others, rho of both full fits' difficulties."""
    cells = v.once(responses.prune_saturated(v.cells))
    fit = irt.calibrate(cells, v.items, v.embeddings, min_n=0, prune=False)
    plain, _ = irt.fit_rasch(cells)
    network = v.once(fit["item_fit"].where("in_fit").select("item_id", F.col("b").alias("y")))
    rho = stats.spearman(plain.select("item_id", F.col("b").alias("x")).join(network, "item_id"), "x", "y")
    return irt.validation_gate(fit["fit_meta"].select(F.col("holdout_auc").alias("auc")), rho)


_register("ir11_validation_gate_fits", _ir11_fits)
_register(
    "ir12_ability_leaderboard",
    lambda v: irt.ability_leaderboard(v.proportions[1], v.answers).select("model_id", _r("theta").alias("theta"), "rank", _r("positive_share").alias("positive_share")),
    """SELECT model_id, round(theta, 6) + 0 AS theta, rank() OVER (ORDER BY theta DESC)::INT AS rank, round(q, 6) + 0 AS positive_share
       FROM model_fit JOIN (SELECT model_id, avg((label = 'malignant')::INT) AS q FROM answers WHERE y IS NOT NULL GROUP BY 1) USING (model_id)""",
)

# -- regression and contrasts ---------------------------------------------------------------------------

_register(
    "rg1_design",
    lambda v: regress.design(v.items, ["grp", "truth", "grp_raw"]).withColumn("value", _r("value")),
    """SELECT item_id, '(intercept)' AS term, 1.0::DOUBLE AS value FROM items UNION ALL SELECT item_id, 'grp_' || grp, 1.0 FROM items WHERE grp > (SELECT min(grp) FROM items)
       UNION ALL SELECT item_id, 'truth_True', 1.0 FROM items WHERE truth UNION ALL
       SELECT item_id, 'grp_raw', round((grp_raw - avg(grp_raw) OVER ()) / greatest(stddev_pop(grp_raw) OVER (), 1e-8), 6) + 0 FROM items""",
)
_register("rg2_residualize", lambda v: v.residuals.select("item_id", _r("b").alias("b"), _r("resid").alias("resid")), "SELECT item_id, round(b, 6) + 0 AS b, round(resid, 6) + 0 AS resid FROM resid")
_SHIFT = ", shift AS (SELECT avg(resid) FILTER (WHERE grp = 'V-VI') - avg(resid) FILTER (WHERE grp = 'I-II') AS delta, count(*) FILTER (WHERE grp = 'V-VI') AS n_focal, count(*) FILTER (WHERE grp = 'I-II') AS n_reference FROM resid)"
_register("rg3_group_shift", lambda v: regress.group_shift(v.residuals).withColumn("delta", _r("delta")), _SHIFT + "SELECT round(delta, 6) + 0 AS delta, n_focal, n_reference FROM shift")

_P = (1 << 31) - 1


def _draws_sql(seed: int, replicates: int, source: str) -> str:
    """u(replicate, item_id), with each step computed once."""
    return f"""(SELECT replicate, item_id, ((x3 * 48271 + {seed}) % {_P})::DOUBLE / {_P} AS u FROM (SELECT *, (x2 * x2 + item_id * 16807 + replicate) % {_P} AS x3 FROM (
      SELECT *, (x1 * x1 + replicate * 40692 + item_id) % {_P} AS x2 FROM (SELECT *, (item_id * 48271 + replicate * 69621 + {seed} * 16807 + 12345) % {_P} AS x1
      FROM (SELECT DISTINCT item_id FROM {source}), (SELECT unnest(range({replicates})) AS replicate)))))"""


_POISSON = "CASE " + " ".join(f"WHEN u < {s!r} THEN {k}" for k, s in enumerate(POISSON_STEPS.tolist())) + " ELSE 12 END"
def _boot_sql(replicates: int) -> str:
    return f""", w AS (SELECT replicate, item_id, {_POISSON} AS w FROM {_draws_sql(0xDD1, replicates, 'item_fit')}),
  wf AS (SELECT replicate, w, b, truth::INT AS t, grp, sum(w * b) OVER c / nullif(sum(w) OVER c, 0) AS mb, sum(w * truth::INT) OVER c / nullif(sum(w) OVER c, 0) AS mt
         FROM w JOIN item_fit USING (item_id) JOIN items USING (item_id) WINDOW c AS (PARTITION BY replicate, category)),
  beta AS (SELECT replicate, coalesce(sum(w * (t - mt) * (b - mb)) / nullif(sum(w * (t - mt) * (t - mt)), 0), 0) AS beta FROM wf WHERE w > 0 GROUP BY 1),
  boot AS (SELECT replicate, sum(w * r) FILTER (WHERE grp = 'V-VI') / sum(w) FILTER (WHERE grp = 'V-VI') - sum(w * r) FILTER (WHERE grp = 'I-II') / sum(w) FILTER (WHERE grp = 'I-II') AS delta
           FROM (SELECT replicate, w, grp, b - mb - beta * (t - mt) AS r FROM wf JOIN beta USING (replicate) WHERE w > 0) GROUP BY 1)"""


def _rg4(v: Views, **options) -> DataFrame:
    return regress.bootstrap_shift(v.proportions[0], v.items, **options).withColumn("delta", _r("delta", 5))


_register("rg4_bootstrap_shift", _rg4, _boot_sql(2000) + "SELECT replicate::INT AS replicate, round(delta, 5) + 0 AS delta FROM boot")
_reduced(
    "rg4_bootstrap_shift",
    partial(_rg4, replicates=20),
    _boot_sql(20) + "SELECT replicate::INT AS replicate, round(delta, 5) + 0 AS delta FROM boot",
)


def _rg5(v: Views, **options) -> DataFrame:
    item_fit = v.once(v.proportions[0])
    shift = regress.group_shift(regress.residualize(item_fit, v.items)).crossJoin(regress.interval(regress.bootstrap_shift(item_fit, v.items, **options)))
    return regress.decide(shift, 0.05, (0.0001, 0.7)).select(*[_r(c, 5).alias(c) for c in ("delta", "ci_low", "ci_high")], "threshold", "decision")


_DECIDE = (
    _SHIFT
    + """, ci AS (SELECT quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM boot)
    SELECT round(delta, 5) + 0 AS delta, round(lo, 5) + 0 AS ci_low, round(hi, 5) + 0 AS ci_high, t AS threshold,
      CASE WHEN (lo > 0 OR hi < 0) AND abs(delta) >= t THEN 'non_invariance' WHEN NOT (lo > 0 OR hi < 0) AND abs(delta) < t THEN 'no_effect' ELSE 'indeterminate' END AS decision
    FROM shift, ci, (SELECT unnest([0.05, 0.0001, 0.7]::DOUBLE[]) AS t)"""
)
_register("rg5_decide", _rg5, _boot_sql(2000) + _DECIDE)
_reduced("rg5_decide", partial(_rg5, replicates=20), _boot_sql(20) + _DECIDE)
_register(
    "rg6_fit_lltm",
    lambda v: regress.fit_lltm(v.proportions[0], v.items, ["grp"], replicates=0, spec="M_raw").select("spec", "term", _r("beta").alias("beta"), _r("r2").alias("r2")),
    """, m AS (SELECT grp, avg(b) AS mb, count(*) AS n FROM item_fit JOIN items USING (item_id) GROUP BY 1),
      r AS (SELECT 1 - sum((b - mb) * (b - mb)) / (SELECT var_pop(b) * count(*) FROM item_fit) AS r2 FROM item_fit JOIN items USING (item_id) JOIN m USING (grp))
    SELECT 'M_raw' AS spec, CASE WHEN grp = 'I-II' THEN '(intercept)' ELSE 'grp_' || grp END AS term,
      round(CASE WHEN grp = 'I-II' THEN mb ELSE mb - (SELECT mb FROM m WHERE grp = 'I-II') END, 6) + 0 AS beta, round(r2, 6) + 0 AS r2 FROM m, r""",
)
_register(
    "rg6_fit_lltm_group_intervals",
    lambda v: regress.fit_lltm(v.proportions[0], v.items, ["grp"], spec="M_raw").select("spec", "term", *[_r(c, 5).alias(c) for c in ("beta", "ci_low", "ci_high", "r2")]),
    f""", w AS (SELECT replicate, item_id, {_POISSON} AS w FROM {_draws_sql(0xDD3, 2000, 'item_fit')}),
      m AS (SELECT replicate, grp, sum(w * b) / nullif(sum(w), 0) AS mb FROM w JOIN item_fit USING (item_id) JOIN items USING (item_id) GROUP BY 1, 2 UNION ALL
            SELECT -1, grp, avg(b) FROM item_fit JOIN items USING (item_id) GROUP BY 2),
      t AS (SELECT m.replicate, CASE WHEN grp = 'I-II' THEN '(intercept)' ELSE 'grp_' || grp END AS term, CASE WHEN grp = 'I-II' THEN mb ELSE mb - base END AS beta
            FROM m JOIN (SELECT replicate, mb AS base FROM m WHERE grp = 'I-II') USING (replicate)),
      r AS (SELECT 1 - sum((b - mb) * (b - mb)) / (SELECT var_pop(b) * count(*) FROM item_fit) AS r2 FROM item_fit JOIN items USING (item_id) JOIN m USING (grp) WHERE replicate = -1)
    SELECT 'M_raw' AS spec, term, round(max(beta) FILTER (WHERE replicate < 0), 5) + 0 AS beta, round(quantile_cont(beta, 0.025) FILTER (WHERE replicate >= 0), 5) + 0 AS ci_low,
      round(quantile_cont(beta, 0.975) FILTER (WHERE replicate >= 0), 5) + 0 AS ci_high, round(any_value(r2), 5) + 0 AS r2 FROM t, r GROUP BY term""",
)
_register("rg6_fit_lltm_intervals", lambda v: regress.fit_lltm(v.proportions[0], v.items, ["category", "truth", "grp"], spec="M3"))
_register(
    "rg7_nested_r2",
    lambda v: regress.nested_r2(v.proportions[0], v.items).where("spec <> 'M3'").select("spec", _r("r2").alias("r2"), "n_terms"),
    """, d AS (SELECT b, grp, category, truth FROM item_fit JOIN items USING (item_id)), t AS (SELECT var_pop(b) * count(*) AS t FROM d)
    SELECT 'M0' AS spec, 0.0::DOUBLE AS r2, 0 AS n_terms UNION ALL
    SELECT 'M1', round(1 - (SELECT sum((b - m) * (b - m)) FROM (SELECT b, avg(b) OVER (PARTITION BY category) AS m FROM d)) / t, 6) + 0, (SELECT count(DISTINCT category) FROM d)::INT FROM t UNION ALL
    SELECT 'M2', round(1 - (SELECT sum(resid * resid) FROM resid) / t, 6) + 0, (SELECT count(DISTINCT category) + 1 FROM d)::INT FROM t UNION ALL
    SELECT 'M_raw', round(1 - (SELECT sum((b - m) * (b - m)) FROM (SELECT b, avg(b) OVER (PARTITION BY grp) AS m FROM d)) / t, 6) + 0, (SELECT count(DISTINCT grp) FROM d)::INT FROM t""",
)
_register(
    "rg7_nested_r2_full",
    lambda v: regress.nested_r2(v.proportions[0], v.items).select("spec", _r("r2").alias("r2"), _r("delta_r2").alias("delta_r2"), "n_terms"),
    """, d AS (SELECT b, grp, category, truth FROM item_fit JOIN items USING (item_id)), tot AS (SELECT var_pop(b) * count(*) AS ss, count(DISTINCT category)::INT AS c, count(DISTINCT grp)::INT AS g FROM d),
      m AS (SELECT truth::INT - avg(truth::INT) OVER c AS t, (grp = 'III-IV')::INT - avg((grp = 'III-IV')::INT) OVER c AS g1, (grp = 'V-VI')::INT - avg((grp = 'V-VI')::INT) OVER c AS g2, b - avg(b) OVER c AS y
            FROM d WINDOW c AS (PARTITION BY category)),
      o AS (SELECT t, g1 - t * (SELECT sum(t * g1) / sum(t * t) FROM m) AS h1, g2 - t * (SELECT sum(t * g2) / sum(t * t) FROM m) AS g2, y FROM m),
      h AS (SELECT t, h1, g2 - h1 * (SELECT sum(h1 * g2) / sum(h1 * h1) FROM o) AS h2, y FROM o),
      part AS (SELECT sum(y * y) AS yy, sum(t * y) ** 2 / sum(t * t) AS pt, sum(h1 * y) ** 2 / sum(h1 * h1) + sum(h2 * y) ** 2 / sum(h2 * h2) AS pg FROM h),
      raw AS (SELECT sum((b - m) * (b - m)) AS yy FROM (SELECT b, avg(b) OVER (PARTITION BY grp) AS m FROM d)),
      r AS (SELECT 0 AS place, 'M0' AS spec, 0.0::DOUBLE AS r2, 0 AS n_terms UNION ALL SELECT 1, 'M1', 1 - yy / ss, c FROM part, tot UNION ALL SELECT 2, 'M2', 1 - (yy - pt) / ss, c + 1 FROM part, tot
            UNION ALL SELECT 3, 'M3', 1 - (yy - pt - pg) / ss, c + g FROM part, tot UNION ALL SELECT 4, 'M_raw', 1 - raw.yy / ss, g FROM raw, tot)
    SELECT spec, round(r2, 6) + 0 AS r2, round(r2 - lag(r2) OVER (ORDER BY place), 6) + 0 AS delta_r2, n_terms FROM r""",
)
_register("rg8_logistic_by_model", lambda v: regress.logistic_by_model(v.answers))
_register(
    "rg8_logistic_by_group",
    lambda v: regress.logistic_by_model(v.answers, replicates=0, factors=("grp",)).select("model_id", "term", _r("beta", 4).alias("beta"), "n", _r("accuracy").alias("accuracy"), "converged"),
    """, c AS (SELECT model_id, grp, sum(y)::DOUBLE AS r, count(y) AS n FROM answers WHERE y IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, ln(r / (n - r)) AS l FROM c)
    SELECT model_id, CASE WHEN grp = 'I-II' THEN '(intercept)' ELSE 'grp_' || grp END AS term, round(CASE WHEN grp = 'I-II' THEN l ELSE l - max(l) FILTER (WHERE grp = 'I-II') OVER w END, 4) + 0 AS beta,
      (sum(n) OVER w)::BIGINT AS n, round(sum(r) OVER w / sum(n) OVER w, 6) + 0 AS accuracy, true AS converged FROM l WINDOW w AS (PARTITION BY model_id)""",
)
_register("rg9_pooled_logistic", lambda v: regress.pooled_logistic(v.answers))
_register(
    "rg9_pooled_by_group",
    lambda v: regress.pooled_logistic(v.answers, controls=()).select(*[_r(c, 4).alias(c) for c in ("beta", "ci_low", "ci_high")], "n_obs", "n_items", "n_models", "n_success"),
    f""", two AS (SELECT * FROM answers WHERE y IS NOT NULL AND grp IN ('I-II', 'V-VI')), m AS (SELECT item_id, grp, count(*) AS n, sum(y) AS r FROM two GROUP BY 1, 2),
      w AS (SELECT replicate, item_id, {_POISSON} AS w FROM {_draws_sql(0xDDB, 2000, 'm')} UNION ALL SELECT -1, item_id, 1 FROM m),
      s AS (SELECT replicate, grp, sum(w * r)::DOUBLE AS r, sum(w * n)::DOUBLE AS n FROM w JOIN m USING (item_id) GROUP BY 1, 2),
      b AS (SELECT replicate, max(ln(r / (n - r))) FILTER (WHERE grp = 'V-VI') - max(ln(r / (n - r))) FILTER (WHERE grp = 'I-II') AS beta FROM s GROUP BY 1)
    SELECT round(max(beta) FILTER (WHERE replicate < 0), 4) + 0 AS beta, round(quantile_cont(beta, 0.025) FILTER (WHERE replicate >= 0), 4) + 0 AS ci_low,
      round(quantile_cont(beta, 0.975) FILTER (WHERE replicate >= 0), 4) + 0 AS ci_high, (SELECT count(*) FROM two) AS n_obs, (SELECT count(DISTINCT item_id) FROM two) AS n_items,
      (SELECT count(DISTINCT model_id) FROM two) AS n_models, count(beta) FILTER (WHERE replicate >= 0) AS n_success FROM b""",
)


def _rg10(v: Views, **options) -> DataFrame:
    return regress.matched_gap_bootstrap(v.answers, **options).withColumn("gap", _r("gap"))


def _gap_sql(replicates: int) -> str:
    return f""", two AS (SELECT * FROM answers WHERE y IS NOT NULL AND grp IN ('I-II', 'V-VI')),
      m AS (SELECT item_id, grp, count(*) AS n, sum(y) AS r FROM two WHERE category IN (SELECT category FROM two GROUP BY 1 HAVING count(DISTINCT grp) = 2) GROUP BY 1, 2),
      u AS (SELECT * FROM {_draws_sql(0xDDB, replicates, 'm')} WHERE u < 1 - pow(1 - 1.0 / (SELECT count(*) FROM m), (SELECT count(*) FROM m)))
    SELECT replicate::INT AS replicate, round(sum(r) FILTER (WHERE grp = 'V-VI') / sum(n) FILTER (WHERE grp = 'V-VI') - sum(r) FILTER (WHERE grp = 'I-II') / sum(n) FILTER (WHERE grp = 'I-II'), 6) + 0 AS gap
    FROM m JOIN u USING (item_id) GROUP BY 1"""


_register("rg10_matched_gap_bootstrap", _rg10, _gap_sql(2000))
_reduced("rg10_matched_gap_bootstrap", partial(_rg10, replicates=20), _gap_sql(20))


def _rg11(v: Views, **options) -> DataFrame:
    return regress.refusal_logit(v.cells, v.items, v.registry, **options).select("term", *[_r(c).alias(c) for c in ("beta", "ci_low", "ci_high")])


def _refusal_sql(replicates: int) -> str:
    return f""", panel AS (SELECT row_number() OVER (ORDER BY id) - 1 AS seat, id AS model_id FROM registry),
      counts AS (SELECT seat, grp, count(*) AS n, count(*) FILTER (WHERE refused) AS r FROM panel CROSS JOIN items LEFT JOIN cells ON cells.model_id = panel.model_id AND cells.item_id = items.item_id GROUP BY 1, 2),
      draws AS (SELECT replicate, least(floor(u * 9), 8)::BIGINT AS seat FROM {_draws_sql(0xDD6, replicates, '(SELECT seat AS item_id FROM panel)')} UNION ALL SELECT -1, seat FROM panel),
      l AS (SELECT replicate, grp, CASE WHEN sum(r) > 0 AND sum(r) < sum(n) THEN ln(sum(r) / (sum(n) - sum(r))) END AS l FROM draws JOIN counts USING (seat) GROUP BY 1, 2),
      t AS (SELECT l.replicate, CASE WHEN grp = 'I-II' THEN '(intercept)' ELSE 'grp_' || grp END AS term, CASE WHEN grp = 'I-II' THEN l.l ELSE l.l - b.l END AS beta
            FROM l JOIN (SELECT replicate, l FROM l WHERE grp = 'I-II') b ON b.replicate = l.replicate)
    SELECT term, round(max(beta) FILTER (WHERE replicate < 0), 6) + 0 AS beta, round(quantile_cont(beta, 0.025) FILTER (WHERE replicate >= 0), 6) + 0 AS ci_low,
      round(quantile_cont(beta, 0.975) FILTER (WHERE replicate >= 0), 6) + 0 AS ci_high FROM t GROUP BY 1"""


_register("rg11_refusal_logit", _rg11, _refusal_sql(2000))
_reduced("rg11_refusal_logit", partial(_rg11, replicates=50), _refusal_sql(50))
_register("rg12_crossfit_probe", lambda v: regress.crossfit_probe(v.embeddings, v.items))


def _rg12_given(v: Views) -> DataFrame:
    """Out-of-fold accuracy of probes with given weights, one for each fold."""
    frame = regress.folds(v.items.join(v.embeddings, "item_id").select("item_id", "truth", "embedding"), 5, 0)
    weights = (np.arange(_DIMS)[:, None] * 5 + np.arange(5)) * 7919 % 1009 / 1009 - 0.5
    judged = regress.probe_predictions(frame, weights, np.arange(5) / 10 - 0.2)
    return judged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("n_right"))


_register("rg12_probe_given_weights", _rg12_given, f"""
    , j AS (SELECT item_id, truth, embedding FROM items JOIN embeddings ON vec_id = item_id),
      f AS (SELECT *, (row_number() OVER (PARTITION BY truth ORDER BY {_DRAW.format(seed=0, key='item_id')}, item_id) - 1) % 5 AS fold FROM j),
      z AS (SELECT fold::INT AS fold, truth, list_sum(list_transform(range({_DIMS}), lambda d: embedding[d + 1]::DOUBLE * ((d * 5 + fold) * 7919 % 1009 / 1009.0::DOUBLE - 0.5))) + fold / 10.0::DOUBLE - 0.2 AS z FROM f)
    SELECT fold, count(*) AS n, count(*) FILTER (WHERE (z > 0) = truth) AS n_right FROM z GROUP BY fold""")
_register(
    "rg12_folds",
    lambda v: regress.folds(v.items.select("item_id", "truth"), 5, 4),
    f"SELECT item_id, truth, ((row_number() OVER (PARTITION BY truth ORDER BY {_DRAW.format(seed=4, key='item_id')}, item_id) - 1) % 5)::INT AS fold FROM items",
)

# -- statistics ------------------------------------------------------------------------------------------

def _erfc_sql(x: str) -> str:
    """1 - erf by its series of positive terms, for x >= 0."""
    term = f"exp(2 * k * ln(2) + (2 * k + 1) * ln(greatest({x}, 1e-300)) + lgamma(k + 1) - lgamma(2 * k + 2))"
    return f"CASE WHEN {x} > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(150), lambda k: {term})) END"


def _area_sql(low: str) -> str:
    """The integral of the density of a correlation of independent values over n rows, but for its constant, from `low` to 1."""
    return f"(SELECT sum(pow(1 - u * u, (n - 4) / 2.0)) * (1 - {low}) / 20000 FROM (SELECT {low} + (1 - {low}) * (k + 0.5) / 20000 AS u FROM range(20000) AS g(k)))"


_register(
    "st1_spearman",
    lambda v: stats.spearman(v.residuals.withColumn("x", F.round("b", 9)).withColumn("y", F.round("resid", 9)), "x", "y").select("n", _r("rho").alias("rho"), _r("p", 5).alias("p")),
    f""", j AS (SELECT round(b, 9) AS x, round(resid, 9) AS y FROM resid), c AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM {_RANKED.format(x='x', y='y', t='j')})
    SELECT n, round(rho, 6) + 0 AS rho, round({_area_sql('abs(rho)')} / {_area_sql('0.0')}, 5) + 0 AS p FROM c""",
)


def _featured(v: Views) -> DataFrame:
    return v.proportions[0].join(vectors.array_features(v.embeddings), "item_id").select(F.round("b", 9).alias("b"), *[F.round(c, 9).alias(c) for c in ("mean", "sd", "mean_0")])


_FEATURES = """, e AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS e FROM embeddings),
  f AS (SELECT item_id, len(e)::INT AS length, list_avg(e) AS mean, list_stddev_pop(e) AS sd, list_avg([x for x, i in e if (i - 1) % 3 = 0]) AS mean_0,
          list_avg([x for x, i in e if (i - 1) % 3 = 1]) AS mean_1, list_avg([x for x, i in e if (i - 1) % 3 = 2]) AS mean_2 FROM e)"""
_register(
    "st2_correlate_features",
    lambda v: stats.correlate_features(_featured(v), "b", ["mean", "sd", "mean_0"]).select("feature", "n", _r("rho").alias("rho")),
    _FEATURES
    + ", j AS (SELECT round(b, 9) AS b, round(mean, 9) AS mean, round(sd, 9) AS sd, round(mean_0, 9) AS mean_0 FROM item_fit JOIN f USING (item_id)) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(corr(rx, ry), 6) + 0 AS rho FROM {_RANKED.format(x='b', y=c, t='j')}" for c in ("mean", "sd", "mean_0")),
)
_register(
    "st3_lord_chi2",
    lambda v: stats.lord_chi2(
        v.proportions[1], v.proportions[0], v.answers.where("y IS NOT NULL").groupBy("item_id").agg((-F.log((F.sum("y") + 0.5) / (F.count("y") - F.sum("y") + 0.5))).alias("b"))
    ).select("item_id", _r("chi2", 5).alias("chi2"), _r("p", 5).alias("p")),
    f""", o AS (SELECT item_id, -ln((sum(y) + 0.5) / (count(y) - sum(y) + 0.5)) AS br FROM answers WHERE y IS NOT NULL GROUP BY 1),
      i AS (SELECT item_id, b, br, sum(1 / (1 + exp(b - theta)) * (1 - 1 / (1 + exp(b - theta)))) AS f, sum(1 / (1 + exp(br - theta)) * (1 - 1 / (1 + exp(br - theta)))) AS r
            FROM item_fit JOIN o USING (item_id), model_fit GROUP BY 1, 2, 3)
    SELECT item_id, round(chi2, 5) + 0 AS chi2, round({_erfc_sql('sqrt(chi2 / 2)')}, 5) + 0 AS p FROM (SELECT item_id, (b - br) * (b - br) / (1 / greatest(f, 1e-6) + 1 / greatest(r, 1e-6)) AS chi2 FROM i)""",
)
_register(
    "st4_mantel_haenszel",
    lambda v: stats.mantel_haenszel(v.answers, "category").select("category", *[_r(c, 5).alias(c) for c in ("delta", "chi2", "p")]),
    f""", t AS (SELECT category, coalesce(sum(y) FILTER (WHERE grp = 'V-VI'), 0)::DOUBLE AS a, coalesce(sum(1 - y) FILTER (WHERE grp = 'V-VI'), 0)::DOUBLE AS b,
        coalesce(sum(y) FILTER (WHERE grp = 'I-II'), 0)::DOUBLE AS c, coalesce(sum(1 - y) FILTER (WHERE grp = 'I-II'), 0)::DOUBLE AS d FROM answers WHERE y IS NOT NULL GROUP BY 1),
      s AS (SELECT *, a + b + c + d AS n FROM t)
    SELECT category, CASE WHEN a * d > 0 AND b * c > 0 THEN round(-2.35 * ln(a * d / (b * c)), 5) + 0 END AS delta, round(chi2, 5) + 0 AS chi2, round({_erfc_sql('sqrt(chi2 / 2)')}, 5) + 0 AS p
    FROM (SELECT *, CASE WHEN a * d > 0 AND b * c > 0 THEN pow(a - (a + b) * (a + c) / n, 2) / greatest((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)), 1e-9) END AS chi2 FROM s)""",
)
_register(
    "st5_ability_bins",
    lambda v: stats.ability_bins(v.proportions[1]).select("model_id", _r("theta").alias("theta"), "bin"),
    """, q AS (SELECT unnest(quantile_cont(theta, [0.2, 0.4, 0.6, 0.8])) AS e FROM model_fit)
    SELECT model_id, round(theta, 6) + 0 AS theta, (SELECT count(*) FROM q WHERE theta >= e)::INT AS bin FROM model_fit""",
)

_register(
    "st5_bin_counts",
    lambda v: stats.bin_counts(stats.ability_bins(v.proportions[1]), v.answers),
    """, q AS (SELECT unnest(quantile_cont(theta, [0.2, 0.4, 0.6, 0.8])) AS e FROM model_fit), b AS (SELECT model_id, (SELECT count(*) FROM q WHERE theta >= e)::INT AS bin FROM model_fit)
    SELECT bin, count(DISTINCT b.model_id) AS n_models, count(y) AS n_answers, coalesce(sum(y), 0)::BIGINT AS n_right FROM b LEFT JOIN answers USING (model_id) GROUP BY bin""",
)


def _st6(v: Views) -> DataFrame:
    item_fit, model_fit = v.proportions
    scored = irt.cell_probabilities(v.cells, model_fit, item_fit)
    return stats.permutation_test(scored.select("model_id", "item_id", (F.col("y") - F.col("p")).alias("resid"), F.col("model_id").isin("m5", "m6", "m7", "m8").alias("focal")))


_register(
    "st6_permutation_test",
    lambda v: _st6(v).withColumn("permutation_p", _r("permutation_p")),
    f""", ns AS (SELECT unnest(range(2, 10)) AS n), u AS MATERIALIZED (SELECT * FROM {_draws_sql(0xDD5, 10_000, '(SELECT unnest(range(9)) AS item_id)')}),
      ranked AS MATERIALIZED (SELECT n, replicate, item_id AS j, row_number() OVER (PARTITION BY n, replicate ORDER BY u, item_id) AS r FROM u JOIN ns ON item_id < n),
      masks AS MATERIALIZED (SELECT n, k, mask, count(*) AS c FROM (SELECT n, k, replicate, sum(1::BIGINT << j) FILTER (WHERE r <= k) AS mask FROM ranked JOIN (SELECT unnest(range(1, 9)) AS k) ON k < n GROUP BY ALL) GROUP BY ALL),
      s AS MATERIALIZED (SELECT item_id, y - 1 / (1 + exp(b - theta)) AS r, model_id IN ('m5', 'm6', 'm7', 'm8') AS f, row_number() OVER (PARTITION BY item_id ORDER BY model_id) - 1 AS j
            FROM cells JOIN item_fit USING (item_id) JOIN model_fit USING (model_id) WHERE y IS NOT NULL),
      t AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE f) AS k, sum(r) AS total, abs(avg(r) FILTER (WHERE f) - avg(r) FILTER (WHERE NOT f)) AS seen FROM s GROUP BY 1),
      o AS (SELECT item_id, mask, any_value(c) AS c, sum(r) FILTER (WHERE (mask >> j) & 1 = 1) AS own FROM t JOIN masks USING (n, k) JOIN s USING (item_id) GROUP BY item_id, mask)
    SELECT item_id, round(CASE WHEN any_value(k) BETWEEN 1 AND any_value(n) - 1 THEN (coalesce(sum(c) FILTER (WHERE abs(own / k - (total - own) / (n - k)) >= seen - 1e-12), 0) + 1) / 10001.0::DOUBLE END, 6) + 0 AS permutation_p
    FROM t LEFT JOIN o USING (item_id) GROUP BY item_id""",
)


def _p_values(v: Views) -> DataFrame:
    """Values that serve as p: a hash of each item, squared, with some missing."""
    u = F.expr("CAST(conv(substr(md5(CAST(item_id AS STRING)), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D")
    return v.items.select("item_id", F.when(F.col("item_id") % 11 != 0, F.pow(u, 4)).alias("p"))


_BH = ", p AS (SELECT item_id, CASE WHEN item_id % 11 <> 0 THEN pow(('0x' || substr(md5(item_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 4) END AS p FROM items)"
_register(
    "st7_benjamini_hochberg",
    lambda v: stats.benjamini_hochberg(_p_values(v)).select("item_id", "significant"),
    _BH + """, r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM p WHERE p IS NOT NULL),
      c AS (SELECT max(p) AS cut FROM r WHERE p <= 0.05 * r / n) SELECT item_id, coalesce(p <= cut, false) AS significant FROM p, c""",
)
_register(
    "st8_residual_screen",
    lambda v: stats.residual_screen(v.residuals.select("item_id", "resid")).select("item_id", _r("z", 5).alias("z"), _r("p", 5).alias("p"), "significant"),
    f""", z AS (SELECT item_id, (resid - avg(resid) OVER ()) / stddev_pop(resid) OVER () AS z FROM resid), t AS (SELECT item_id, z, {_erfc_sql('abs(z) / sqrt(2)')} AS p FROM z),
      r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS n FROM t), c AS (SELECT max(p) AS cut FROM r WHERE p <= 0.05 * r / n)
    SELECT item_id, round(z, 5) + 0 AS z, round(p, 5) + 0 AS p, coalesce(p <= cut, false) AS significant FROM t, c""",
)
_EXTREME = "SELECT item_id, '{scope}' AS scope, side, rank::INT AS rank FROM (SELECT item_id, row_number() OVER ({by}ORDER BY r DESC, item_id) AS rank, 'hardest' AS side FROM x UNION ALL SELECT item_id, row_number() OVER ({by}ORDER BY r, item_id), 'easiest' FROM x) WHERE rank <= 10"


def _st9(v: Views) -> DataFrame:
    rounded = v.residuals.select("item_id", "grp", F.round("resid", 9).alias("resid"))
    every = stats.extreme_items(rounded, 10).withColumn("scope", F.lit("all"))
    return every.unionByName(stats.extreme_items(rounded, 10, "grp").withColumn("scope", F.lit("group"))).select("item_id", "scope", "side", "rank")


_register(
    "st9_extreme_items",
    _st9,
    ", x AS (SELECT item_id, grp, round(resid, 9) AS r FROM resid) "
    + _EXTREME.format(scope="all", by="")
    + " UNION ALL "
    + _EXTREME.format(scope="group", by="PARTITION BY grp "),
)
_register(
    "st10_mode_level",
    lambda v: reports.mode_level(v.answers, "category"),
    "SELECT category, count(*) AS n FROM answers GROUP BY 1 ORDER BY n DESC, category LIMIT 1",
)

# -- vectors and sets ---------------------------------------------------------------------------------------

_register(
    "ve1_l2_normalize",
    lambda v: vectors.l2_normalize(v.embeddings.withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("item_id") % 5)))).select(
        "item_id", _r(F.element_at("embedding", 1)).alias("x1"), _r(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm2")
    ),
    """, e AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: (x * (vec_id % 5)::FLOAT)::DOUBLE) AS e FROM embeddings), n AS (SELECT *, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8) AS n FROM e)
    SELECT item_id, round(e[1] / n, 6) + 0 AS x1, round(list_sum(list_transform(e, lambda x: x / n * (x / n))), 6) + 0 AS norm2 FROM n""",
)


def _ve2(v: Views) -> DataFrame:
    labels = fixtures.table(v.spark, v.folder, "embeddings").where("label IN (0, 1)").select("label", "embedding")
    means = {r["label"]: r["centroid"] for r in vectors.mean_vectors(labels, "label").collect()}
    found = vectors.zero_shot(v.embeddings, {"benign": means[0], "malignant": means[1]}, scale=10.0)
    parsed = responses.parse_answers(found.withColumnRenamed("label", "given").withColumnRenamed("confidence", "sure"))
    return parsed.select("item_id", "label", "confidence", _r("p", 5).alias("p"))


_register(
    "ve2_zero_shot",
    _ve2,
    """, x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT label, i, avg(x) AS m FROM x WHERE label IN (0, 1) GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1),
      d AS (SELECT vec_id AS item_id, m.label, 10 * sum(x * m / l.n) / greatest(sqrt(sum(x * x)), 1e-8) AS s FROM x JOIN m USING (i) JOIN l ON l.label = m.label GROUP BY 1, 2),
      p AS (SELECT item_id, 1 / (1 + exp(max(s) FILTER (WHERE label = 1) - max(s) FILTER (WHERE label = 0))) AS p1 FROM d GROUP BY 1)
    SELECT item_id, CASE WHEN p1 >= 0.5 THEN 'benign' ELSE 'malignant' END AS label, CASE WHEN greatest(p1, 1 - p1) >= 0.8 THEN 'high' WHEN greatest(p1, 1 - p1) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence,
      round(greatest(p1, 1 - p1), 5) + 0 AS p FROM p""",
)
_register(
    "ve3_centroid_distance",
    lambda v: vectors.centroid_distance(v.embeddings, v.items, "I-II").withColumn("distance", _r("distance", 5)),
    """, x AS (SELECT vec_id AS item_id, grp, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN items ON item_id = vec_id), m AS (SELECT i, avg(x) AS m FROM x WHERE grp = 'I-II' GROUP BY 1)
    SELECT item_id, grp, round(sqrt(sum((x - m) * (x - m))), 5) + 0 AS distance FROM x JOIN m USING (i) GROUP BY 1, 2""",
)
_register(
    "ve4_array_features",
    lambda v: vectors.array_features(v.embeddings).select("item_id", "length", *[_r(c).alias(c) for c in ("mean", "sd", "mean_0", "mean_1", "mean_2")]),
    _FEATURES + "SELECT item_id, length, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("mean", "sd", "mean_0", "mean_1", "mean_2")) + " FROM f",
)
_register(
    "set1_shared_levels",
    lambda v: reports.shared_levels(v.items, "category", "I-II", "V-VI"),
    "SELECT category FROM items WHERE grp = 'I-II' INTERSECT SELECT category FROM items WHERE grp = 'V-VI'",
)
_register(
    "set2_exclusive_levels",
    lambda v: reports.exclusive_levels(v.items, "category", "I-II", "V-VI"),
    """SELECT category, min(grp) AS grp FROM items WHERE grp IN ('I-II', 'V-VI') GROUP BY 1 HAVING count(DISTINCT grp) = 1""",
)
_register(
    "set3_panel_union",
    lambda v: responses.panel_union(v.log.where("model_id = 'm0'").drop("error"), v.log.where("model_id <> 'm0'")).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_error")),
    "SELECT model_id, count(*) AS n, count(error) FILTER (WHERE model_id <> 'm0') AS n_error FROM log GROUP BY 1",
)
