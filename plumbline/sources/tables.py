"""Readers and writers of an audit's tables, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS_CSV = "DDI_file STRING, skin_tone INT, disease STRING, malignant BOOLEAN"
LOG = "model_id STRING, item_id STRING, raw_text STRING, elapsed_s DOUBLE, timestamp DOUBLE, error STRING"
EMBEDDINGS = "item_id STRING, embedding ARRAY<FLOAT>"
REGISTRY = "id STRING, family STRING, modality STRING, source STRING, deterministic_decoding BOOLEAN, version STRING, optional BOOLEAN, notes STRING"

#: Group codes and their labels (fixed values).
GROUP_LABELS = {12: "I-II", 34: "III-IV", 56: "V-VI"}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata from CSV with a header, renamed and typed. An unknown group code is an error when the rows are read."""
    code = F.col("grp_raw")
    label = None
    for value, name in GROUP_LABELS.items():
        label = F.when(code == value, name) if label is None else label.when(code == value, name)
    raw = spark.read.schema(ITEMS_CSV).option("header", True).csv(path)
    named = raw.withColumnsRenamed({"DDI_file": "item_id", "skin_tone": "grp_raw", "disease": "category", "malignant": "truth"})
    return named.withColumn("grp", label.otherwise(F.raise_error(F.concat(F.lit("unknown group code "), code.cast("string")))))


def read_log(spark: SparkSession, path: str | list[str], mode: str = "lenient", schema: str = LOG) -> DataFrame:
    """The answer log from JSON lines. `lenient` skips blank and malformed lines; `strict` fails on a malformed one."""
    if mode == "strict":
        names = [c.split()[0] for c in schema.split(",")]
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(*names)  # without the batches' partition
    if mode != "lenient":
        raise ValueError(mode)
    # parsed as an expression: a JSON scan can't answer queries that need its corrupt-record column alone, such as a count
    parsed = spark.read.text(path).select(F.from_json("value", schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def read_embeddings(spark: SparkSession, path: str, schema: str = EMBEDDINGS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def registry(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Respondents from a settings list; `optional` is false and `notes` empty where they are missing."""
    names = [c.split()[0] for c in REGISTRY.split(", ")]
    table = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REGISTRY)
    return table.withColumns({"optional": F.coalesce("optional", F.lit(False)), "notes": F.coalesce("notes", F.lit(""))})


def append_log(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds answers to a log of JSON lines. A batch has a partition of its own, written whole or not at all: one that is written again, after a
    failure or twice, replaces its own rows and no others."""
    if batch is None:
        df.write.mode("append").json(path)
    else:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def _names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern))
    return sorted(f.getPath().getName() for f in found or [])


class LogState:
    """The state of a log of batches, kept in a folder: an update reads only batches that the state doesn't stand for yet.

    Each update writes a new version, with the names of the batches that it stands for; one without Spark's success file is no version, so an
    update that fails is made again from the last whole one. The two newest versions are kept.
    """

    def __init__(self, spark: SparkSession, path: str, items: DataFrame, registry: DataFrame, schema: str = LOG, **options):
        self.spark, self.path, self.items, self.registry, self.schema, self.options = spark, path, items, registry, schema, options

    def _versions(self) -> list[int]:
        whole = [n for n in _names(self.spark, self.path, "v*") if _names(self.spark, f"{self.path}/{n}/batches", "_SUCCESS")]
        return sorted(int(n[1:]) for n in whole)

    def read(self) -> DataFrame:
        """The newest state."""
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1]}/pairs")

    def update(self, log_path: str) -> list[str]:
        """Takes in the log's new batches, and returns their names. A batch that was written again after it was taken in isn't read again."""
        from plumbline.operators.responses import log_state, merge_states

        versions = self._versions()
        last = f"{self.path}/v{versions[-1]}" if versions else None
        done = {r.batch for r in self.spark.read.parquet(f"{last}/batches").collect()} if last else set()
        new = [n for n in _names(self.spark, log_path, "batch=*") if n not in done]
        if not new:
            return []
        log = read_log(self.spark, [f"{log_path}/{n}" for n in new], schema=self.schema)
        state = log_state(log, self.items, self.registry, **self.options)
        if last:
            state = merge_states(self.spark.read.parquet(f"{last}/pairs"), state)
        following = f"{self.path}/v{versions[-1] + 1 if versions else 0}"
        state.write.mode("overwrite").parquet(f"{following}/pairs")
        self.spark.createDataFrame([(b,) for b in sorted(done | set(new))], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{following}/batches")
        for old in versions[:-1]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return new


def write_fit(item_fit: DataFrame, model_fit: DataFrame, path: str) -> None:
    """A calibration as two Parquet tables."""
    item_fit.write.mode("overwrite").parquet(f"{path}/item_fit")
    model_fit.write.mode("overwrite").parquet(f"{path}/model_fit")


def read_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/item_fit"), spark.read.parquet(f"{path}/model_fit")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON records or as CSV with a header."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(kind)
