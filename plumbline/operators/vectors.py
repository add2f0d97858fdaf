"""Arithmetic on embedding vectors with higher-order functions: no explode, no Python."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(embeddings: DataFrame) -> DataFrame:
    """Unit vectors; a norm is taken to be at least 1e-8."""
    e = F.col("embedding")
    norm = F.greatest(F.sqrt(_dot(e, e)), F.lit(1e-8))
    return embeddings.withColumn("_n", norm).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def zero_shot(embeddings: DataFrame, label_vectors: Mapping[str, Sequence[float]], scale: float = 100.0, high: float = 0.80, medium: float = 0.60) -> DataFrame:
    """The candidate label with the largest scaled cosine, its softmax probability, and the answer as a text that the parser reads.

    label_vectors: two labels and their vectors, which go into the plan as literals. The first wins a tie.
    """
    (first, u), (second, v) = label_vectors.items()
    unit = l2_normalize(embeddings)

    def cosine(w: Sequence[float]) -> Column:
        norm = max(sum(x * x for x in w) ** 0.5, 1e-8)
        return _dot(F.col("embedding"), F.lit([float(x) / norm for x in w]))

    sims = unit.select("item_id", (cosine(u) * scale).alias("s1"), (cosine(v) * scale).alias("s2"))
    p1 = 1 / (1 + F.exp(F.col("s2") - F.col("s1")))
    picked = sims.withColumn("p1", p1).withColumn("label", F.when(F.col("p1") >= 0.5, first).otherwise(second)).withColumn("p", F.greatest("p1", 1 - F.col("p1")))
    sure = F.when(F.col("p") >= high, "high").when(F.col("p") >= medium, "medium").otherwise("low")
    other = F.when(F.col("label") == first, second).otherwise(first)
    text = F.format_string("Answer: %s\nConfidence: %s\nReasoning: nearest candidate label; P(%s)=%.3f, P(%s)=%.3f", "label", sure, "label", "p", other, 1 - F.col("p"))
    return picked.select("item_id", "label", "p", sure.alias("confidence"), text.alias("raw_text"))


def mean_vectors(embeddings: DataFrame, by: str) -> DataFrame:
    """The mean vector of each level of `by`, summed in the tasks without exploding the vectors."""
    mean = Summarizer.mean(array_to_vector("embedding"))
    return embeddings.groupBy(by).agg(vector_to_array(mean).alias("centroid"))


def centroid_distance(embeddings: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """Euclidean distance of every item to the mean vector of a group's items. One vector is broadcast."""
    joined = embeddings.join(items.select("item_id", "grp"), "item_id")
    centre = mean_vectors(joined.where(F.col("grp") == group), "grp").select("centroid")
    square = lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)
    distance = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", square), F.lit(0.0), lambda s, x: s + x))
    return joined.join(F.broadcast(centre)).select("item_id", "grp", distance.alias("distance"))


def array_features(vectors: DataFrame, channels: int = 3) -> DataFrame:
    """Length, mean and population spread of each vector, and the mean of each of its interleaved channels."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    frame = vectors.withColumn("_e", e).withColumn("length", F.size("_e")).withColumn("mean", total(F.col("_e")) / F.col("length"))
    spread = F.sqrt(total(F.transform("_e", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / F.col("length"))

    def channel(c: int) -> Column:
        own = F.filter("_e", lambda x, i: i % channels == c)
        return (total(own) / F.size(own)).alias(f"mean_{c}")

    means = [channel(c) for c in range(channels)]
    return frame.select("item_id", "length", "mean", spread.alias("sd"), *means)
