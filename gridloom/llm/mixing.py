"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import written

# A mean above PART is drawn as a sum of independent Poisson numbers with means up to PART;
# TERMS steps of the distribution reach past the largest uniform number, 1 - 2**-52.
PART, TERMS = 8.0, 64


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) from the first 52 bits of md5 of the colon-joined key."""
    text = F.concat_ws(":", *[k if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str, float] | None, epochs: float) -> DataFrame:
    """Per source: the mean number of copies that brings its share of code points to its weight."""
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("_size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = [(F.col("_source") == s, float(w)) for s, w in weights.items()]
        weight = F.lit(0.0)
        for test, w in given:
            weight = F.when(test, F.lit(w)).otherwise(weight)
    sizes = written(sizes.withColumn("_weight", F.when(F.col("_size") > 0, weight).otherwise(0.0)), "source-sizes")
    size, all_weights = sizes.agg(F.sum("_size"), F.sum("_weight")).first()
    mean = F.when(F.col("_weight") > 0, F.col("_weight") / F.lit(all_weights) * F.lit(size) * F.lit(float(epochs)) / F.col("_size")).otherwise(0.0)
    return sizes.select("_source", mean.alias("_mean"))


def _thresholds(mean: Column) -> Column:
    """The distribution function of a Poisson number with this mean at 0, 1, 2, ..."""
    start = F.exp(-mean)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(start.alias("p"), F.array(start).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k.cast("double")).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k.cast("double"))).alias("cdf")
        ),
        lambda acc: acc["cdf"],
    )


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = "mix", tags: bool = False) -> DataFrame:
    """Each document as often as its Poisson number says, all copies shuffled globally.

    A source's mean number of copies is ``weight * all code points * epochs / its code
    points``; without ``weights`` all sources weigh the same. The number of a document is
    the Poisson quantile of a uniform number hashed from the seed and its id (its text where
    the id is null), so a repeated run draws the same; repeated rows draw alike. A null
    source is a source of its own; sources without a weight or without text are not drawn.
    Returns the columns of ``docs`` (with ``tags`` also ``copy`` from 1 and ``order_key``,
    replacing columns of these names), dealt out by a hash and sorted by it in each part.

    Only the sums per source are aggregated; the table of rates is written, so that it is
    broadcast where its measured size allows and joined by a split shuffle where not.
    """
    plan = written(rates(docs, weights, epochs).select("_source", "_mean").withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_mean") / PART)).cast("int")), "rates")
    plan = plan.withColumn("_cdf", _thresholds(F.col("_mean") / F.col("_parts")))
    packed = docs.select(F.struct("*").alias("_doc"))
    key = F.coalesce(F.col("_doc.doc_id").cast("string"), F.md5(F.coalesce(F.col("_doc.text"), F.lit("")).cast("binary")))
    drawn = packed.join(plan, F.col("_doc.source").eqNullSafe(F.col("_source")))
    quantile = lambda i: F.aggregate("_cdf", F.lit(0), lambda n, c: n + F.when(c < uniform(seed, key, i), 1).otherwise(0))
    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_parts")), quantile), F.lit(0), lambda a, b: a + b)
    drawn = drawn.select("_doc", key.alias("_key"), copies.alias("_copies")).where("_copies > 0")
    out = drawn.select("_doc", "_key", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    out = out.select("_doc", "_copy", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "_key", "_copy").cast("binary")).alias("_order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(parts, "_order").sortWithinPartitions("_order")
    named = [F.col("_doc")[c].alias(c) for c in docs.columns if not tags or c not in ("copy", "order_key")]
    return out.select(*named, *([F.col("_copy").alias("copy"), F.col("_order").alias("order_key")] if tags else []))
