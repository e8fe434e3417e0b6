"""Replies and vectors kept by what was asked, so that nothing is asked twice."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import hooks
from gridloom.session import written

# Prompts of one task: what a lost task asks again at most.
CALLS_A_TASK = 96
_REPLIES = "key string, reply string, error string, run string"
_VECTORS = "key string, dense array<float>"


@dataclass(frozen=True)
class CallStore:
    """What a named model replied, in files below ``root``.

    A call is known by the hash of model, system text and prompt. Of equal prompts in a batch
    one is sent. The files of a task are in place as soon as it ends, before its job does, and
    hold no more than ``calls_a_task`` calls: after a lost executor, a failed job or a replayed
    batch only calls that had not come back are made. Failed calls are not kept.
    """

    root: str
    model: str
    calls_a_task: int = CALLS_A_TASK

    def _key(self, text: Column, system: str = "") -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\0{system}\0"), text), 256)

    def _read(self, spark: SparkSession, kind: str, schema: str) -> DataFrame:
        path = f"{self.root}/{kind}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def _missing(self, asked: DataFrame, known: DataFrame) -> DataFrame:
        """One row per call that is not known, in tasks of so many calls."""
        once = asked.filter(F.col("text").isNotNull()).groupBy("key").agg(F.first("text").alias("text"))
        # Written, so that what is asked does not change when a task of it is repeated.
        missing = written(once.join(known.select("key"), "key", "left_anti"), "calls")
        return missing.repartition(max(1, math.ceil(missing.count() / self.calls_a_task)), "key")

    def _keep(self, replies: DataFrame, kind: str) -> None:
        # The second algorithm puts a task's files in place when the task ends. A file found twice
        # (a task that ended unnoticed) holds equal keys, of which one is read.
        replies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.root}/{kind}")

    def completions(
        self,
        df: DataFrame,
        prompt: str,
        out: str,
        complete: hooks.Complete | None,
        system: str = "",
        tolerate_errors: bool = False,
        error: str | None = None,
    ) -> DataFrame:
        """As ``hooks.completions``; calls that fail are made again by the next run."""
        if complete is None:
            return hooks.completions(df, prompt, out, complete, system, tolerate_errors, error)
        spark = df.sparkSession
        rows = written(df.withColumn("_key", self._key(F.col(prompt), system)), "asked")
        good = self._read(spark, "replies", _REPLIES).filter("error is null")
        missing = self._missing(rows.select(F.col("_key").alias("key"), F.col(prompt).alias("text")), good)
        run = missing.sparkSession._jvm.java.util.UUID.randomUUID().toString()
        told = hooks.completions(missing, "text", "reply", complete, system, error="error")
        self._keep(told.select("key", "reply", "error", F.lit(run).alias("run")), "replies")
        # Of a key the reply, or else what this run failed with.
        stored = self._read(spark, "replies", _REPLIES).filter(F.col("error").isNull() | (F.col("run") == run))
        stored = stored.groupBy(F.col("key").alias("_key")).agg(F.max("reply").alias("_reply"), F.max("error").alias("_error"))
        failed = F.col("_reply").isNull() & F.col("_error").isNotNull()
        reply = F.col("_reply")
        if error is None:
            stop = F.lit("") if tolerate_errors else F.raise_error(F.col("_error")).cast("string")
            reply = F.when(failed, stop).otherwise(reply)
        joined = rows.join(stored, "_key", "left").withColumn(out, reply)
        if error is not None:
            joined = joined.withColumn(error, F.when(failed, F.col("_error")))
        return joined.drop("_key", "_reply", "_error")

    def embeddings(self, df: DataFrame, text: str, out: str, embed: hooks.Embed) -> DataFrame:
        """Add ``out``: the vectors of a text column, asked for in groups as ``hooks.embeddings`` does."""
        spark = df.sparkSession
        value = F.coalesce(F.col(text), F.lit(""))
        rows = written(df.withColumn("_key", self._key(value)), "asked")
        missing = self._missing(rows.select(F.col("_key").alias("key"), value.alias("text")), self._read(spark, "vectors", _VECTORS))
        self._keep(missing.select("key", hooks.embeddings("text", embed).alias("dense")), "vectors")
        stored = self._read(spark, "vectors", _VECTORS).groupBy(F.col("key").alias("_key")).agg(F.first("dense").alias(out))
        return rows.join(stored, "_key", "left").drop("_key")


def completions(calls: CallStore | None, df: DataFrame, prompt: str, out: str, complete: hooks.Complete | None, system: str = "", tolerate_errors: bool = False, error: str | None = None) -> DataFrame:
    """Through the store where there is one, else directly."""
    return (calls.completions if calls else hooks.completions)(df, prompt, out, complete, system, tolerate_errors, error)


def embeddings(calls: CallStore | None, df: DataFrame, text: str, out: str, embed: hooks.Embed) -> DataFrame:
    return calls.embeddings(df, text, out, embed) if calls else df.withColumn(out, hooks.embeddings(text, embed))
