"""Questions to answers, for a batch of questions at once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.operators import hooks, replies, retrieval
from gridloom.operators.prompts import chunk_prompts, result_prompts, sql_prompts
from gridloom.operators.routing import EXECUTED, Statements, answer_routes
from gridloom.operators.sqlguard import clean_sql, prompt_tables
from gridloom.operators.vectors import postings
from gridloom.plans.ingest import Store
from gridloom.session import written


def search(
    spark: SparkSession, store: Store, questions: DataFrame, embed: hooks.Embed, calls: replies.CallStore | None = None
) -> DataFrame:
    """Hybrid hits of ``questions(query_id, question, top_k)`` with payload.

    Each question gets ``top_k`` * 5 fused hits from branches of twice that length.
    """
    asked = written(replies.embeddings(calls, questions, "question", "dense", embed), "questions")
    longest = asked.agg(F.max("top_k")).first()[0]
    if longest is None:
        longest = fixed.DEFAULT_TOP_K
    fetch = int(longest) * fixed.FETCH_FACTOR * fixed.BRANCH_FACTOR
    index = store.index.read(spark)
    want = asked.select("query_id", "top_k")
    own = F.col("top_k") * fixed.FETCH_FACTOR * fixed.BRANCH_FACTOR
    branches = [
        hits.join(want, "query_id").filter(F.col("rank") <= own).drop("top_k")
        for hits in (
            retrieval.dense_topk(index, asked, fetch),
            retrieval.stored_sparse_topk(index, postings(asked, "query_id", "question"), fetch),
        )
    ]
    fused = retrieval.fuse_rrf(branches, int(longest) * fixed.FETCH_FACTOR)
    kept = fused.join(want, "query_id").filter(F.col("rank") <= F.col("top_k") * fixed.FETCH_FACTOR)
    return retrieval.attach_payload(kept, index.drop("dense", "sparse", "n_terms", "ingested_at"))


def answer(
    spark: SparkSession,
    store: Store,
    questions: DataFrame,
    embed: hooks.Embed,
    complete: hooks.Complete | None = None,
    calls: replies.CallStore | None = None,
) -> DataFrame:
    """``(query_id, answer, route, sources, sql_attempts, error)`` of every question.

    ``questions(query_id string, question string, top_k int)``; a missing or non-positive
    ``top_k`` means 10. The result is as in ``answer_hits``, and the run is added to the query log
    (time split evenly). With ``calls`` the model is asked nothing that it has replied to before.
    """
    started = time.monotonic()
    top_k = F.col("top_k") if "top_k" in questions.columns else F.lit(None).cast("int")
    asked = questions.select(
        "query_id",
        "question",
        F.when(top_k > 0, top_k).otherwise(F.lit(fixed.DEFAULT_TOP_K)).cast("int").alias("top_k"),
    )
    result = answer_hits(spark, asked, search(spark, store, asked, embed, calls), complete, store.table_path, calls)
    per_question = int((time.monotonic() - started) * 1000 / max(1, result.count()))
    result.select("query_id", "route", F.lit(per_question).cast("bigint").alias("duration_ms")).write.mode(
        "append"
    ).parquet(store.query_log)
    return result


def answer_hits(
    spark: SparkSession,
    asked: DataFrame,
    found: DataFrame,
    complete: hooks.Complete | None,
    path_of: Callable[[str], str],
    calls: replies.CallStore | None = None,
) -> DataFrame:
    """Answers of ``asked(query_id, question, top_k)`` from their hits with payload.

    ``path_of`` gives the folder of a table. Statements are asked for and run table by table until
    a question has rows, whose text the model then answers from; a question without such rows, or
    whose reply to them failed, is answered from the texts. What fails concerns its question
    alone: a failed request for a statement goes on with the next table, and only when the last
    reply fails is ``answer`` NULL and ``error`` says why. ``sql_attempts`` are the statements that
    ran, whatever the route, with the file, sheet and number of their table. A question without
    hits or without such statements has empty arrays.

    Every reply is written before it is used, and so is the result: looking at it again, or
    losing an executor later, does not call the model again.
    """
    hits = written(found, "hits")
    ranked = hits.join(asked.select("query_id", "top_k").withColumnRenamed("top_k", "_k"), "query_id")
    diverse = written(retrieval.diversify(ranked, F.col("_k")).drop("_k", "top_k"), "diverse")

    statements = Statements(spark, path_of)
    candidates = retrieval.table_candidates(hits)
    from_rows = spark.createDataFrame([], "query_id string, reply string")
    if complete is not None:
        keyed = diverse.filter((F.col("place") == 1) & (F.col("table_key") != "")).select("query_id")
        usable = candidates.join(keyed, "query_id", "left_semi").filter(F.size("schema") > 0)
        prompts = written(
            sql_prompts(usable, retrieval.table_samples(hits), asked.select("query_id", "question")),
            "sql-prompts",
        )

        def ask(now: DataFrame) -> DataFrame:
            told = replies.completions(calls, now, "prompt", "reply", complete, error="error")
            return written(told.select("query_id", "table_rank", "table_key", clean_sql("reply").alias("sql"), "error"), "sql-statements")

        statements.rounds(prompts, prompts.agg(F.max("table_rank")).first()[0] or 0, ask)
        won = statements.attempts().filter("status = 'rows'")
        chosen = won.select("attempt", "query_id", "table_rank", "sql").join(
            prompts.select("query_id", "table_rank", "summary"), ["query_id", "table_rank"]
        )
        results = prompt_tables(statements.rows().join(won.select("attempt"), "attempt", "left_semi"), "query_id")
        told = result_prompts(results.join(chosen, "query_id"), asked.select("query_id", "question"))
        from_rows = written(replies.completions(calls, told, "prompt", "reply", complete, error="error").select("query_id", "reply"), "sql-replies")
    good = from_rows.filter(F.col("reply").isNotNull())
    log = statements.log()
    # The route is that of the answer: rows whose reply failed do not count.
    won_tables = log.filter(F.col("n_rows") > 0).join(good, "query_id", "left_semi").select("query_id", "table_key")
    routes = answer_routes(asked, diverse, won_tables, complete is not None)

    open_questions = diverse.join(good, "query_id", "left_anti")
    if complete is None:
        texts = retrieval.raw_answers(open_questions).select("query_id", F.col("answer").alias("text_reply"), F.lit(None).cast("string").alias("error"))
    else:
        asked_text = chunk_prompts(open_questions, asked.select("query_id", "question"))
        texts = replies.completions(calls, asked_text, "prompt", "text_reply", complete, error="error").select("query_id", "text_reply", "error")

    listed = retrieval.sources(diverse).groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("place", "source_file", "sheet", "table_index", "row_index", "table_key", "score", "text")
            )
        ).alias("sources")
    )
    identity = candidates.select("query_id", "table_key", "source_file", "sheet", "table_index")
    ran = (
        log.filter(F.col("status").isin(*EXECUTED))
        .join(identity, ["query_id", "table_key"])
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("table_rank", "table_key", "source_file", "sheet", "table_index", "sql", "n_rows", "rows_json"))
            ).alias("sql_attempts")
        )
    )
    return written(
        routes.join(good, "query_id", "left")
        .join(texts, "query_id", "left")
        .join(listed, "query_id", "left")
        .join(ran, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("error").isNull(), F.coalesce("reply", "text_reply", F.lit(fixed.NO_HITS_ANSWER))).alias("answer"),
            "route",
            *[F.coalesce(c, F.array().cast(t[c].dataType)).alias(c) for c, t in (("sources", listed.schema), ("sql_attempts", ran.schema))],
            "error",
        ),
        "answers",
    )
