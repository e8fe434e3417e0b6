"""Which table answers, and whether SQL or text does."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.operators.sqlguard import RejectedSQL, header_texts, open_table, run_guarded, shown_rows
from gridloom.session import fresh_path

ATTEMPTS_SCHEMA = (
    "query_id string, table_rank int, table_key string, sql string, status string, "
    "n_rows bigint, detail string, attempt string"
)
RESULT_ROWS = "query_id string, table_rank int, head string, row_no bigint, text string, json string, attempt string"
# Statements that ran are recorded, with or without rows.
EXECUTED = ("rows", "empty")
# Statements that run at once, seconds that one may take, sessions kept open, and statements
# whose outcome the driver holds before it writes them down.
AT_ONCE, TIME_LIMIT, OPEN_TABLES, BLOCK = 8, 600.0, 256, 512


class Statements:
    """Runs candidate statements, each on its table, and keeps what became of them in files.

    A bounded number of statements runs at once, each as a job group of its own in a pool of its
    own (fair if the application schedules so), cancelled when it exceeds its time. A table
    has one session, whichever statement comes first. An outcome concerns its question only.
    The driver holds one block of outcomes; rows of results never pass it.
    """

    def __init__(self, spark: SparkSession, path_of: Callable[[str], str], at_once: int = AT_ONCE, time_limit: float = TIME_LIMIT):
        self.spark, self.path_of, self.at_once, self.time_limit = spark, path_of, at_once, time_limit
        self.root = fresh_path(spark, "statements")
        self._sessions: OrderedDict[str, SparkSession] = OrderedDict()
        self._lock = threading.Lock()
        self._any = False

    def _session(self, key: str) -> SparkSession:
        with self._lock:
            if key not in self._sessions:
                self._sessions[key] = open_table(self.spark, self.path_of(key))
                if len(self._sessions) > OPEN_TABLES:
                    self._sessions.popitem(last=False)
            self._sessions.move_to_end(key)
            return self._sessions[key]

    def attempt(self, candidate: Row) -> tuple:
        """Try one ``(query_id, table_rank, table_key, sql[, error])``; the outcome as a row.

        It runs once: its rows are written where it found them, and only their number comes back.
        """
        name = uuid.uuid4().hex
        base = (candidate["query_id"], candidate["table_rank"], candidate["table_key"], candidate["sql"])
        outcome = lambda status, n=None, detail=None: (*base, status, n, detail, name)
        failure = candidate["error"] if "error" in candidate else None
        if failure is not None:
            return outcome("not_generated", detail=failure)
        statement = candidate["sql"] or ""
        if statement.lower() == fixed.IRRELEVANT_REPLY:
            return outcome("skipped")
        context, late = self.spark.sparkContext, threading.Event()

        def stop() -> None:
            late.set()
            context._jsc.sc().cancelJobGroupAndFutureJobs(name)

        timer = threading.Timer(self.time_limit, stop)
        timer.daemon = True
        try:
            context.setJobGroup(name, f"statement of {base[0]} on {base[2]}", True)
            context.setLocalProperty("spark.scheduler.pool", name)
            timer.start()
            result = run_guarded(self._session(base[2]), statement)
            path = f"{self.root}/rows/attempt={name}"
            named = [F.lit(base[0]).alias("query_id"), F.lit(base[1]).cast("int").alias("table_rank"), F.lit("\n".join(header_texts(result))).alias("head")]
            shown_rows(result).select(*named, "row_no", "text", "json").write.parquet(path)
            n = self.spark.read.parquet(path).count()
            return outcome("rows" if n else "empty", n)
        except RejectedSQL as e:
            return outcome("rejected", detail=str(e))
        except (PySparkException, Py4JError) as e:
            condition = e.getCondition() if isinstance(e, PySparkException) else None
            return outcome("failed", detail="time limit" if late.is_set() else condition or type(e).__name__)
        finally:
            timer.cancel()
            context.setLocalProperty("spark.scheduler.pool", None)
            context.setLocalProperty("spark.jobGroup.id", None)

    def run(self, candidates: Iterable[Row]) -> None:
        """Try candidates of different questions, several at once."""
        left = iter(candidates)
        with ThreadPoolExecutor(self.at_once) as pool:
            while block := list(islice(left, BLOCK)):
                outcomes = list(pool.map(self.attempt, block))
                self.spark.createDataFrame(outcomes, ATTEMPTS_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/attempts")
                self._any = True

    def rounds(self, candidates: DataFrame, deepest: int, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Round n tries the n-th candidate of each question that has no rows yet.

        ``prepare`` turns the candidates of a round into statements (asks for them), so nothing is
        prepared that a walk stopping at the first result would not need.
        """
        for rank in range(1, deepest + 1):
            now = candidates.filter(F.col("table_rank") == rank)
            if self._any:
                now = now.join(self.attempts().filter("status = 'rows'").select("query_id"), "query_id", "left_anti")
            self.run((prepare(now) if prepare else now).toLocalIterator())

    def attempts(self) -> DataFrame:
        if not self._any:
            return self.spark.createDataFrame([], ATTEMPTS_SCHEMA)
        return self.spark.read.schema(ATTEMPTS_SCHEMA).parquet(f"{self.root}/attempts")

    def rows(self) -> DataFrame:
        """Rows of the results of statements that ran, in one scan; what a failed one left is not read."""
        ran = self.attempts().filter(F.col("status").isin(*EXECUTED)).select("attempt")
        if ran.isEmpty():
            return self.spark.createDataFrame([], RESULT_ROWS)
        return self.spark.read.schema(RESULT_ROWS).parquet(f"{self.root}/rows").join(ran, "attempt", "left_semi")

    def log(self) -> DataFrame:
        """Every attempt, with the rows of its result as one JSON array where it ran."""
        records = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "json"))), lambda r: r["json"])
        texts = self.rows().groupBy("attempt").agg(records.alias("_r"))
        texts = texts.select("attempt", F.array_join("_r", ",").alias("_text"))
        shown = F.when(F.col("status").isin(*EXECUTED), F.concat(F.lit("["), F.coalesce("_text", F.lit("")), F.lit("]")))
        return self.attempts().join(texts, "attempt", "left").withColumn("rows_json", shown).drop("_text")


def first_rows(statements: Statements, candidates: Iterable[Row]) -> Iterator[tuple]:
    """Candidates of one question in order, up to and including the first with rows."""
    for candidate in candidates:
        outcome = statements.attempt(candidate)
        yield outcome
        if outcome[4] == "rows":
            break


def answer_routes(
    questions: DataFrame, diverse: DataFrame, won: DataFrame, can_query: bool = True
) -> DataFrame:
    """``none`` without hits; ``sql`` if the top diversified hit has a table, statements
    can be written and run, and one returned rows; ``text`` otherwise."""
    top = diverse.filter(F.col("place") == 1).select("query_id", F.col("table_key").alias("top_table"))
    return (
        questions.select("query_id")
        .join(top, "query_id", "left")
        .join(diverse.select("query_id").distinct().withColumn("has_hits", F.lit(True)), "query_id", "left")
        .join(won.select("query_id", F.col("table_key").alias("won_table")), "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("has_hits").isNull(), F.lit("none"))
            .when(
                (F.coalesce("top_table", F.lit("")) != "") & F.lit(can_query) & F.col("won_table").isNotNull(),
                F.lit("sql"),
            )
            .otherwise(F.lit("text"))
            .alias("route"),
        )
    )
