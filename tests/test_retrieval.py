import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import prompts, retrieval, routing, vectors


def test_dense_equals_brute_force_in_one_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    corpus = rng.normal(size=(300, 8)).astype(np.float32)
    corpus[50:150] = corpus[0]  # a third are copies: ties go by id
    corpus[7] = 0
    asked = rng.normal(size=(40, 8)).astype(np.float32)
    asked[3] = 0
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id bigint, dense array<float>").repartition(7)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query_id string, dense array<float>")

    def unit(m):
        n = np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    scores = np.round(unit(corpus.astype(np.float64)) @ unit(asked.astype(np.float64)).T, 6) + 0.0
    expected = {}
    for j in range(40):
        order = sorted(range(300), key=lambda i: (-scores[i, j], i))[:12]
        expected[f"q{j}"] = [(i, n + 1) for n, i in enumerate(order)]
    for block, rows in ((1024, 1024), (10, 1024), (1024, 16)):
        monkeypatch.setattr(retrieval, "SLICE", rows)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = {}
        for r in retrieval.dense_topk(c, q, 12, "vec_id").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r["rank"]))
        assert got == expected


def test_sparse_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 40))) for _ in range(200)] + [""]
    asked = [" ".join(rng.choice(words, size=5)) for _ in range(12)] + ["zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    qs = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {}
    hits = retrieval.sparse_topk(vectors.postings(docs, "doc_id"), vectors.postings(qs, "query_id"), 9, "doc_id")
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for j, question in enumerate(asked):
        qw = question.split()
        scored = []
        for i, t in enumerate(texts):
            tw = t.split()
            dot = sum(tw.count(w) * qw.count(w) for w in set(qw))
            if dot:
                scored.append((i, round(dot / (len(tw) * len(qw)), 6)))
        expected = sorted(scored, key=lambda s: (-s[1], s[0]))[:9]
        assert [d for d, _ in got.get(j, [])] == [d for d, _ in expected]
        assert [s for _, s in got.get(j, [])] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_stored_sparse_vectors_are_scored_in_place(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 30))) for _ in range(150)] + ["", "same words"] * 3
    docs = spark.createDataFrame([(f"c{i:03}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    vectors.with_sparse(docs, "chunk_id").repartition(5).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    asked = [(i, " ".join(rng.choice(words, size=4))) for i in range(9)] + [(9, "zzz"), (10, "same")]
    items = vectors.postings(spark.createDataFrame(asked, "query_id int, text string"), "query_id")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "rank").collect())
    expected = rows(retrieval.sparse_topk(vectors.postings(docs, "chunk_id"), items, 7))
    for block, size in ((8192, 1024), (3, 20)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "SLICE", size)
        found = retrieval.stored_sparse_topk(index, items, 7)
        assert rows(found) == expected
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text[text.index("MapInArrow"):]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int")


def test_fusion(spark):
    a = ranked(spark, [("q", "x", 1), ("q", "y", 2), ("q", "z", 3)])
    b = ranked(spark, [("q", "y", 1), ("q", "w", 2)])
    got = [(r.chunk_id, r.score) for r in retrieval.fuse_rrf([a, b], 3).orderBy("rank").collect()]
    assert got == [("y", round(1 / 3 + 1 / 2, 6)), ("x", 0.5), ("w", round(1 / 3, 6))]


@pytest.fixture(scope="module")
def hits(spark):
    keys = ["a", "a", "a", "a", "", "b", "a", "", "c", "b", "", "", "b", "b"]
    rows = [
        ("q", i + 1, f"c{i}", k, f"t{i}" if i != 1 else "", f"{k}.csv", "S" if k == "b" else "", "about b" if k == "b" else "")
        for i, k in enumerate(keys)
    ]
    return spark.createDataFrame(
        rows,
        "query_id string, rank int, chunk_id string, table_key string, text string, source_file string, sheet string, summary string",
    ).repartition(3)


def test_diversify_is_the_greedy_walk(hits):
    for top_k, per in ((10, 3), (4, 3), (3, 1), (50, 2)):
        counts, expected = {}, []
        for r in hits.orderBy("rank").collect():
            if len(expected) < top_k and counts.get(r.table_key, 0) < per:
                expected.append(r.chunk_id)
                counts[r.table_key] = counts.get(r.table_key, 0) + 1
        got = [r.chunk_id for r in retrieval.diversify(hits, top_k, per).orderBy("place").collect()]
        assert got == expected


def test_candidates_and_samples(hits):
    got = [(r.table_rank, r.table_key, r.chunk_id) for r in retrieval.table_candidates(hits).orderBy("table_rank").collect()]
    assert got == [(1, "a", "c0"), (2, "b", "c5"), (3, "c", "c8")]
    samples = {r.table_key: r.samples for r in retrieval.table_samples(hits, 3).collect()}
    assert samples == {"a": ["t0", "t2", "t3"], "b": ["t5", "t9", "t12"], "c": ["t8"]}


def test_raw_answer_and_context_prompt(spark, hits):
    diverse = retrieval.diversify(hits, 10)
    assert retrieval.raw_answers(diverse).first().answer == "t0\n\nt2"
    questions = spark.createDataFrame([("q", "Which?")], "query_id string, question string")
    prompt = prompts.chunk_prompts(diverse, questions).first().prompt
    assert prompt == (
        "Table descriptions:\n[b.csv/S]: about b\n\nQuestion: Which?\n\nContext (table rows):\n"
        "[1] t0\n[2] \n[3] t2\n[4] t4\n[5] t5\n\n" + prompts.CONTEXT_INSTRUCTIONS
    )


def test_routes(spark):
    questions = spark.createDataFrame([(q,) for q in "abcd"], "query_id string")
    diverse = spark.createDataFrame(
        [("a", 1, "t"), ("b", 1, ""), ("c", 1, "t"), ("b", 2, "t")], "query_id string, place int, table_key string"
    )
    won = spark.createDataFrame([("a", "t"), ("b", "t")], "query_id string, table_key string")
    got = {r.query_id: r.route for r in routing.answer_routes(questions, diverse, won).collect()}
    assert got == {"a": "sql", "b": "text", "c": "text", "d": "none"}
    got = {r.query_id: r.route for r in routing.answer_routes(questions, diverse, won, False).collect()}
    assert got == {"a": "text", "b": "text", "c": "text", "d": "none"}


def test_hits_do_not_depend_on_partitioning(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("same words "), (F.col("id") % 3).cast("string"), F.lit("x")).alias("text"))
    qs = spark.createDataFrame([(1, "same words 1x")], "query_id int, text string")
    results = [
        [tuple(r) for r in retrieval.sparse_topk(vectors.postings(d, "doc_id"), vectors.postings(qs, "query_id"), 15, "doc_id").orderBy("rank").collect()]
        for d in (docs.coalesce(1), docs.repartition(11))
    ]
    assert results[0] == results[1]


def test_postings_of_odd_keys_equal_counted_terms(spark):
    rows = [(1, "Größe größe ab ab x"), (1, "ab 日本"), (2, None), (3, "- -"), (None, "ab cd"), (None, "cd"), (4, "z" * 3000 + " naïve")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    idx = tx.term_bucket("term").alias("idx")
    expected = vectors.term_counts(docs, "doc_id").groupBy("doc_id", idx).agg(F.sum("tf"), F.max("n_terms")).collect()
    for spread in (True, False):
        got = vectors.postings(docs, "doc_id", spread=spread).drop("w").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected)))


def test_sparse_search_keeps_null_keys_and_rounds_halves_up(spark):
    docs = spark.createDataFrame([(None, "ab " * 640), (2**60 + 1, "ab " + "cd " * 639), (5, "ab " + "cd " * 639)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(None, "ab"), (7, "ab xx")], "query_id bigint, text string")
    hits = retrieval.sparse_topk(vectors.postings(docs, "doc_id"), vectors.postings(asked, "query_id"), 3, "doc_id")
    got = sorted(((r.query_id or 0, r["rank"], r.doc_id, r.score) for r in hits.collect()), key=lambda r: r[:2])
    assert got == [
        (0, 1, None, 1.0), (0, 2, 5, 0.001563), (0, 3, 2**60 + 1, 0.001563),
        (7, 1, None, 0.5), (7, 2, 5, 0.000781), (7, 3, 2**60 + 1, 0.000781),
    ]


def test_matches_are_counted_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"same words w{i % 3}a w{i % 5}b") for i in range(60)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(q, f"same w{q % 3}a w{q}b words") for q in range(7)], "query_id int, text string")
    run = lambda: sorted(tuple(r) for r in retrieval.sparse_topk(vectors.postings(docs, "doc_id"), vectors.postings(asked, "query_id"), 9, "doc_id").collect())
    whole = run()
    monkeypatch.setattr(retrieval, "PAIRS", 10)
    monkeypatch.setattr(vectors, "PIECE_TERMS", 7)
    assert run() == whole and len(whole) == 63
