"""Model calls are made once, whatever is repeated."""

import pytest

from gridloom.operators.hooks import hashed_embedding
from gridloom.operators.replies import CallStore
from gridloom.plans.answer import answer
from gridloom.plans.ingest import Store, ingest


def counted(folder, fail=""):
    """A model that leaves a file for each call, wherever it runs."""
    folder.mkdir(exist_ok=True)
    place = str(folder)

    def model(system, prompt):
        import uuid

        with open(f"{place}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if fail and fail in prompt:
            raise RuntimeError("no reply")
        return f" {system}{prompt.upper()} "

    return model


def calls_of(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, prompt string")


def test_equal_prompts_are_sent_once(spark, tmp_path, rows_of):
    store = CallStore(str(tmp_path / "kept"), "m")
    asked = prompts(spark, "a", "b", "a", None, "", "a")
    done = store.completions(asked, "prompt", "reply", counted(tmp_path / "n"), "s:")
    assert sorted(tuple(r) for r in done.select("i", "reply").collect()) == [(0, "s:A"), (1, "s:B"), (2, "s:A"), (3, None), (4, "s:"), (5, "s:A")]
    done.count()
    assert calls_of(tmp_path / "n") == ["", "a", "b"]
    # The next run asks what is new; another system text or model is another call.
    store.completions(prompts(spark, "a", "c"), "prompt", "reply", counted(tmp_path / "n"), "s:")
    assert calls_of(tmp_path / "n") == ["", "a", "b", "c"]
    store.completions(prompts(spark, "a"), "prompt", "reply", counted(tmp_path / "n"), "t:")
    CallStore(store.root, "other").completions(prompts(spark, "a"), "prompt", "reply", counted(tmp_path / "n"), "s:")
    assert calls_of(tmp_path / "n") == ["", "a", "a", "a", "b", "c"]


def test_failed_calls_are_made_again(spark, tmp_path):
    store = CallStore(str(tmp_path / "kept"), "m")
    asked = prompts(spark, "good", "bad")
    done = store.completions(asked, "prompt", "reply", counted(tmp_path / "n", "bad"), error="error")
    assert sorted(tuple(r)[1:] for r in done.collect()) == [("bad", None, "RuntimeError: no reply"), ("good", "GOOD", None)]
    empty = store.completions(asked, "prompt", "reply", counted(tmp_path / "n", "bad"), tolerate_errors=True)
    assert sorted(r.reply for r in empty.collect()) == ["", "GOOD"]
    with pytest.raises(Exception, match="no reply"):
        store.completions(asked, "prompt", "reply", counted(tmp_path / "n", "bad")).collect()
    done = store.completions(asked, "prompt", "reply", counted(tmp_path / "n"))
    assert sorted(r.reply for r in done.collect()) == ["BAD", "GOOD"]
    assert calls_of(tmp_path / "n") == ["bad"] * 4 + ["good"]


def test_what_ended_before_a_job_failed_is_kept(spark, tmp_path):
    """A job that is stopped by one of its tasks leaves the replies of those that had ended."""
    store = CallStore(str(tmp_path / "kept"), "m", calls_a_task=1)
    model, marker = counted(tmp_path / "n"), str(tmp_path / "n")

    def dying(system, prompt):
        import os
        import time

        if prompt == "p0":
            while len(os.listdir(marker)) < 30:
                time.sleep(0.1)
            time.sleep(3)
            os._exit(1)  # the worker, not the call
        return model(system, prompt)

    asked = prompts(spark, *[f"p{i}" for i in range(31)])
    with pytest.raises(Exception):
        store.completions(asked, "prompt", "reply", dying).collect()
    first = calls_of(tmp_path / "n")
    done = store.completions(asked, "prompt", "reply", model)
    assert sorted(r.reply for r in done.collect()) == sorted(f"P{i}" for i in range(31))
    again = len(calls_of(tmp_path / "n")) - len(first)
    assert again < 12  # one, and those whose hash put them into the same task


def test_vectors_are_kept(spark, tmp_path):
    store, place = CallStore(str(tmp_path / "kept"), "m"), tmp_path / "n"
    place.mkdir()
    where, inner = str(place), hashed_embedding(8)

    def embed(texts):
        import uuid

        for t in texts:
            with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return inner(texts)

    asked = prompts(spark, "one two", "three", None, "one two")
    for _ in range(2):
        got = {r.i: r.v for r in store.embeddings(asked, "prompt", "v", embed).collect()}
        assert got[0] == got[3] == pytest.approx(list(inner(["one two"])[0])) and got[2] == [0.0] * 8
    assert calls_of(place) == ["", "one two", "three"]


def test_a_repeated_ingest_and_answer_ask_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("City,Size\nRome,5\nOslo,7\n")
    (tmp_path / "in" / "b.csv").write_text("City,Size\nRome,5\nOslo,7\n")
    store, calls, model = Store(str(tmp_path / "store"), 2, 2), CallStore(str(tmp_path / "kept"), "m"), counted(tmp_path / "n")
    asked = spark.createDataFrame([("q1", "size of Rome"), ("q2", "size of Rome")], "query_id string, question string")
    counts = []
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), store, hashed_embedding(16), model, calls=calls)
        got = answer(spark, store, asked, hashed_embedding(16), model, calls=calls).collect()
        assert len({r.answer for r in got}) == 1
        counts.append(len(calls_of(tmp_path / "n")))
    assert counts[0] == counts[1]
