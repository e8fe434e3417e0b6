"""Ranked search, chat formatting and tokenizer alignment against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import alignment, chat, ranked_search

rng = np.random.default_rng(5)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, size = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (i, c, length) in enumerate(counted):
            m = 50 + 50 * length * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, row))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def prose(n, kinds=60):
    # Low numbers are far more frequent than high ones.
    return " ".join(f"w{int(kinds * rng.random() ** 3)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    docs = [(i, prose(int(rng.integers(1, 80)))) for i in range(300)]
    docs += [(900, docs[3][1]), (901, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (902, None), (903, ""), (904, " .,-"), (905, "Ünï W1 w2_w3\x7fW1"), (906, "w1 " * 50_000)]
    items = [(i, prose(int(rng.integers(1, 20)))) for i in range(25)] + [(1, "w1 W1 w1"), (77, None), (78, "?!"), (79, "nowhere"), (None, "w4 ünï Ünï")]
    return docs, items


@pytest.mark.parametrize(("k", "block", "shard"), [(5, 8 << 20, 2_000_000), (50, 8 << 20, 300), (3, 200, 2_000_000)])
def test_ranked_search(spark, corpus, k, block, shard):
    docs, items = corpus
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs], "doc_id long, text string, score double, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in ranked_search.search(d, q, k, block, shard).collect()), key=str)
    assert got == ranked(docs, items, k)


def test_search_stops_before_the_end():
    """Unseen documents are bounded by best positions; with clear winners most are never met."""
    n = 20_000
    tf = np.full(2 * n, 1, np.int64)
    tf[:40] = 1000
    length = np.full(n, 100)
    length[:20] = 5
    lists = ranked_search._Lists(length, np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), tf, np.array([500, 700]), n, 100 * n)
    met = []
    best = ranked_search._Best(10)
    ranked_search.best_positions(lists, np.array([0, 1]), np.full(2, -1), lambda at, score: best.offer(score, at * 0, at, at), met)
    assert met[0] < 200 and sorted(best.rows[2].tolist()) == list(range(10)) and not lists.seen.any()


def test_search_of_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus, ("doc_id long, text string", "item_id long, text string")))
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ranked_search.search(d, q).collect() == []


NASTY = ["", "hi", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\|end|><|end|>", "<|turn|>x<|says|>", "<<|image|>>", "[[INST]", "\\<s>\\", "é\U0001f600\n<|attachment|>", "<", "[", "|end|>", "a<|\\end|>", "\r\n\x0b"]


def test_escapes_come_back():
    t = chat.Template()
    control = [t.turn, t.says, t.end, t.other, *(p for _, p in t.placeholders), *t.foreign]
    texts = [a + b + c for a, b, c in itertools.product(NASTY, repeat=3)]
    for text in texts:
        safe = t.escaped(text)
        assert not any(c in safe for c in control) and t.unescaped(safe) == text


def test_templates_that_cannot_be_read_are_refused():
    for bad in ({"end": "x"}, {"end": "<|a<b|>"}, {"end": "<\\>"}, {"escape": "ab"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_digest(spark):
    random.seed(2)
    rows = [(c, t, random.choice(["user", "assistant", "system", None, "<|end|>\n"]), random.choice([*NASTY, None]), "x") for c in [*range(40), None] for t in [*range(random.randint(1, 12)), None]]
    rows += [(3, 1, "assistant", "twice", "x")] * 2 + [(5, 2, "assistant", "long <s> " * 300_000, "x")]
    random.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string").repartition(4)
    expected = {}
    for c, g in itertools.groupby(sorted([*rows, *[(*r, "") for r in chat.CONTROL]], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())), key=lambda r: r[0]):
        g = list(g)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in g)
        masked = "".join(r[3] or "" for r in g if r[2] == "assistant")
        expected[c] = (len(g), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest())
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digest(spark, turns).collect()}
    assert got == expected and -7 in got


def test_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), (None, "and <|image|>", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.01, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None), ("image", None, None, None, None, None, None)]
    rows = [(1, 0, "user", None, parts), (1, 1, "assistant", "plain", None), (1, 2, "assistant", None, [parts[0], parts[1], parts[0], None])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, text string, parts array<{chat.PART}>")
    (r,) = chat.format_chats(turns).collect()
    assert r["text"] == "<|turn|>user<|says|>see <|image|>and <\\|image|><|audio|><|document|><|attachment|><|image|><|end|><|turn|>assistant<|says|>plain<|end|><|turn|>assistant<|says|>see <|image|>see <|end|>"
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in r["attached"]] == [(0, 1, "image", "a.png", 4), (0, 3, "audio", "b.wav", 26), (0, 4, "document", "c.pdf", 3072), (0, 5, "video", "d", 0), (0, 6, "image", None, 576), (2, 1, "image", "a.png", 4)]
    assert all(r["text"].startswith("<|", a["at"]) for a in r["attached"]) and r["n_expanded"] == 4 + 26 + 3072 + 576 + 4
    assert [r["text"][s["start"] : s["end"]] for s in r["loss"]] == ["plain", "see ", "see "]


def test_long_conversations_go_on_in_rows(spark):
    turns = spark.createDataFrame([(c, t, "assistant", "x" * (t % 7)) for c in (1, 2) for t in range(60)], "conv_id long, turn int, role string, text string")
    whole = {r["conv_id"]: r["text"] for r in chat.format_chats(turns).collect()}
    rows = sorted(chat.format_chats(turns, row_chars=200).collect(), key=lambda r: (r["conv_id"], r["number"]))
    assert len(rows) > 20 and all(len(r["text"]) <= 200 for r in rows)
    for c in (1, 2):
        mine = [r for r in rows if r["conv_id"] == c]
        assert "".join(r["text"] for r in mine) == whole[c] and [r["number"] for r in mine] == list(range(len(mine))) and sum(r["n_turns"] for r in mine) == 60
        assert "".join(r["text"][s["start"] : s["end"]] for r in mine for s in r["loss"]) == "".join("x" * (t % 7) for t in range(60))


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).collect() == []
    assert [r["conv_id"] for r in chat.chat_digest(spark, none).collect()] == [-7]


@pytest.fixture(scope="module")
def vocabularies():
    return [open(alignment.tokenizer_path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def aligned(pair, docs):
    """Whole texts tokenized at once and compared token by token."""
    out, holders = {}, Counter()
    for key, text in docs:
        text = text or ""
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        raw = (" " + text).encode()
        if not text or b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
            out[key] = (0, 0, 0, [], "")
            continue
        spans = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            ends = list(itertools.accumulate(len(names[i]) for i in ids))
            spans.append([(i, e - len(names[i]), e) for i, e in zip(ids, ends)])
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        said = [[defaultdict(list) for _ in range(2)] for _ in range(1)][0]
        for side, group in zip(spans, said):
            for i, _, e in side:
                group[next(k for k, c in enumerate(cuts) if c >= e)].append(str(i))
        groups = [f"{','.join(said[0][k])}|{','.join(said[1][k])}" for k in range(len(cuts))]
        links = [(x, y) for x, s, e in spans[0] for y, t, f in spans[1] if s < f and t < e]
        holders.update(set(links))
        out[key] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = defaultdict(int)
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    rows = {k: (a, b, g, len(ls), sum(holders[p] == top[p[0]] for p in ls), sum(holders[p] for p in ls), d) for k, (a, b, g, ls, d) in out.items()}
    return rows, holders, Counter(p for v in out.values() for p in v[3])


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    bits = ["the", "house", "Straße", "naïve", "日本語", "\U0001f600", "don't", "x=1;", "12345", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", " ", "  ", "   ", "\t", "\n", "\r\n", " ", "　", "\x00", "\x1c", ".", "​", "﻿", "é", "ﬁ", "\u0085"]
    made = ["".join(random.choice(bits) + random.choice([" ", " ", ""]) for _ in range(random.randint(1, 30))) for _ in range(250)]
    return [*made, made[0], made[0], "▁", "a▁b", "a ▁ b", None, "", " ", "x", " x ", "the house " * 300]


@pytest.mark.parametrize("gather", [alignment.GATHER, 50])
def test_alignment(spark, texts, vocabularies, monkeypatch, gather):
    monkeypatch.setattr(alignment, "GATHER", gather)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, code int").repartition(3)
    expected, holders, linked = aligned(alignment._Pair(*vocabularies), enumerate(texts))
    got, pairs = alignment.align(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == expected
    pairs = {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in pairs.collect()}
    assert pairs == {p: (n, linked[p]) for p, n in holders.items()}


def test_windows_of_long_texts(vocabularies, monkeypatch, texts):
    """Cut into chunks and windows, a text has the tokens that it has whole."""
    pair = alignment._Pair(*vocabularies)
    text = " ".join(t for t in texts if t and "▁" not in t)
    monkeypatch.setattr(alignment, "WINDOW", 100)
    chunks = alignment._Chunks(pair)
    at = alignment._chunk_numbers(text, chunks)
    chunks.learn()
    assert int(chunks.n_a[at].sum()) == len(pair.a.encode(" " + text, add_special_tokens=False).ids)
    assert int(chunks.n_b[at].sum()) == len(pair.b.encode(text))


def test_bitmaps_are_ored(spark):
    """Containers that share documents, dense and sparse ones, count each document once."""
    sets = [(7, 0, 0, range(5000)), (7, 0, 0, range(4000, 9000)), (7, 0, 1, range(4990, 9010)), (7, 1, 0, [3]), (9, 0, 1, [1, 2]), (9, 0, 1, [2, 65535])]
    rows = []
    for code, span, plane, members in sets:
        n = np.array(list(members))
        for c in alignment._containers(np.full(len(n), code), n, np.full(len(n), plane)):
            rows += [(code, span, plane, int(c["card"][i]), bool(c["dense"][i]), c["bits"][i].as_py()) for i in range(len(c["card"]))]
    merged = alignment.merged_bitmaps(spark.createDataFrame(rows, alignment.POSTING)).toArrow().sort_by([("code", "ascending"), ("span", "ascending"), ("plane", "ascending")])
    found = [(merged["code"][i].as_py(), merged["span"][i].as_py(), merged["plane"][i].as_py(), merged["card"][i].as_py(), merged["fresh"][i].as_py()) for i in range(merged.num_rows)]
    assert found == [(7, 0, 0, 9000, 9000), (7, 0, 1, 4020, 10), (7, 1, 0, 1, 1), (9, 0, 1, 3, 3)]
    places, of = alignment._members(pa.table(merged))
    assert sorted(places[of == 3].tolist()) == [1, 2, 65535]


def test_alignment_of_an_empty_table(spark):
    got, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and pairs.collect() == []
