"""The training-text operators against brute force on small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from gridloom.llm import lines, mixing, near_copies, neighbours, ngram_model, packing, pii, quality, substrings, toxicity

WORDS = [f"word{i}" for i in range(400)]
rng = np.random.default_rng(1)
PROSE = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
TEXTS = [*PROSE, PROSE[0], PROSE[0], PROSE[1].replace("word1", "other", 1), PROSE[2] + " end", "", None, "   ", "a b", "a b", "long " * 4000, PROSE[3] + "\n" + PROSE[4] + " é\U0001f600"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 5 else None, len(t or ""), i) for i, t in enumerate(TEXTS)]
    rows += [(None, PROSE[5], "en", "s0", 1, 7), (3, TEXTS[3], "en", "s0", 1, 7)]
    path = str(tmp_path_factory.mktemp("docs"))
    # Columns named like results must do no harm.
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").withColumnsRenamed({}).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def everything(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_empty_tables(spark, docs, tmp_path):
    docs.where("doc_id < -5").write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        pii.pii_digest(none),
        toxicity.toxicity_scores(none, labels),
        toxicity.drop_toxic(none, labels),
        substrings.strip_repeats(none),
        lines.dedup_lines(none),
        quality.quality_verdicts(none),
        packing.pack(none),
        near_copies.near_classes(none),
        ngram_model.score_texts(none),
        neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        mixing.mix(none),
    ):
        assert result.count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) < 256 for x in re.findall("[0-9]+", m[0])), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), n, kind, m.end())] * ok
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii(spark):
    texts = ["a@b.c%x@d.e q@w.e@r.t 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112", "\U0001f600 +1 (555) 123-4567 001.2.3.256 x@y.zz\x01\x02 é z@w.org", None, "", "a@" * 300, "1.1." * 500]
    texts += ["".join(t) for t in itertools.product("a1@. +", repeat=4)]
    got = pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(base_spans(texts[r["doc_id"]]).encode()).hexdigest()


def test_pii_checksums_and_context(spark):
    text = "iban GB82 WEST 1234 5698 7654 32 bad GB83WEST12345698765432. number 123-45-6789 and far away from anything that would explain it. ssn 123-45-6789"
    (row,) = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    kinds = [s.split(":")[0] for s in row["spans"].split(",")]
    assert kinds == ["iban", "ssn"]


def test_toxicity_learns_held_out(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = list(r.choice(WORDS, 30))
        if i % 4 == 0:
            w[5], w[20] = "vilething" + "abc"[i % 3], "grimstuff"
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    data.write.parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    got = toxicity.toxicity_scores(data.select("doc_id", "text"), data.select("doc_id", "toxic")).collect()
    held = [x for x in got if x["held_out"]]
    assert all(x["held_out"] == (crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert np.mean([x["predicted"] == rows[x["doc_id"]][2] for x in held]) > 0.97
    spans = next(x for x in got if x["predicted"])["toxic_spans"].split(",")
    text = rows[next(x for x in got if x["predicted"])["doc_id"]][1]
    assert {text[int(a) : int(b)][:4] for a, b in (s.split(":") for s in spans)} <= {"vile", "grim"}
    kept = toxicity.drop_toxic(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert kept.columns == ["doc_id", "text"] and abs(kept.count() - 300) <= 4


def test_toxicity_learns_a_long_tail(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(3_000):
        w = list(r.choice(WORDS, 20))
        if i % 10 == 0:
            # Each in one of forty toxic texts, so none in 4 % of them.
            w[4] = w[11] = chr(97 + i // 10 % 20) * 3 + "xy"[i // 200 % 2] * 4
        rows.append((i, " ".join(w), int(i % 10 == 0)))
    train = [x for x in rows if crc32(str(x[0]).encode()) % 4 != 2]
    model = toxicity.fit([x[1] for x in train], np.array([x[2] > 0 for x in train]), 0.1)
    got = toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()
    held = [(x["score"] >= toxicity.THRESHOLD, rows[x["doc_id"]][2]) for x in got if crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.01


@pytest.mark.parametrize("block", [1, 3, 64])
def test_marginals_are_those_of_all_labellings(block):
    r = np.random.default_rng(8)
    lengths, moves, begin = np.array([5, 0, 9, 1, 3, 7]), r.normal(size=(2, 2)), -0.7
    e = np.exp(r.normal(size=lengths.sum()) * 2)
    a, b = toxicity.messages(e, lengths, moves, begin, block)
    want = []
    for end, n in zip(np.cumsum(lengths), lengths):
        own, total, toxic = e[end - n : end], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            weight = math.exp(sum(moves[i][j] for i, j in zip(y, y[1:])) + begin * sum(y[:1])) * float(np.prod(own ** np.array(y)))
            total += weight
            toxic += weight * np.array(y)
        want += list(toxic / total)
    assert np.allclose(a * b / (1 + a * b), want)


def test_messages_pass_over_blocks():
    r = np.random.default_rng(5)
    lengths = np.array([70_000, 3, 130])
    e, moves = np.exp(r.normal(size=lengths.sum()) * 12), r.normal(size=(2, 2))
    for x, y in zip(toxicity.messages(e, lengths, moves, -1.0), toxicity.messages(e, lengths, moves, -1.0, 70_000)):
        assert np.allclose(x, y)


def test_offsets_where_lower_case_is_longer(spark):
    rows = [(i, "\u0130stanbul so vile a word" if i % 3 == 0 else "so calm a word in \u0130stanbul", int(i % 3 == 0)) for i in range(300)]
    rows = [(i, t + " " + " ".join(np.random.default_rng(i).choice(WORDS, 20)), y) for i, t, y in rows]
    model = toxicity.fit([t for _, t, _ in rows], np.array([y > 0 for _, _, y in rows]), 0.3)
    for x in toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect():
        text = rows[x["doc_id"]][1]
        found = [text[int(a) : int(b)] for a, b in (s.split(":") for s in x["toxic_spans"].split(",") if s)]
        assert len(found) == x["n_toxic_tokens"] and ("vile" in found) == (x["doc_id"] % 3 == 0)


def removed(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [16_384, 2])
def test_substrings(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rows = everything(docs)
    want = Counter((d, *r) for (d, _), r in zip(rows, removed([(t or "").encode() for _, t in rows])))
    got = Counter(tuple(r)[:5] for r in substrings.strip_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


def test_substrings_shared_passage_with_different_surroundings(spark, tmp_path):
    r = np.random.default_rng(9)
    make = lambda n: "".join(r.choice(list("abcdefgh "), n))
    passage = make(260)
    texts = [make(int(r.integers(0, 300))) + passage[int(r.integers(0, 50)) : int(r.integers(200, 261))] + make(int(r.integers(0, 300))) for _ in range(40)] + ["ab" * 300, "xyz" * 70]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "p"))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substrings.strip_repeats(spark.read.parquet(str(tmp_path / "p"))).collect()}
    assert [got[i] for i in range(len(texts))] == removed([t.encode() for t in texts])


def test_lines(spark, tmp_path):
    """Longest shared runs, found by extending each pair of equal lines to both sides."""
    r = np.random.default_rng(4)
    kinds = ["a", " a", "b", "c", "", "\t", "d e", "f g h i", "j k l m n o p", "q r s t u v w x", "1 2 3 4 5 6 7 8 9 10 11"]
    texts = ["\n".join(r.choice(kinds, int(r.integers(0, 14)))) for _ in range(70)] + [None, "", "q  r s t u v w x\r", "1 2 3 4 5 6 7 8 9 10 11\na", "1 2 3 4 5 6 7 8 9 10 11\n\na\nz"]
    spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_lines long, starts string").coalesce(1).write.parquet(str(tmp_path / "l"))
    got = {x["doc_id"]: x for x in lines.dedup_lines(spark.read.parquet(str(tmp_path / "l"))).collect()}
    inked = [[k for k, x in enumerate((t or "").split("\n")) if x.strip()] for t in texts]
    said = [[(t or "").split("\n")[k].strip() for k in ks] for t, ks in zip(texts, inked)]
    for i, t in enumerate(texts):
        gone = set()
        for earlier in range(i + 1):
            for p in range(len(said[i])):
                for q in range(len(said[earlier]) if earlier < i else p):
                    if said[i][p] != said[earlier][q]:
                        continue
                    a = b = 0
                    while min(p, q) - a > 0 and said[i][p - a - 1] == said[earlier][q - a - 1]:
                        a += 1
                    while p + b + 1 < len(said[i]) and q + b + 1 < len(said[earlier]) and said[i][p + b + 1] == said[earlier][q + b + 1]:
                        b += 1
                    if a + b + 1 >= 3 or sum(len(x.split()) for x in said[i][p - a : p + b + 1]) >= 8:
                        gone.update(range(p - a, p + b + 1))
        drop = {inked[i][k] for k in gone}
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if t is not None else None
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_deleted"], got[i]["starts"]) == (want, len(inked[i]), len(gone), "x")


def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, monkeypatch):
    texts = ["\n".join(PROSE[k % 12] for k in (i, i + 1, i + 2)) for i in range(24)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "r"))
    read = lambda: spark.read.parquet(str(tmp_path / "r"))
    runs = {substrings: lambda: substrings.strip_repeats(read()), lines: lambda: lines.dedup_lines(read()), near_copies: lambda: near_copies.drop_near_copies(read())}
    name = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(name)
    for module, run in runs.items():
        want = sorted(map(str, run().collect()))
        first = module.written

        def then_other_splits(df, label):
            out = first(df, label)
            # Splits are then cut by the number of cores.
            spark.conf.set(name, "1")
            return out

        with monkeypatch.context() as m:
            m.setattr(module, "written", then_other_splits)
            got = sorted(map(str, run().collect()))
        spark.conf.set(name, was)
        assert got == want, module.__name__


def test_quality(docs):
    for doc, text in {d: t for d, t in everything(docs)}.items():
        row = quality.quality_verdicts(docs.where("doc_id <=> %s" % ("NULL" if doc is None else doc))).first() if doc in (0, 16, 17, 21, 22) else None
        if row is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        ink = [x for x in (text or "").split("\n") if x.strip()]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ink) - len(set(ink)), len(covered))
        assert row["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_ablation_counts(docs):
    policy = quality.POLICIES["v2"]
    bits = [r["fail_bits"] & policy.mask for r in quality.ledger(docs).collect()]
    for r in quality.ablation(quality.ledger(docs), policy).collect():
        bit = 1 << r["rule"]
        assert (r["failing"], r["failing_alone"], r["kept_without"]) == (sum(bool(b & bit) for b in bits), bits.count(bit), bits.count(0) + bits.count(bit))


def test_boundaries_are_optimal():
    edges, counts = np.array([2, 3, 5, 9, 14, 20]), np.array([4, 1, 7, 2, 3, 1])
    cost = lambda b: sum(c * (min(x for x in b if x >= e) - e) for e, c in zip(edges, counts))
    for k in (1, 2, 3, 6):
        best = min(cost(b) for b in itertools.combinations(edges.tolist(), k) if b[-1] == 20)
        assert cost(packing.best_boundaries(edges, counts, edges * counts, k)) == best


def test_boundaries_of_many_lengths():
    """Against the same recurrence, searched in full."""
    r = np.random.default_rng(11)
    for n in (1, 2, 17, 150):
        edges, counts = np.sort(r.choice(5_000, n, replace=False)), r.integers(1, 50, n)
        best = [0.0] + [math.inf] * n
        pad = [[int((counts[i:j] * (edges[j - 1] - edges[i:j])).sum()) for j in range(n + 1)] if i < n else None for i in range(n + 1)]
        for k in (1, 2, 3, 4, 5, 6):
            best = [0.0] + [min(best[i] + pad[i][j] for i in range(j)) for j in range(1, n + 1)]
            bounds = np.array(packing.best_boundaries(edges, counts, edges * counts, k))
            assert len(bounds) == min(k, n) and bounds[-1] == edges[-1]
            assert (counts * (bounds[np.searchsorted(bounds, edges)] - edges)).sum() == best[n]
    assert packing.best_boundaries(*(np.zeros(0, dtype=np.int64),) * 3, 4) == []


def test_packing(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 4)
    got = packing.pack(docs, budget=256).collect()
    assert len(got) == docs.count() and got[0].asDict()["score"] is not None
    for (bucket,), rows in itertools.groupby(sorted(got, key=lambda r: (r["bucket"], r["batch"], r["slot"])), key=lambda r: (r["bucket"],)):
        rows = list(rows)
        room = max(1, 256 // max(1, rows[0]["boundary"]))
        assert [(r["batch"], r["slot"]) for r in rows] == [(i // room, i % room) for i in range(len(rows))]
        assert all(r["n_tokens"] == len((r["text"] or "").split()) <= r["boundary"] for r in rows)


def test_near_classes(docs, monkeypatch):
    rows = everything(docs)
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    want = Counter((d, sum(linked(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    for block in (512, 2):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = near_copies.near_classes(docs).collect()
        assert Counter((r["doc_id"], r["n_links"]) for r in got) == want
        by_id = {r["doc_id"]: r["class_id"] for r in got}
        assert by_id[12] == by_id[13] == 0 and by_id[14] == 1 and by_id[15] == 2 and by_id[20] == 19 and by_id[None] == 5
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["class_row"] for r in got})


def test_language_model(docs):
    rows = everything(docs)
    tokens = [(t or "").lower().split() for _, t in rows]
    train = [w for (d, _), w in zip(rows, tokens) if crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for (d, _), w in zip(rows, tokens):
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want[(d, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6))] += 1
    got = ngram_model.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_language_model_joins_rare_words(docs, monkeypatch):
    before = sorted((r["doc_id"] or -1, round(r["base_score"], 6), r["n_known"]) for r in ngram_model.score_texts(docs).collect())
    monkeypatch.setattr(ngram_model, "TOP", 5)
    assert before == sorted((r["doc_id"] or -1, round(r["base_score"], 6), r["n_known"]) for r in ngram_model.score_texts(docs).collect())


def test_filter_never_loses_a_count():
    layout = ngram_model.Filter(3000)
    h = np.sort(np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    start = layout.slice_of(h).astype(np.int64) * layout.slice_bytes
    assert (np.diff(start) >= 0).all() and start.max() < layout.slices * layout.slice_bytes
    bits = np.zeros(layout.slices * layout.slice_bytes * 8, dtype=bool)
    for level in (1, 2, 3):
        some = slice(None, 2000 // level)
        for at in layout.places(h[some], level):
            bits[start[some] * 8 + at.astype(np.int64)] = True
    level = layout.levels(h, np.packbits(bits, bitorder="little"), start)
    assert (level >= 1).all() and (level[:666] >= 3).all()


def test_filter_grows_with_the_tokens():
    for tokens in (0, 10, 10**6, 10**10, 10**14):
        layout = ngram_model.Filter(tokens)
        held = layout.slices * layout.slice_bytes * 8
        assert tokens * ngram_model.BITS_PER_TOKEN <= held <= 4 * tokens * ngram_model.BITS_PER_TOKEN + 16 * 512 * 2
        assert layout.slice_bytes < 1 << 20


def test_language_model_scores_are_those_of_quantised_counts(docs, monkeypatch):
    """With so many bits that no probe hits by chance, the score follows from counts alone."""
    monkeypatch.setattr(ngram_model, "BITS_PER_TOKEN", 4000)
    rows = everything(docs)
    fold = lambda d: crc32(str("" if d is None else d).encode()) % 7
    texts = [(d, [*(w.lower() if w.isascii() else w for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")), None]) for d, t in rows]
    train = [w for d, w in texts if fold(d) != 2]
    one, two = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["^", *w], w))
    size, q = sum(one.values()) + len(one) + 1, lambda c: 0.0 if not c else 1.0 if c == 1 else 2 ** (math.floor(math.log2(c)) + 0.5)
    want = Counter()
    for d, w in texts:
        score = 0.0
        for h, x in zip(["^", *w], w):
            held = float(len(train)) if h == "^" else q(one[h])
            score += math.log10(ngram_model.PAIRS * min(q(two[h, x]), held) / max(held, 1.0) + (1 - ngram_model.PAIRS) * (q(one[x]) + 1) / size)
        want[d, round(score, 6)] += 1
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in ngram_model.score_texts(docs).collect()) == want


def test_scores_do_not_depend_on_what_is_broadcast(docs):
    values = lambda df: Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert values(ngram_model.score_texts(docs)) == values(ngram_model.score_texts(docs, broadcast=0))
    assert ngram_model.score_texts(docs.where("doc_id < -5"), broadcast=0).count() == 0


@pytest.mark.parametrize("block", [4_096, 8])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "QUERIES", block)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 3
    x = (centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (None, rows[0][1])]
    # Of another length: answered among themselves; repeated rows are one candidate.
    short = [(6000, [1.0, 2.0, 0.0]), (6001, [0.0, 1.0, 1.0]), (6020, [3.0, 0.0, 1.0]), (6001, [0.0, 1.0, 1.0]), (6021, [9.0] * 4)]
    rows = [(*x, 0, 1.0) for x in rows + short]
    bad = [(*x, 0, 1.0) for x in bad]
    got = {}
    for q in neighbours.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, h double"), size=200).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert sorted(got.pop(6000)) == [(1, 6020, 3.0), (2, 6001, 2.0)] and sorted(got.pop(6020)) == [(1, 6000, 3.0), (2, 6001, 1.0)]
    x = x.astype(float)
    hits = 0
    for i in range(0, 3000, 20):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], x[[m[1] for m in mine]] @ x[i])
        hits += len(set(best) & {m[1] for m in mine})
    assert set(got) == set(range(0, 3000, 20)) and hits / (150 * 20) >= 0.9


def test_mixing(docs):
    one = mixing.mix(docs, seed="a", tags=True)
    assert one.columns == [*docs.columns, "copy", "order_key"]
    assert sorted(map(str, one.collect())) == sorted(map(str, mixing.mix(docs, seed="a", tags=True).collect()))
    assert mixing.mix(docs).columns == docs.columns
    only = mixing.mix(docs, {"s1": 1.0}, epochs=30.0)
    counts = Counter(r["doc_id"] for r in only.collect())
    assert {r["source"] for r in only.collect()} == {"s1"} and len(set(counts.values())) > 1


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 4)) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = docs.drop("score").columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*columns, "n_tokens", "bucket", "boundary", "batch", "slot"]
    step = docs.drop("score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == columns
        path = str(tmp_path / f"s{len(step.columns)}-{stage.__name__}")
        step.write.parquet(path)
        step = spark.read.parquet(path)
    assert step.count() == out.count()


def test_a_word_of_many_texts_is_looked_up_once():
    piece = pa.RecordBatch.from_arrays([pa.array(["a b A a", None, "b"])], ["_t"])
    kinds, which, pair = ngram_model._grams(*ngram_model._tokens(piece))
    assert len(set(kinds.tolist())) == len(kinds) == 3
    assert which.tolist() == [0, 1, 0, 0, 2, 2, 1, 2] and len(pair) == 8


def test_tokens_are_those_of_split_bytes():
    texts = ["x y", " A\x0bb \t c\u0085\x1c\x1f d", None, "", " \r\n", "é É\u2003\U0001f600", "a\x00b A  "]
    for first in (0, 1):
        piece = pa.RecordBatch.from_arrays([pa.array(texts)], ["_t"]).slice(first)
        words, flat, lengths = ngram_model._tokens(piece)
        want = [(t or "").encode().lower().split() for t in texts[first:]]
        assert [words[int(i)].as_py() for i in flat] == [w for ws in want for w in ws]
        assert lengths.tolist() == [len(ws) for ws in want] and len(set(words.to_pylist())) == len(words)


def test_no_chunk_of_texts_is_joined_with_the_filter(docs, monkeypatch):
    """A slice of the filter is in one place; it does not go to every chunk that asks it."""
    plans, kept = [], ngram_model.written

    def spied(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(ngram_model, "written", spied)
    assert ngram_model.score_texts(docs, broadcast=0).count() == len(TEXTS) + 2
    assert len(plans) > 1 and not any("Join" in p for p in plans)


def test_levels_are_those_of_the_whole_filter():
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(WORDS, 300)) for _ in range(60)] + ["long " * 700, ""]
    layout = ngram_model.Filter(2000)  # far too few bits, so that many probes hit by chance
    layout.part = 3
    chunks = []
    for k in range(4):
        some = texts[k::4]
        chunks.append(pa.table({"_chunk": [k] * len(some), "_t": some, "_train": [i % 5 != 2 for i in range(len(some))]}))
    counts, grams = Counter(), []
    for chunk in chunks:
        kinds, which, pair = ngram_model._grams(*ngram_model._tokens(chunk))
        word, ends = ngram_model.mix64(kinds)[which], np.cumsum([len(t.split()) + 1 for t in chunk["_t"].to_pylist()])
        for a, b, train in zip([0, *ends], ends, chunk["_train"].to_pylist()):
            counts.update([*word[a:b].tolist(), *pair[a:b].tolist()] if train else [])
        grams.append(np.sort(np.array(list({*word.tolist(), *pair.tolist()}), dtype=np.uint64)))
    bits = np.zeros(layout.slices * layout.slice_bytes * 8, dtype=bool)
    h = np.array(list(counts), dtype=np.uint64)
    top = np.floor(np.log2(list(counts.values()))).astype(int) + 1
    for level in range(1, top.max() + 1):
        some = h[top >= level]
        for at in layout.places(some, level):
            bits[layout.slice_of(some).astype(np.int64) * layout.slice_bytes * 8 + at.astype(np.int64)] = True
    bits = np.packbits(bits, bitorder="little")
    want = [layout.levels(g, bits, layout.slice_of(g).astype(np.int64) * layout.slice_bytes) for g in grams]
    asked = pa.concat_tables([ngram_model._ask(layout, c) for c in chunks])
    found = pa.concat_tables([ngram_model._answer(layout, asked.filter(pa.compute.equal(asked["part"], p))) for p in set(asked["part"].to_pylist())])
    for k, w in enumerate(want):
        rows = sorted((x["part"], x["levels"]) for x in found.to_pylist() if x["_chunk"] == k)
        assert list(b"".join(x for _, x in rows)) == w.tolist()
    assert any((w > 0).sum() > sum(int(x) in counts for x in g) for g, w in zip(grams, want))
