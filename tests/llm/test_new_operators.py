"""Language-model scores, fill-in-middle and hard negatives against brute force; the SQL of all queries that have some."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodspark.llm import fim, hardneg, maxent, queries, toxicity
from floodspark.llm.text import Scratch

from ..conftest import SMALL
from ..test_queries import duck, rows  # noqa: F401

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):  # noqa: F811
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# fill-in-middle


def test_skip_lists_reach_every_rank():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 9, 50, 700, 5000):
        text = "".join(rng.choice(["a", "b", "Zq", " ", "\n", "1", "é", "漢", "😀", "<", "P", ">"]) for _ in range(n))
        units = UNIT.findall(text)
        widths = fim.units(text)
        assert list(widths) == list(map(len, units))
        skips, at = fim.SkipList(widths), np.concatenate([[0], np.cumsum(widths, dtype=int)])
        for r in range(0, len(units) + 1, max(1, len(units) // 40)):
            assert skips.reach(r) == at[r]
        assert skips.reach(len(units)) == len(text)
    lanes = [len(u) for u, _, _ in fim.SkipList(np.ones(100_000, int)).lanes]
    assert all(a > 3 * b for a, b in zip(lanes, lanes[1:])) and lanes[-1] <= 8


def test_parts_come_back(spark):
    rng = random.Random(2)
    texts = [None, "", "one", "a<P>b", "x <S", "é 漢字 <", "<P", "P>", "😀" * 5, "ab " * 40_000, "\x00\n\t", "<<S", "<M"]
    texts += ["".join(rng.choice("abcXYZ <>PSM\n12é") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, "no id", "own"), (3, texts[3], "own")], "doc_id long, text string, output string")
    got = fim.restored(fim.transform(docs)).collect()
    assert len(got) == docs.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        units = UNIT.findall(text)
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.n, r.form, r.output, r.restored, (r.prefix_chars, r.middle_chars)) == (len(units), form, want, text, sizes)
    assert fim.transform(docs.limit(0)).count() == 0


# hard negatives


def brute_negatives(vectors, anchors, positives=5, negatives=10):
    out = []
    for a in anchors:
        label, x = vectors[a]
        score = {b: int(x @ y) for b, (_, y) in vectors.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if vectors[b][0] == label][:positives]:
            fit = [b for b in order if vectors[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, i, b, score[p], score[b]) for i, b in enumerate(fit[:negatives], 1)]
    return sorted(out)


def _close(rng, n, dims, spread):
    centres = rng.normal(size=(4, dims))
    return [(int(i), int(i % 5), [float(v) for v in centres[i % 4] + spread * rng.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("dims, spread", [(64, 1.0), (64, 0.4), (3, 0.5), (130, 0.3)])
def test_negatives_agree_with_all_pairs(spark, monkeypatch, dims, spread):
    rng = np.random.default_rng(dims)
    data = _close(rng, 400, dims, spread)
    data += [(1000 + i, 1, data[0][2]) for i in range(40)]  # copies, and so ties
    monkeypatch.setattr(hardneg, "LEAST_ROWS", 60)
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    frame = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    # In single precision, as the table holds them.
    vectors = {i: (label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, label, v in data}
    got = hardneg.mine(hardneg.integers(frame), F.col("vec_id") % 20 == 0)
    want = brute_negatives(vectors, [i for i in vectors if i % 20 == 0])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.1]), (3, 2, [0.6]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [nan, 1.0]), (7, 1, [inf, 0.0]), (8, 1, [None, 1.0]), (None, 1, [1.0, 1.0]), (9, 2, []), (2, 2, [0.5, 0.1])]
    frame = spark.createDataFrame([(*r, "own") for r in data], "vec_id long, label int, embedding array<double>, ints string")
    got = hardneg.mine(hardneg.integers(frame), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 3, 65536, 39168), (0, 1, 2, 2, 65536, 32768)]
    assert hardneg.mine(hardneg.integers(frame.limit(0)), F.col("vec_id") == 0).count() == 0
    assert hardneg.mine(hardneg.integers(frame), F.col("vec_id") == 77).count() == 0


def test_intervals_hold_the_scores_and_shut_rows_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8).astype(np.int64)
    codes, aligned, sizes = hardneg.encode(x.astype(float), hardneg.rotation(64))
    many = lambda a: pa.array(list(a.astype(a.dtype)))
    table = pa.table({"vec_id": pa.array(range(3000)), "label": pa.array([0] * 3000), "ints": many(x), "codes": many(codes.view(np.int64)), "aligned": many(aligned), "sizes": many(sizes)})
    rows_ = hardneg.Coded(table)
    est, half = hardneg.intervals(rows_, slice(0, 50), rows_)
    real = x[:50] @ x.T
    assert (np.abs(real - est) <= half).all()
    # The best rows of an anchor are found among a small share of all.
    kth = np.partition(est - half, -10, axis=1)[:, -10]
    assert ((est + half >= kth[:, None]).sum(1) / 3000).mean() < 0.2


# language-model scores


def _tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def _check_base(got, docs, held):
    c = Counter(w for i, t in docs if not held(i) for w in _tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for r, (i, t) in zip(got, docs):
        w = _tokens(t)
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9, abs_tol=1e-9)
    return c


def test_base_scores_and_better_ones(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = queries.op11_maxent_scores(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    _check_base(got, docs, held)
    assert all(r.held_out == held(r.doc_id) for r in got)
    sums = {k: [sum(x) for x in zip(*((r.base_score, r.score, r.n_tokens) for r in got if r.held_out == k))] for k in (True, False)}
    assert all((model - base) / n > 0.05 for base, model, n in sums.values())  # log10 a token
    # A head of few words: most words meet their counts in the join. More tasks, summed up in a tree.
    monkeypatch.setattr(maxent, "HEAD", 40)
    monkeypatch.setattr(maxent, "SLICE", 1000)
    monkeypatch.setattr(maxent, "SHARE", 4000)
    monkeypatch.setattr(maxent, "WAYS", 2)
    again = queries.op11_maxent_scores(spark, SMALL).orderBy("doc_id").collect()
    _check_base(again, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()], held)


def test_odd_texts_are_scored(spark):
    texts = [None, "", " \n\t", "A a B", "a b", "ÉÀ é", "x" * 300, "x" * 300 + " y", "a\x1cb\x85c d e", "long " * 50_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, "a b")]
    frame = spark.createDataFrame([(i, t, i % 3 == 1, "own") for i, t in docs], "doc_id long, text string, held_out boolean, tail string")
    got = sorted(maxent.score(frame).collect(), key=lambda r: r.doc_id)
    _check_base(got, sorted(docs, key=lambda d: d[0]), lambda i: i % 3 == 1)
    assert all(r.score <= 0 for r in got)
    none = maxent.score(frame.withColumn("held_out", F.lit(True))).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in none} == {(0, 0, 0.0, 0.0)}
    assert maxent.score(frame.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b", False), (None, None, False)], "doc_id long, text string, held_out boolean")
    assert sorted(r.n_tokens for r in maxent.score(nulls).collect()) == [1, 3]


def test_words_of_every_slice(monkeypatch):
    texts = ["Ab cd ", "Q r", None, "É  Z\x0b", "", "one TWO three", "u"]
    for extra in ([], [None]):  # with and without a null: Arrow casts slices of the two differently
        column = pa.array([t for t in texts if t is not None or extra] + extra, pa.string())
        for size in (1, 4, 9, 1000):
            monkeypatch.setattr(maxent, "SLICE", size)
            got = [w for _, _, parts in maxent.chunks(column) for p in parts for w in maxent.words(p)[0].to_pylist()]
            assert got == [w.encode() for t in column.to_pylist() for w in _tokens(t)[:-1]]


def test_base_scores_of_a_batch_in_several_slices(spark):
    # One batch without nulls, above 4 MB: later slices begin inside its bytes.
    docs = [(i, f"common W{i} {'x' * 70} " + " ".join(f"w{i}x{k} Und" for k in range(150_000 if i % 4 == 0 else 3))) for i in range(12)]
    assert sum(len(t) for _, t in docs) > maxent.SLICE
    frame = spark.createDataFrame([(i, t, i % 5 == 1) for i, t in docs], "doc_id long, text string, held_out boolean").coalesce(1)
    got = sorted(maxent.score(frame).collect(), key=lambda r: r.doc_id)
    _check_base(got, docs, lambda i: i % 5 == 1)


def _lexicon(counts, tokens=None):
    return maxent.Lexicon(sum(counts.values()) if tokens is None else tokens, len(counts), counts)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(3)
    lex = _lexicon({maxent.END: 50} | {f"w{i}".encode(): int(c) for i, c in enumerate(rng.zipf(1.5, 2000).clip(1, 500))})
    model = maxent.Model(lex)
    for t in model.tables.values():
        t += rng.normal(size=t.shape).astype(np.float32) * 0.5
    before = np.array([3, 1500, 7], np.uint16)
    total = other = 0.0
    for code in range(lex.n_members):
        total += 10 ** (model.log10(np.append(before, code).astype(np.uint16), np.array([0]))[0] - model.log10(before, np.array([0]))[0])
    outside = 10 ** (model.log10(np.append(before, maxent.CLASSES * maxent.MEMBERS + 9).astype(np.uint16), np.array([0]))[0] - model.log10(before, np.array([0]))[0])
    # All known other words and one unknown one share the other class.
    other = (lex.counts[lex.n_members :] + 1).sum() + 1
    assert math.isclose(total + outside, 1, rel_tol=1e-4)
    assert math.isclose(other, lex.other_total)


def test_one_short_text_alone():
    model = maxent.Model(_lexicon({maxent.END: 1}))
    assert model.log10(np.array([0], np.uint16), np.array([0]))[0] <= 0


def test_gradients_of_the_classes_and_members():
    rng = np.random.default_rng(4)
    lex = _lexicon({maxent.END: 9} | {f"w{i}".encode(): 5 + i % 7 for i in range(300)})
    codes = rng.integers(0, 301, 400).astype(np.uint16)
    starts = np.array([0, 100, 250])

    def loss(model):
        return -model.log10(codes, starts).sum() * math.log(10)

    model = maxent.Model(lex)
    trainer = maxent.Trainer(model)
    seen = {}

    def keep(table, at, gradient, n):
        seen.setdefault(table, []).append((at.copy(), gradient.copy()))

    trainer._move = keep
    trainer.learn(codes, starts)
    for table, moves in seen.items():
        at, gradient = moves[-1]
        for k in range(0, len(at), max(1, len(at) // 5)):
            j = int(np.abs(gradient[k]).argmax())
            old = model.tables[table].copy()
            change = {}
            for e in (0.05, -0.05):
                model.tables[table] = old.copy()
                model.tables[table][at[k], j] += e
                change[e] = loss(model)
            model.tables[table] = old
            assert math.isclose((change[0.05] - change[-0.05]) / 0.1, gradient[k, j], rel_tol=0.03, abs_tol=0.02)


def test_changes_are_summed_in_a_tree(spark):
    rows_ = [(p, "classes", 0, np.full(4, p, np.float32).tobytes(), np.full(2, 1, np.float32).tobytes()) for p in range(7)]
    changes = spark.createDataFrame(rows_, maxent.CHANGES)
    r = changes.withColumn("part", F.lit(0)).groupBy("part", "name", "block").applyInArrow(maxent._summed, maxent.CHANGES).first()
    assert np.frombuffer(r.change, np.float32).tolist() == [21.0] * 4 and np.frombuffer(r.times, np.float32).tolist() == [7.0] * 2


# toxicity


def test_risk_is_least_and_does_not_fall_below_zero():
    rng = np.random.default_rng(6)
    xp, xu = (rng.random((40, 8)) < 0.5).astype(np.float32), (rng.random((90, 8)) < 0.3).astype(np.float32)
    soft = lambda s: np.log1p(np.exp(s))

    def parts(t, b, prior):
        sp, su = xp @ t + b, xu @ t + b
        return prior * soft(-sp).mean(), soft(su).mean() - prior * soft(sp).mean(), toxicity.SHRINK / 2 * (t @ t)

    def trained(prior):
        model = toxicity.train([f"w{i}" for i in range(8)], xp, xu, prior)
        return np.array([model.weights.get(f"w{i}", 0.0) for i in range(8)]), model.bias

    # A small prior: the bracket stays positive, so the weights are a minimum of the whole risk.
    theta, bias = trained(0.05)
    here = sum(parts(theta, bias, 0.05))
    assert parts(theta, bias, 0.05)[1] > 0
    for _ in range(200):
        d = rng.normal(size=9) * 0.05
        assert sum(parts(theta + d[:8], bias + d[8], 0.05)) > here - 1e-3
    # A large one: the bracket's gradient is followed backwards, so it does not run below zero.
    theta, bias = trained(0.6)
    assert parts(theta, bias, 0.6)[1] > -0.05
    # Without that it would: the plain risk has no bottom near zero.
    t, b = np.zeros(8), 0.0
    for _ in range(3000):
        sp, su = 1 / (1 + np.exp(-(xp @ t + b))), 1 / (1 + np.exp(-(xu @ t + b)))
        gp, gu = (0.6 * (sp - 1) - 0.6 * sp) / len(sp), su / len(su)
        t, b = t - 0.5 * (xp.T @ gp + xu.T @ gu), b - 0.5 * (gp.sum() + gu.sum())
    assert parts(t, b, 0.6)[1] < -0.05
