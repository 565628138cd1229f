"""Queries on the given tables: near duplicates against all pairs, packing against its rules, models on held-out rows."""

import hashlib
import re

import pytest

from floodspark.llm import queries
from floodspark.llm.text import table

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, TABLES, "documents").select("doc_id", "text").collect()}


def _shingles(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def test_near_duplicates_of_all_documents(spark, texts):
    sets = {i: _shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(by_size):
        for j in by_size[k + 1 :]:
            if 100 * len(sets[i]) < 85 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    got = queries.op6_minhash_near_dedup(spark, TABLES).collect()
    want = {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == want and len(got) == len(want)
    assert any(i != c for i, _, c, _ in want)


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _secrets(text):
    """Base findings by the three patterns as they are stated."""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(_ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, z) for a, _, z, k in sorted(found)]


def test_secrets_of_all_documents(spark, texts):
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, TABLES).collect()}
    assert got.keys() == texts.keys() and sum(len(_secrets(t)) for t in texts.values()) > 20
    for i, t in texts.items():
        want = _secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{z}" for k, a, z in want} <= set(got[i].spans.split(","))


def test_packing_of_all_documents(spark, texts):
    got = queries.op7_length_packing(spark, TABLES).toPandas()
    counts = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, TABLES).collect()}
    assert dict(zip(got.doc_id, got.n_words)) == counts and len(got) == len(texts)
    assert (got["pad"] == got.boundary - got.n_words).all() and (got["pad"] >= 0).all()
    batches = got.groupby("batch_id").boundary.agg(["size", "max", "min"])
    assert (batches["max"] == batches["min"]).all()
    assert ((batches["size"] * batches["max"] <= 16384) | (batches["size"] == 1)).all()


def test_languages_of_held_out_documents(spark):
    real = {r.doc_id: r.lang for r in table(spark, TABLES, "documents").collect()}
    got = [r for r in queries.op8_language_id(spark, TABLES).collect() if r.held_out and real[r.doc_id] and r.lang_pred != "und"]
    right = sum(r.lang_pred == real[r.doc_id] for r in got)
    print("op8", right, len(got))
    assert right >= 0.95 * len(got) > 0


def test_toxicity_of_held_out_documents(spark):
    real = {r.doc_id: r.toxic for r in table(spark, TABLES, "labels").collect()}
    got = [r for r in queries.op10_toxicity(spark, TABLES).collect() if r.held_out and real.get(r.doc_id) is not None]
    both = sum(r.predicted and real[r.doc_id] for r in got)
    said, toxic = sum(r.predicted for r in got), sum(real[r.doc_id] for r in got)
    print("op10", both, said, toxic, len(got))
    assert both >= 0.85 * said and both >= 0.85 * toxic and toxic
