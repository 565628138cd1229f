"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names: all operators and stages."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floodspark.llm import chat, decontam, fim, langid, maxent, neardup, packing, quality, secrets, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick brown fox jumps over the lazy dog near the old mill by the river"
TEXTS = [None, "", " \n\t ", "one", "x" * 200_000, "a b " * 30_000, "é" * 5, ITEM, f"{ITEM} and token=abcdef123", "good words " + " ".join(f"word{i}" for i in range(80))]
#: Result and helper names of all operators.
CLASHING = [
    "shard", "depth", "overflow", "n_bytes", "shard_bytes", "n_words", "boundary", "batch_id", "pad", "group", "row", "id", "node", "bucket", "component",
    "component_id", "n_shingles", "kept", "rejected_by", "spans", "n_tokens", "over_limit", "score", "predicted", "lang_pred", "item_id", "start", "end",
    "edits", "positive", "form", "output", "tail", "codes", "uid", "word", "ints", "block", "letters", "y", "rank", "a", "b", "least", "signature", "bands", "set_a", "set_b", "count", "n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[8]] * 3 + [(None, t, "en", "s", 1) for t in (None, "", ITEM, ITEM, "some words here")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, "words")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(8, 1, 1), (8, 1, 1), (8, 1, None), (9, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def _log(docs):
    return docs.select(
        F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.monotonically_increasing_id().alias("message"), F.lit(0).alias("seq"),
        F.lit("message").alias("kind"), F.when(F.col("lang").isNotNull(), "assistant").alias("role"), *[c for c in docs.columns if c not in ("doc_id",)],
    )


def _operators(bench, labels):
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    return {
        "op1": lambda d: chat.digests(chat.read_back(chat.render(chat.fold_events(_log(d))))),
        "op2": lambda d: sharding.assign(d, limit=100_000),
        "op3": secrets.scan_documents,
        "op4": lambda d: tokens.count_tokens(d, _tokenizer()),
        "op5": lambda d: decontam.matches(d, bench),
        "op6": lambda d: neardup.near_duplicates(d, k=3, percent=85),
        "op7": packing.packed,
        "op8": lambda d: langid.predict(d.withColumn("held_out", held), langid.fit(d.withColumn("held_out", held), ~F.col("held_out"))),
        "op9": quality.judged,
        "op10": lambda d: toxicity.score(d.withColumn("held_out", held), toxicity.fit(d, labels, ~held)),
        "op11": lambda d: maxent.score(d.withColumn("held_out", held)),
        "op12": fim.transform,
        "stage quality": quality.keep_good,
        "stage near": lambda d: neardup.drop_near_duplicates(d),
        "stage decontamination": lambda d: decontam.decontaminate(d, bench),
        "stage secrets": secrets.redact,
    }


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Rows for all of docs, where the operator gives one for each.
EACH = {"op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "stage secrets"}
NAMES = [*(f"op{n}" for n in range(1, 13)), "stage quality", "stage near", "stage decontamination", "stage secrets"]


def _sorted(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, docs, bench, labels):
    run = _operators(bench, labels)[name]
    plain = run(docs)
    n = docs.count()
    got = plain.collect()
    if name in EACH:
        assert len(got) == n
    assert run(docs.limit(0)).count() == 0
    # Columns of other operators' names change nothing and, in stages, pass through.
    loaded = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    more = run(loaded)
    stage = name.startswith("stage")
    free = [c for c in plain.columns if c != "batch_id"]
    assert _sorted(more, free) == _sorted(plain, free)
    if stage:
        assert more.columns == loaded.columns
        assert more.filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0


def test_defined_results(spark, docs, bench, labels):
    ops = _operators(bench, labels)
    conversations = {r.conv_id: r for r in ops["op1"](docs).collect()}
    assert conversations[None].n_turns == 5 and conversations[0].loss_chars == 0  # null ids are one conversation
    assert sorted((r.doc_id or -1, r.item_id) for r in ops["op5"](docs).collect()) == [(-1, 1), (-1, 1), (7, 1)] + [(8, 1)] * 4
    assert {(r.doc_id, r.item_id) for r in ops["op5"](docs.filter("doc_id = 7")).collect()} == {(7, 1)}
    kept = ops["stage decontamination"](docs).collect()
    assert len(kept) == docs.count() - 7 and not any(ITEM in (r.text or "") for r in kept)
    und = {r.doc_id: r.lang_pred for r in ops["op8"](docs).collect()}
    assert und[0] == und[1] == und[2] == "und" and und[3] != "und"
    near = ops["op6"](docs).collect()
    assert [r.kept for r in near if r.doc_id is None] == [True] * 5 and all(r.component_id is None for r in near if r.doc_id is None)
    shards = ops["op2"](docs).toPandas()
    assert (shards.n_bytes[shards.doc_id == 4] == 200_000).all()


def test_more_portions_give_the_same_matches(docs, bench, monkeypatch):
    more = bench.unionByName(bench.sparkSession.range(100, 130).selectExpr("id AS item_id", "concat('no text holds this sentence, number ', id, ' of them, at all') AS text"))
    more = more.unionByName(bench.filter("item_id = 1").withColumn("item_id", F.lit(200).cast("long")))
    want = _sorted(decontam.matches(docs, more), ["doc_id", "item_id", "edits"])
    kept = decontam.decontaminate(docs, more).count()
    for filter_bytes, index_bytes in ((1 << 20, 3000), (2000, 1000)):
        monkeypatch.setattr(decontam, "FILTER_BYTES", filter_bytes)
        monkeypatch.setattr(decontam, "INDEX_BYTES", index_bytes)
        assert _sorted(decontam.matches(docs, more), ["doc_id", "item_id", "edits"]) == want
        assert decontam.decontaminate(docs, more).count() == kept


def test_short_items_and_case_beyond_latin(spark):
    docs = spark.createDataFrame([(1, " Yes\n"), (2, "yes, no"), (3, "ÅÄÖ ЯБЛОКО УПАЛО НА ГОЛОВУ ДЯДЕ"), (4, "Ⱥ" * 5 + " the word list of the exam")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, "яблоко упало на голову дяде"), (3, "the word list of the exam")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3)}
    assert got[4, 3] == (11, 36, 0) and got[3, 2][2] == 0


def test_toxicity_takes_one_text_of_an_id(spark, labels):
    docs = spark.createDataFrame([(8, "vile words")] * 400 + [(i, "plain words") for i in range(100, 200)], "doc_id long, text string")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("held_out", F.lit(False)), model).distinct().collect()}
    assert got[8] > got[100]


def test_null_and_repeated_keys_overflow_within_the_limit(spark):
    rows = [(None, "x" * (1 + i % 70)) for i in range(3000)] + [("k", "y" * 30)] * 2000
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sharding.assign(docs, limit=100).toPandas()
    pages = got.groupby(["shard", "overflow"]).n_bytes.sum()
    assert len(got) == 5000 and (pages <= 100).all()
    few = sharding.assign(docs.limit(20), limit=400).toPandas()
    assert few.overflow.nunique() <= 12


def test_pipeline_hands_python_small_batches(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[3:4]:
        spark.conf.unset(corpus_pipeline.BATCH_CONF)
        stage(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.BATCH_BYTES, name
    spark.conf.set(corpus_pipeline.BATCH_CONF, "1m")
    corpus_pipeline.pack(spark, docs.limit(1), "")
    assert spark.conf.get(corpus_pipeline.BATCH_CONF) == "1m"
    spark.conf.unset(corpus_pipeline.BATCH_CONF)
