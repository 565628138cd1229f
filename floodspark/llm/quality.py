"""Quality rules as a short-circuit cascade, in native DataFrame code.

Each rule rejects a text by one comparison of its statistics. On a bounded sample the cascade
measures how long each rule takes and how many rows it rejects, then applies the rules by rejections
per second; coalesce() stops at the first that rejects, so later rules' statistics are not computed
for that row. The order changes speed only: a text is kept when no rule rejects it.

The sample has at most ``SAMPLE_ROWS`` rows of at most ``SAMPLE_BYTES`` each, from the first partitions that
hold enough; nothing but the order rests on it.

Null and empty texts have no words and are rejected by ``few_words``. Repeated rows are judged alike, an
empty table gives no rows, and ids may be null or repeat. Further columns pass through; rejected_by() replaces a
column of that name, and keep_good() leaves it as it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.text import SPACE

_BLANKS = " \t\n\x0b\x0c\r"
_STATS = "__quality"
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 15


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row even where a lambda refers to it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def capitals(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[A-Z]")), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return bound(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _spread(hits: Column) -> Column:
    """How many words the 3-word windows at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(p, p + 1, p + 2)))))


def _not_null(xs: Column) -> Column:
    return F.filter(xs, lambda x: x.isNotNull())


def repeated_words(ws: Column, few: int = 256) -> Column:
    """Words in 3-word windows that occur twice or more.

    The windows' hashes are sorted to find those that repeat. With at most ``few`` of them, the
    windows that have one are counted, if their words show as many different windows as hashes.
    Otherwise all windows are sorted by their words.
    """

    def by_words(w: Column) -> Column:
        three = F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")),
        )

        def count(s: Column) -> Column:
            same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
            return _spread(
                _not_null(
                    F.transform(s, lambda x, i: F.when(same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)), x["i"]))
                )
            )

        return bound(F.sort_array(three), count)

    def by_hashes(w: Column, h: Column, twice: Column) -> Column:
        hits = _not_null(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)))

        def count(at: Column) -> Column:
            texts = F.transform(at, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
            return F.when(F.size(F.array_distinct(texts)) == F.size(twice), _spread(at)).otherwise(by_words(w))

        return bound(hits, count)

    def narrowed(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        )

        def search(h: Column) -> Column:
            repeats = lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1)))
            return bound(
                bound(F.sort_array(h), repeats),
                lambda twice: F.when(F.size(twice) == 0, F.lit(0))
                .when(F.size(twice) <= few, by_hashes(w, h, twice))
                .otherwise(by_words(w)),
            )

        return bound(hashes, search)

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(bound(ws, narrowed)).cast("long")


#: A rule takes the text and its words and says whether it rejects; the constants are its thresholds.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "few_words": lambda text, ws: F.size(ws) < 50,
    "repetition": lambda text, ws: 100 * repeated_words(ws) > 50 * F.size(ws),
    "symbols": lambda text, ws: 10 * symbols(text) > F.size(ws),
    "duplicate_lines": lambda text, ws: 2 * duplicate_lines(text) > F.size(lines_with_words(text)),
    "word_length": lambda text, ws: (word_chars(ws) < 3 * F.size(ws)) | (word_chars(ws) > 10 * F.size(ws)),
    "capitals": lambda text, ws: 10 * capitals(text) > 3 * word_chars(ws),
}


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn(_STATS, words(F.col(text_col)))


def order_rules(
    docs: DataFrame,
    text_col: str = "text",
    rules: dict[str, Callable[[Column, Column], Column]] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> list[str]:
    """The rules' names by rejected sample rows per second of the rule's own work, best first."""
    # take() reads partitions one by one until it has enough, so the sample is bounded and moves nothing else.
    rows = docs.select(text_col).filter(F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES).take(sample_rows)
    local = docs.sparkSession.createDataFrame(rows, docs.select(text_col).schema)
    sample = with_words(local, text_col).persist()
    try:
        n = sample.count()
        if not n:
            return list(rules)

        def timed(rule: Column) -> tuple[int, float]:
            began = time.perf_counter()
            hit = sample.agg(F.count_if(rule)).first()[0]
            return hit, time.perf_counter() - began

        _, idle = timed(F.lit(False))
        rank = {}
        for name, rule in rules.items():
            hit, took = timed(rule(F.col(text_col), F.col(_STATS)))
            rank[name] = hit / max(took - idle, 1e-3)
        return sorted(rules, key=lambda name: -rank[name])
    finally:
        sample.unpersist()


def rejected_by(
    docs: DataFrame,
    text_col: str = "text",
    rules: dict[str, Callable[[Column, Column], Column]] = RULES,
    order: list[str] | None = None,
) -> DataFrame:
    """docs with ``rejected_by``: the first rule of the cascade that rejects the text, else null."""
    return docs.withColumn("rejected_by", _cascade(text_col, rules, order or order_rules(docs, text_col, rules)))


def _cascade(text_col: str, rules: dict[str, Callable[[Column, Column], Column]], order: list[str]) -> Column:
    text = F.col(text_col)
    return bound(words(text), lambda ws: F.coalesce(*[F.when(rules[name](text, ws), F.lit(name)) for name in order]))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that a rule rejects."""
    return docs.filter(_cascade(text_col, RULES, order_rules(docs, text_col)).isNull())


def judged(docs: DataFrame) -> DataFrame:
    """The digest of documents: base statistics and verdicts; the cascade judges what base keeps."""
    rest = {name: rule for name, rule in RULES.items() if name not in ("few_words", "repetition")}
    order = order_rules(docs, "text", rest)
    text, ws = F.col("text"), F.col(_STATS)
    n = F.col("n_words")
    base = with_words(docs.select("doc_id", "text"), "text").select(
        "doc_id",
        "text",
        _STATS,
        F.size(ws).cast("long").alias("n_words"),
        word_chars(ws).alias("word_chars"),
        symbols(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
    )
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    own = rest | {
        "symbols": lambda text, ws: 10 * F.col("n_symbols") > n,
        "word_length": lambda text, ws: (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
        "duplicate_lines": lambda text, ws: (F.col("n_dup_lines") > 0)
        & (2 * F.col("n_dup_lines") > F.size(lines_with_words(text))),
        "capitals": lambda text, ws: 10 * capitals(text) > 3 * F.col("word_chars"),
    }
    verdict = F.coalesce(
        F.when(failed, F.lit("base")), *[F.when(own[name](text, ws), F.lit(name)) for name in order]
    )
    return base.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        verdict.isNull().alias("kept"),
    )
