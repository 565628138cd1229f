"""Language-model scoring by a hashed maximum-entropy model over words.

Tokens of a text are its words, lower-cased in A-Z, and one end. Training texts give counts of all words and,
from them, the base score: the sum over tokens of log10((c + 1) / (N + V + 1)), with c a token's count, N
the number of tokens and V that of distinct ones.

The model predicts each token from the three before it: first its class, then the token inside its class. The
``CLASSES`` classes of ``MEMBERS`` places hold the training texts' most frequent tokens in order of their counts; one
class more stands for all other words, whose probability inside it is (c + 1) / (N' + V' + 1) over the
other words, so that probabilities of all known words and one unknown one add up to 1. Both softmaxes start from the
counts and add up one weight row for each feature: the word before, the two before as a pair, and two skips, the second and
the third word before. Weight rows are hashed: a feature's (and for members, its and the class's) hash
names one of ``ROWS`` rows of a dense table, which is the model's size whatever the corpus holds.

Training takes every training text once. In each of ``ROUNDS`` rounds, Spark tasks go through their share of
the round's texts in lots, with sparse gradients in numpy, from the model that the round began with; they
return what they added to each weight row, with how often they did. These are summed up in a tree of groups of at most
``WAYS`` tables (so that no group grows with the corpus), and each row moves by its mean change over the tasks that
changed it. The driver holds one model, of about 12 MB.

Counting and looking up grow with the corpus: counts are combined before they are shuffled; the at most ``HEAD`` words
above a count threshold are broadcast, and the remaining words of each text, none of which is a hot key, are joined with
the counts. Words of more than 64 bytes are counted by their SHA-256.

A null text is an empty one, of the end alone. Rows are scored one by one: repeated rows and ids come out alike, null ids
too. Without training texts both scores are 0. Further columns are ignored; an empty table gives no rows. doc_id are whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.text import Scratch, runs, strings

CLASSES, MEMBERS, ROWS = 32, 32, 1 << 15
ROUNDS, LOT, RATE = 3, 4096, 0.1
#: Training tokens of a task and round, about; tables summed up in one group; weight rows in a block.
SHARE, WAYS, BLOCK = 1 << 22, 64, 512
HEAD = 1 << 17
END = b""  # no word is empty
#: Codes of 16 bits: places of members, then hashes of all other words; the last one stands before a text's first word.
BEGIN = 0xFFFF
#: Bytes of texts that are split into words at once.
SLICE = 1 << 22

_BLANK = re.compile(r"[\x20\x09-\x0D]")


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Rows (from, to) of some MB together, and their texts in order: in one array, or a longer text in several pieces."""
    offsets = strings(pa.record_batch([texts], names=["text"]), "text")[1]
    for i, j in runs(offsets, SLICE):
        part = texts.slice(i, j - i).fill_null("").cast(pa.large_string())
        if offsets[j] - offsets[i] <= SLICE:
            yield i, j, [part]
        else:
            yield i, j, [pa.array([p], pa.large_string()) for p in _cut(part[0].as_py())]


def _cut(text: str) -> Iterator[str]:
    i = 0
    while i < len(text):
        found = _BLANK.search(text, i + SLICE)
        j = found.start() if found else len(text)
        yield text[i:j]
        i = j


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts, in order, and the place of each one's text. Arrow takes the same six characters for white space.

    Words are lower-cased, not texts: a slice whose type was cast has offsets that do not begin at 0, from which ascii_lower reads wrong bytes.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    found, of = pc.ascii_lower(flat.filter(full)).cast(pa.large_binary()), of.filter(full).to_numpy()
    long = pc.greater(pc.binary_length(found), 64)
    if pc.any(long).as_py():
        names = [b"\0" + sha256(w).digest() for w in found.filter(long).to_pylist()]
        found = pc.replace_with_mask(found, long, pa.array(names, pa.large_binary()))
    return found, of


# Counts


def counts(docs: DataFrame) -> DataFrame:
    """docs (text, held_out) to word (binary; empty for the end), n (in all texts) and c (in training texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held_out in (False, True):
                texts = batch.column(0).filter(pc.equal(batch.column(1), held_out))
                found = [(pa.array([END], pa.binary()), np.array([len(texts)]))] if len(texts) else []
                for _, _, parts in chunks(texts):
                    for part in parts:
                        each = pc.value_counts(words(part)[0])
                        found.append((each.field(0).cast(pa.binary()), each.field(1).to_numpy()))
                for w, n in found:
                    yield pa.RecordBatch.from_arrays([w, pa.array(n), pa.array(np.zeros_like(n) if held_out else n)], names=["word", "n", "c"])

    # Counts of the slices of a task are combined before they are shuffled.
    once = docs.select("text", "held_out").mapInArrow(run, "word binary, n long, c long")
    return once.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


class Lexicon:
    """What is known of words: totals, and the most frequent words, in order of their training counts.

    The first of these, as far as training texts hold them, are the model's members. For each word of the head
    there are its code, its count, and its part of the base score and of the probability among words that are no members.
    """

    def __init__(self, tokens: int, distinct: int, head: dict[bytes, int]) -> None:
        """tokens, distinct: of the training texts; head: words and training counts."""
        order = sorted(head, key=lambda w: (-head[w], w))
        self.tokens, self.distinct, self.head = tokens, distinct, pa.array(order, pa.large_binary())
        self.end = order.index(END) if head else -1
        self.counts = np.array([head[w] for w in order], np.int64)
        self.n_members = min(int((self.counts > 0).sum()), CLASSES * MEMBERS)
        self.other_tokens = tokens - int(self.counts[: self.n_members].sum())
        self.other_distinct = distinct - self.n_members
        self.codes = np.array([i if i < self.n_members else rare_code(w) for i, w in enumerate(order)], np.uint16)
        self.base = np.log10((self.counts + 1) / self.base_total)
        self.other = np.where(np.arange(len(order)) < self.n_members, 0.0, np.log10((self.counts + 1) / self.other_total))

    @property
    def base_total(self) -> int:
        return self.tokens + self.distinct + 1

    @property
    def other_total(self) -> int:
        return self.other_tokens + self.other_distinct + 1


def rare_code(word: bytes) -> int:
    """The code of a word that is no member: a hash, so that it can stand before others."""
    return CLASSES * MEMBERS + crc32(word) % (BEGIN - CLASSES * MEMBERS)


def lexicon(table: DataFrame) -> Lexicon:
    """From a table of counts, reads the totals, and the at most HEAD words whose counts pass a threshold that a histogram gives, and the end."""
    tokens, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    step = F.floor(8 * F.log2("n")).cast("int")
    histogram = dict(table.groupBy(step.alias("step")).count().collect())  # a row for each eighth of a doubling
    least, words_above = None, 0
    for s in sorted(histogram, reverse=True):
        words_above += histogram[s]
        if words_above > HEAD:
            break
        least = s
    frequent = F.lit(False) if least is None else step >= least
    head = table.filter(frequent | (F.col("word") == F.lit(END))).select("word", "c").collect()
    return Lexicon(tokens, distinct, {bytes(r.word): r.c for r in head})


# Texts as codes

ENCODED = "doc_id long, held_out boolean, n_tokens long, known long, base double, other double, codes binary, tail array<binary>, times array<long>"


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text, held_out) to ENCODED: the codes of each text's tokens, sums over its tokens in the head, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, parts in chunks(batch.column(1)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *_encode(parts, j - i, shared.value)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, ENCODED)


_NAMES = ["doc_id", "held_out", "n_tokens", "known", "base", "other", "codes", "tail", "times"]


def _encode(parts: list[pa.Array], n: int, lex: Lexicon) -> list[pa.Array]:
    """The columns n_tokens to times of n texts; if they come in several parts, these are pieces of one text."""
    size = np.ones(n, np.int64)
    known = np.full(n, int(lex.counts[lex.end] > 0))
    base, other = np.full(n, lex.base[lex.end]), np.full(n, lex.other[lex.end])
    codes, owner, tail = [], [], []
    for part in parts:
        found, of = words(part)
        at = pc.index_in(found, value_set=lex.head).fill_null(-1).to_numpy()
        inside = at >= 0
        w, o = at[inside], of[inside]
        size += np.bincount(of, minlength=n)
        known += np.bincount(o[lex.counts.take(w) > 0], minlength=n)
        base += np.bincount(o, lex.base.take(w), n)
        other += np.bincount(o, lex.other.take(w), n)
        code = np.zeros(len(at), np.uint16)
        code[inside] = lex.codes.take(w)
        rare = found.filter(pa.array(~inside)).dictionary_encode()
        if len(rare):
            ix, of_rare = rare.indices.to_numpy().astype(np.int64), of[~inside]
            code[~inside] = np.array([rare_code(x) for x in rare.dictionary.to_pylist()], np.uint16)[ix]
            pairs, times = np.unique(of_rare * len(rare.dictionary) + ix, return_counts=True)
            tail.append((pairs // len(rare.dictionary), rare.dictionary.take(pa.array(pairs % len(rare.dictionary))), times))
        codes.append(code)
        owner.append(of)
    of = np.concatenate([*owner, np.zeros(0, np.int64)])
    code = np.insert(np.concatenate([*codes, np.zeros(0, np.uint16)]), np.searchsorted(of, np.arange(n), "right"), lex.codes[lex.end])
    ends = np.append(0, np.cumsum(size)) * 2
    # Pieces of one text may name a word twice; their numbers are added up later.
    cuts = np.searchsorted(np.concatenate([t[0] for t in tail] + [np.zeros(0, np.int64)]), np.arange(n + 1)).astype(np.int32)
    rest = pa.concat_arrays([t[1] for t in tail] + [pa.array([], pa.large_binary())]).cast(pa.binary())
    times = pa.array(np.concatenate([t[2] for t in tail] + [np.zeros(0, np.int64)]))
    return [
        pa.array(size), pa.array(known), pa.array(base), pa.array(other),
        pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(code)]).cast(pa.binary()),
        pa.ListArray.from_arrays(cuts, rest), pa.ListArray.from_arrays(cuts, times),
    ]


# The model


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Scrambled 32-bit values."""
    x = (x + np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def contexts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes (tokens, features) of what stands before each token, for texts end to end; starts holds each text's first token."""
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    before = []
    for back in (1, 2):
        at = np.arange(len(codes)) - back
        before.append(np.where(at >= first, codes[np.maximum(at, 0)], BEGIN).astype(np.uint32))
    a, b = before
    return np.stack([_mix(a, 1), _mix(a * np.uint32(65536) + b, 2), _mix(b, 3)], 1)


class Model:
    """Two tables of weight rows, and the biases of classes and members."""

    def __init__(self, lex: Lexicon) -> None:
        filled = np.zeros(CLASSES * MEMBERS)
        filled[: lex.n_members] = lex.counts[: lex.n_members]
        mass = np.append(filled.reshape(CLASSES, MEMBERS).sum(1), lex.other_total)
        # Places without a member have no probability.
        with np.errstate(divide="ignore"):
            self.classes = np.log(mass / mass.sum()).astype(np.float32)
            self.members = np.log(filled.reshape(CLASSES, MEMBERS)).astype(np.float32)
        self.members[mass[:-1] == 0] = 0
        self.tables = {"classes": np.zeros((ROWS, CLASSES + 1), np.float32), "members": np.zeros((ROWS, MEMBERS), np.float32)}

    def _softmax(self, table: str, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s = bias + self.tables[table].take(rows[:, 0], axis=0)
        for f in range(1, rows.shape[1]):
            s += self.tables[table].take(rows[:, f], axis=0)
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def of_classes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features, and probabilities (tokens, classes)."""
        rows = (hashes % np.uint32(ROWS)).astype(np.uint16)
        return rows, self._softmax("classes", self.classes, rows)

    def of_members(self, hashes: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features with the tokens' classes, and probabilities (tokens, members) inside these."""
        rows = (_mix(hashes ^ (cls.astype(np.uint32) << np.uint32(20))[:, None], 4) % np.uint32(ROWS)).astype(np.uint16)
        return rows, self._softmax("members", self.members.take(cls, axis=0), rows)

    def log10(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each text: of its members, and of the class of all other words where one stands."""
        hashes, out = contexts(codes, starts), np.zeros(len(codes))
        for i in range(0, len(codes), LOT):
            h, cls, place = hashes[i : i + LOT], *np.divmod(np.minimum(codes[i : i + LOT].astype(np.int64), CLASSES * MEMBERS), MEMBERS)
            lot = np.log10(self.of_classes(h)[1][np.arange(len(h)), cls].astype(np.float64) + 1e-30)
            at = np.flatnonzero(cls < CLASSES)
            lot[at] += np.log10(self.of_members(h[at], cls[at])[1][np.arange(len(at)), place[at]].astype(np.float64) + 1e-30)
            out[i : i + LOT] = lot
        return np.add.reduceat(out, starts)


class Trainer:
    """Sparse gradient steps on a copy of a model; steps of a weight row shrink with the squares of its gradients so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.start = {k: t.copy() for k, t in model.tables.items()}
        self.squares = {k: np.zeros(len(t), np.float32) for k, t in model.tables.items()}
        self.times = {k: np.zeros(len(t), np.float32) for k, t in model.tables.items()}

    def _step(self, table: str, rows: np.ndarray, errors: np.ndarray) -> None:
        """Follows the gradient of tokens with these feature rows and errors (probabilities less what stood there)."""
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        cuts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        n = np.diff(np.append(cuts, len(flat)))
        # Most rows occur once in a lot; only the others need sums.
        one, more = n == 1, n > 1
        self._move(table, flat[cuts[one]], errors.take(order[cuts[one]] // rows.shape[1], axis=0), n[one])
        if more.any():
            tokens = order[np.repeat(more, n)] // rows.shape[1]
            sums = np.add.reduceat(errors.take(tokens, axis=0), np.cumsum(n[more]) - n[more], axis=0)
            self._move(table, flat[cuts[more]], sums, n[more])

    def _move(self, table: str, at: np.ndarray, gradient: np.ndarray, n: np.ndarray) -> None:
        """Moves the weight rows at by their gradients, which sum up n tokens each."""
        squares = self.squares[table].take(at) + np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        self.squares[table][at] = squares
        gradient *= (RATE / np.sqrt(squares + 1e-4))[:, None]
        self.model.tables[table][at] = self.model.tables[table].take(at, axis=0) - gradient
        self.times[table][at] += n

    def learn(self, codes: np.ndarray, starts: np.ndarray) -> None:
        model, hashes = self.model, contexts(codes, starts)
        for i in range(0, len(codes), LOT):
            h, cls, place = hashes[i : i + LOT], *np.divmod(np.minimum(codes[i : i + LOT].astype(np.int64), CLASSES * MEMBERS), MEMBERS)
            at = np.flatnonzero(cls < CLASSES)
            for table, (rows, p), y in (("classes", model.of_classes(h), cls), ("members", model.of_members(h[at], cls[at]), place[at])):
                if len(y):
                    p[np.arange(len(y)), y] -= 1
                    self._step(table, rows, p)

    def changes(self) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(table, block, change times its number, numbers) of the blocks of weight rows that changed."""
        for k, t in self.model.tables.items():
            for b in range(0, len(t), BLOCK):
                times = self.times[k][b : b + BLOCK]
                if times.any():
                    yield k, b, (t - self.start[k])[b : b + BLOCK] * times[:, None], times


CHANGES = "part int, name string, block int, change binary, times binary"


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (from, to) of a batch with their codes end to end and where each text starts, for some MB at a time."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)
    for i, j in runs(offsets, SLICE):
        yield i, j, data[offsets[i] : offsets[j]].view(np.uint16), (offsets[i:j] - offsets[i]) // 2


def _learned(rows: DataFrame, model: Model) -> DataFrame:
    """What each task adds to the model on its share of rows (codes)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            if batch.num_rows:
                if trainer is None:
                    own = Model.__new__(Model)
                    own.__dict__ |= shared.value.__dict__ | {"tables": {k: t.copy() for k, t in shared.value.tables.items()}}
                    trainer = Trainer(own)
                for _, _, codes, starts in _texts(batch, "codes"):
                    trainer.learn(codes, starts)
        for k, b, change, times in trainer.changes() if trainer else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([k]), pa.array([b], pa.int32()), pa.array([change.astype(np.float32).tobytes()]), pa.array([times.tobytes()])],
                names=["part", "name", "block", "change", "times"],
            )

    return rows.select("codes").mapInArrow(run, CHANGES).withColumn("part", F.spark_partition_id())


def _summed(group: pa.Table) -> pa.Table:
    total = lambda name: sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) for v in group.column(name)).astype(np.float32).tobytes()
    first = group.slice(0, 1)
    return pa.table([first.column("part"), first.column("name"), first.column("block"), pa.array([total("change")]), pa.array([total("times")])], names=group.column_names)


def fit(rows: DataFrame, lex: Lexicon, tokens: int, scratch: Scratch) -> Model:
    """The model after ROUNDS rounds over rows (uid, codes), which hold so many tokens."""
    model = Model(lex)
    for r in range(ROUNDS):
        mine = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == r).select("codes")
        parts = max(1, -(-tokens // (ROUNDS * SHARE)))
        changes = scratch.written(_learned(mine.coalesce(parts), model), "changes")
        while True:
            most = changes.groupBy("name", "block").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
            if most <= 1:
                break
            by = F.floor(F.col("part") / WAYS).cast("int") if most > WAYS else F.lit(0)
            changes = scratch.written(
                changes.withColumn("part", by).groupBy("part", "name", "block").applyInArrow(_summed, CHANGES), "changes"
            )
        for x in changes.toLocalIterator():  # a row for each block of the model
            times = np.frombuffer(x.times, np.float32)[:, None]
            model.tables[x.name][x.block : x.block + len(times)] += np.frombuffer(x.change, np.float32).reshape(len(times), -1) / np.maximum(times, 1)
    scratch.drop("changes")
    return model


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) to SCHEMA; the rows that are not held out are what is learned from."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.written(counts(docs), "counts")
    lex = lexicon(table)
    rows = scratch.written(encoded(docs, lex).withColumn("uid", F.monotonically_increasing_id()), "encoded")
    model = fit(rows.filter(~F.col("held_out")), lex, lex.tokens, scratch) if lex.tokens else None
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, codes, starts in _texts(batch, "codes"):
                part = batch.slice(i, j - i).drop_columns(["codes"])
                s = np.zeros(j - i) if shared.value is None else shared.value.log10(codes, starts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "model"])

    kept = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, other double"
    scored = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "other", "codes").mapInArrow(run, f"{kept}, model double")
    # Words outside the head: each text's distinct ones meet the counts.
    pair = F.explode(F.arrays_zip("tail", "times")).alias("t")
    ones = rows.select("uid", pair).select("uid", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    c = F.col("c") + 1
    log = lambda total: F.sum(F.col("times") * F.log10(c / F.lit(float(total))))
    tails = ones.join(table.select("word", "c"), "word").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        log(lex.base_total).alias("tail_base"),
        log(lex.other_total).alias("tail_other"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    found = scored.join(tails, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "tail_known").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        plus("base", "tail_base").alias("base_score"),
        (F.col("model") + plus("other", "tail_other")).alias("score"),
    )
    result = scratch.written(found, "scores")
    scratch.keep_only("scores")
    return result
