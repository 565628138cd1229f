"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` UTF-8 bytes in both directions, labels every byte, and a
document's probabilities are the means over all bytes of its whole text. It is trained in numpy by
backpropagation through time on a bounded sample: at most ``SAMPLE`` labelled documents, those with
the least hashes within their language, with ``PER_DOCUMENT`` windows of each, taken at places that a
hash of the document's id chooses. Predicting runs in Arrow tasks over all bytes.

A hash threshold, from the counts of each language's documents, lets about twice the sample pass before
anything is ranked or moved; an id with several texts gives one of them. Labels are assumed to be few, as languages are.

``und`` with score 0 is predicted for null or empty texts and those without a letter, and everywhere
if no labelled text exists. Ties go to the first language in order. Repeated rows are predicted alike;
further columns are ignored; an empty table gives no rows. Ids are whole numbers, and a null one is learned
from and predicted like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.llm.text import runs, strings

WINDOW, HIDDEN = 96, 8
SAMPLE, PER_DOCUMENT = 1600, 2
EPOCHS, LOT, RATE = 8, 128, 0.02
SLICE = 1 << 19
PAD = 256  # a byte value that stands for no byte


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters: for each direction byte table E (257 x 3h: update, reset, candidate) and recurrence U (h x 3h); output W, c."""

    def __init__(self, labels: list[str], seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        normal = lambda *shape, s: (rng.normal(size=shape) * s).astype(np.float32)
        self.p = {f"E{d}": normal(257, 3 * HIDDEN, s=0.3) for d in "fb"} | {f"U{d}": normal(HIDDEN, 3 * HIDDEN, s=0.3) for d in "fb"}
        self.p |= {"W": normal(2 * HIDDEN, len(labels), s=0.3), "c": np.zeros(len(labels), np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, rows, h) of one direction for x (rows, time); padding leaves the state as it is."""
        n, steps = x.shape
        e, u = self.p["E" + d], self.p["U" + d]
        h, out, trace = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = e[x[:, t]]
            g = _sigmoid(a[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            rh = r * h
            q = np.tanh(a[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
            new = h + z * (q - h)
            if keep:
                trace.append((t, h, z, r, rh, q))
            if (x[:, t] == PAD).any():
                new = np.where((x[:, t] == PAD)[:, None], h, new)
            h = out[t] = new
        return out, trace

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, rows, labels) of every byte of the windows x (rows, time)."""
        s = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], 2) @ self.p["W"] + self.p["c"]
        s = np.exp(s - s.max(-1, keepdims=True))
        return s / s.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean cross entropy over bytes) and gradients by backpropagation through time."""
        hf, tf = self._run(x, "f", True)
        hb, tb = self._run(x, "b", True)
        h = np.concatenate([hf, hb], 2)
        s = h @ self.p["W"] + self.p["c"]
        s = np.exp(s - s.max(-1, keepdims=True))
        s /= s.sum(-1, keepdims=True)
        real = (x.T != PAD)[:, :, None].astype(np.float32)
        total = max(float(real.sum()), 1.0)
        rows = np.arange(len(y))
        loss = -float((np.log(s[:, rows, y] + 1e-9) * real[:, :, 0]).sum() / total)
        ds = s
        ds[:, rows, y] -= 1
        ds *= real / total
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["W"], grad["c"] = np.tensordot(h, ds, ((0, 1), (0, 1))), ds.sum((0, 1))
        dh_all = ds @ self.p["W"].T
        for d, trace, part in (("f", tf, dh_all[:, :, :HIDDEN]), ("b", tb, dh_all[:, :, HIDDEN:])):
            u, du, de = self.p["U" + d], grad["U" + d], grad["E" + d]
            carry = np.zeros((len(y), HIDDEN), np.float32)
            for t, h0, z, r, rh, q in reversed(trace):
                dh = carry + part[t]
                pad = (x[:, t] == PAD)[:, None]
                live = np.where(pad, 0, dh)
                dz = live * (q - h0) * z * (1 - z)
                dq = live * z * (1 - q * q)
                drh = dq @ u[:, 2 * HIDDEN :].T
                dr = drh * h0 * r * (1 - r)
                da = np.concatenate([dz, dr, dq], 1)
                du[:, : 2 * HIDDEN] += h0.T @ da[:, : 2 * HIDDEN]
                du[:, 2 * HIDDEN :] += rh.T @ dq
                np.add.at(de, x[:, t], da)
                carry = live * (1 - z) + drh * r + da[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T + np.where(pad, dh, 0)
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 8) -> None:
        """Adam over lots of windows."""
        rng = np.random.default_rng(seed)
        m, v, k = {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), LOT):
                at = order[i : i + LOT]
                _, grad = self.gradients(x[at], y[at])
                k += 1
                rate = RATE * (1 - 0.8 * epoch / epochs)
                for n, g in grad.items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    self.p[n] -= (rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (texts, labels) over all bytes of texts that lie end to end in data."""
        size = np.diff(offsets)
        per = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(size)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = offsets[:-1][owner] + within * WINDOW
        length = np.minimum(WINDOW, offsets[1:][owner] - start)
        out = np.zeros((len(size), len(self.labels)))
        order = np.argsort(length == WINDOW, kind="stable")  # windows that are cut short come together
        for i in range(0, len(order), 4096):
            w = order[i : i + 4096]
            at = start[w][:, None] + np.arange(WINDOW)
            real = np.arange(WINDOW) < length[w][:, None]
            x = np.where(real, data[np.minimum(at, len(data) - 1)], PAD)
            p = self.positions(x)
            sums = p.sum(0) if real.all() else (p * real.T[:, :, None]).sum(0)
            np.add.at(out, owner[w], sums)
        return out / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, train, label_col: str = "lang") -> DataFrame:
    """At most SAMPLE labelled documents, as many of each language as of any where there are enough: y, and windows of bytes."""
    known = docs.filter(train & F.col(label_col).isNotNull() & (F.length("text") > 0)).select(F.col(label_col).alias("y"), "doc_id", "text")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    each = max(1, SAMPLE // max(len(counts), 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # Twice what is wanted, and some more, so that each language has enough in all likelihood.
    shares = [x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1 << 40, ((2 * each + 60) << 40) // max(n, 1))))]
    below = F.create_map(*shares)[F.col("y")] if shares else F.lit(0)
    raw = F.encode("text", "UTF-8")
    places = F.array(*[
        F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1))).cast("int") for i in range(PER_DOCUMENT)
    ])
    cut = known.filter(place <= below).select(
        "y", "doc_id", F.transform(places, lambda p: F.substr(raw, p + 1, F.lit(WINDOW))).alias("windows")
    )
    one = cut.groupBy("y", "doc_id").agg(F.min("windows").alias("windows"))
    rank = Window.partitionBy("y").orderBy(place, "doc_id")
    return one.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= each).orderBy("y", "rank").select("y", "windows")


def fit(docs: DataFrame, train, label_col: str = "lang") -> Network | None:
    rows = sample(docs, train, label_col).collect()
    if not rows:
        return None
    labels = sorted({r.y for r in rows})
    windows = [(labels.index(r.y), w) for r in rows for w in dict.fromkeys(map(bytes, r.windows))]
    x = np.full((len(windows), WINDOW), PAD, np.int64)
    for row, (_, w) in zip(x, windows):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    net = Network(labels)
    net.train(x, np.array([y for y, _ in windows]))
    return net


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (doc_id, text, held_out) to SCHEMA."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            data, offsets = strings(batch, "text")
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for i, j in runs(offsets, SLICE):
                pred, score = np.full(j - i, "und", object), np.zeros(j - i)
                if net is not None and offsets[j] > offsets[i]:
                    p = net.documents(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best, ok = p.argmax(1), letters[i:j]
                    pred[ok] = np.array(net.labels, object)[best[ok]]
                    score[ok] = np.clip(p.max(1)[ok], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(pred, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", "held_out", has_letter.alias("letters")).mapInArrow(run, SCHEMA)
