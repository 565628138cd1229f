"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and a word, as regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240101)
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only where Spark runs inside one machine's process (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if not folder and known.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return folder or known.get()


class Scratch:
    """An operator's tables between steps: Parquet in the shared folder, from which later steps start.

    Writing a name again deletes that name's table before, once the new one is complete.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables, which nothing may read any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if name in self.paths:
                path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(conf).delete(path, True)

    def keep_only(self, *names: str) -> None:
        self.drop(*(n for n in list(self.paths) if n not in names))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again; the table stays."""
    return Scratch(df.sparkSession).written(df, name)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def strings(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (one more than rows); null is empty."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Powers:
    """base**i and base**-i modulo 2**64 for i below what was asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_BASE_INVERSE, k, 1 << 64))])


POWERS = Powers()


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of texts that lie end to end in data.

    starts holds each text's first byte and the end. Returns the hashes and each word's text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    POWERS.upto(n + 1)
    word = ~_IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = np.unique(starts[(starts > 0) & (starts < n)])
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    sums = np.cumsum(_BYTE_VALUES[_LOWER[data]] * POWERS.up[:n], dtype=np.uint64)
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    before = np.where(a > 0, sums[a - 1], _U(0))
    hashes = mixed((sums[z] - before) * POWERS.down[a])
    return hashes, np.searchsorted(starts, a, "right") - 1


def shingle_hashes(hashes: np.ndarray, of: np.ndarray, k: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles with each one's text, in order of texts.

    A text of 1 to k-1 words has its whole sequence as its one shingle; one without words has none.
    """
    n = len(hashes)
    count = np.bincount(of, minlength=n_texts)
    start = np.concatenate([[0], np.cumsum(count)])[:-1]
    out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s += hashes[j : n - k + 1 + j] * _PLACE[j]
        same = of[: n - k + 1] == of[k - 1 :]
        out, owner = mixed(s[same]), of[: n - k + 1][same]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            at = np.minimum(start[short] + j, n - 1)
            s += np.where(j < count[short], hashes[at] * _PLACE[j], _U(0))
        s = mixed(s + _PLACE[-1] * count[short].astype(np.uint64))
        out, owner = np.concatenate([out, s]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
