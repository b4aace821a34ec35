"""Session helpers and the vectorised byte kernel shared by the operators.

The kernel works on the concatenated UTF-8 bytes of a bounded slice of an Arrow
batch.  Every hash is a polynomial over the ring of 64-bit integers, taken from
one running sum, so the hash of any byte range costs two look-ups.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call looks at; a longer document is taken alone.
SLICE_BYTES = 1 << 18
#: Stands for a null document id inside operators; sorts after every other id.
NULL_ID = 2**63 - 1

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a local master gets a temporary folder; a cluster must set it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lumenta-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost
    executor costs its own tasks only.  The shuffle files behind it go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lm_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that durable() wrote and nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hold few texts at once between the JVM and Python; texts can be long.  Results are lazy, so
    the setting stays with the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def row_keyed(docs: DataFrame, id_col: str, text_col: str, tag: str) -> DataFrame:
    """docs with _lm_doc and _lm_row added, which together name a document.

    Rows with an id are one document if their texts agree too (_lm_row is a hash of the
    text).  A row without an id is a document of its own: _lm_row is its number, written with
    the row so that it does not change when the table is read again.
    """
    known = docs.filter(F.col(id_col).isNotNull()).withColumn("_lm_row", F.xxhash64(text_col))
    unknown = durable(docs.filter(F.col(id_col).isNull()).withColumn("_lm_row", F.monotonically_increasing_id()), tag)
    return known.unionByName(unknown).withColumn("_lm_doc", doc_key(id_col))


def from_key(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


# ---------------------------------------------------------------- byte kernel

_MULT = 0x9E3779B97F4A7C15 | 5  # 5 modulo 8: the powers have the longest period
_MASK = (1 << 64) - 1
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, SLICE_BYTES) + 1
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        _powers["n"] = n - 1
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Bytes:
    """A run of documents as one byte array with document offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False):
        self.offsets = offsets
        self.raw = data
        if fold_case:
            data = _FOLD[data]
        self.data = data
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            _, down = _power_tables(n)
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.data] * down[:n], out=sums[1:])
            self._sums = sums
        return self._sums

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte range [start, end)."""
        up, _ = _power_tables(len(self.data))
        sums = self.sums()
        return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of mask each document has."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.offsets])

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes in is_word, and where each
        document's words begin in them (one entry more than documents)."""
        inside = is_word[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between newlines, as words(); an empty
        document has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        doc_of = np.searchsorted(self.offsets, breaks, side="right") - 1
        n_docs = len(self.offsets) - 1
        per_doc = np.bincount(doc_of, minlength=n_docs) + 1 if n_docs else np.zeros(0, np.int64)
        first = np.zeros(n_docs + 1, np.int64)
        np.cumsum(per_doc, out=first[1:])
        starts = np.empty(first[-1], np.int64)
        ends = np.empty(first[-1], np.int64)
        at = np.ones(first[-1], bool)
        at[first[:-1]] = False
        starts[first[:-1]] = self.offsets[:-1]
        starts[at] = breaks + 1
        at[:] = True
        at[first[1:] - 1] = False
        ends[first[1:] - 1] = self.offsets[1:]
        ends[at] = breaks
        return starts, ends, first


def lookup(chars: bytes, inverse: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if inverse else out


NOT_WHITE = lookup(WHITE, inverse=True)
#: Letters and digits after case folding, and everything beyond ASCII.
ALNUM = lookup(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def grams(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word grams and the index of each gram's first word.  Grams stay in
    one document; first holds the documents' word offsets."""
    total = len(word_hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
        out += word_hash[k : total - n + 1 + k] * np.uint64(factor)
    keep = np.ones(total - n + 1, bool)
    for k in range(1, n):
        bad = first[1:-1] - k
        keep[bad[(bad >= 0) & (bad <= total - n)]] = False
    at = np.flatnonzero(keep)
    return mix(out[at]), at


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of bounded slices of a batch; null is empty."""
    values = batch.column(column)
    if not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, values.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
