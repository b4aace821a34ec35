"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; the masked words' hash ignores the other
positions, so a seed survives substitutions there.  The seeds of all test items are joined
with the seeds of all documents; a hit names a document, an item and a diagonal.  The
diagonal is verified word by word: the stretch with the most agreeing words, of those that
agree in three of four words, must be long enough.

Documents give only seeds that some item has, with the words around them as far as an item
could reach; a table of the items' seeds says which.  It is broadcast up to a size; beyond
that documents give all their seeds and the join alone decides, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, NULL_ID, Bytes, doc_key, durable, from_key, mix, row_keyed, small_batches, table, text_slices

#: Weight five each: five words in a row, and three masks that ignore some.
MASKS = ("11111", "1101011", "11100101", "110010101")
#: For items of so few words that these could miss one substitution: weight three and four.
SHORT, SHORT_MASKS = 12, ("111", "1011", "1101", "11011")
#: A stretch counts if it agrees in so many words, or in three quarters of a shorter item.
MIN_WORDS = 13
#: Items of fewer words overlap with nothing.
LEAST_WORDS = 5
#: Different seeds of the items that are broadcast (24 bytes each).
BROADCAST_SEEDS = 2_000_000
_FILTER_BITS = 22


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = Bytes(data, offsets, fold_case=True)
    starts, ends, first = text.words(ALNUM)
    return text.hash(starts, ends), first


def seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the mask at every place where it fits into a document."""
    span, total = len(mask), len(words)
    if total < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(total - span + 1, int(mask, 2), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out + words[k : total - span + 1 + k]) * factor
            out ^= out >> np.uint64(29)
    keep = np.ones(len(out), bool)
    for k in range(1, span):
        bad = first[1:-1] - k
        keep[bad[(bad >= 0) & (bad < len(out))]] = False
    at = np.flatnonzero(keep)
    return mix(out[at]), at


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, _lm_text) to (item, n, words): the words' hashes."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
            words, first = _hash_words(data, offsets)
            own = [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(own, pa.binary())], names=["item", "n", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, n, words) to (seed, item, n, place)."""
    for batch in batches:
        keys, rows, places = [], [], []
        for i, raw in enumerate(batch.column("words").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            for mask in MASKS if len(own) > SHORT else MASKS + SHORT_MASKS:
                key, at = seeds(own, np.array([0, len(own)]), mask)
                keys.append(key)
                rows.append(np.full(len(at), i))
                places.append(at)
        if keys:
            row = np.concatenate(rows)
            item, n = (batch.column(c).to_numpy()[row] for c in ("item", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(item), pa.array(n), pa.array(np.concatenate(places))], names=["seed", "item", "n", "place"])


class Known:
    """The items' seeds, and how many words before and after one an item can have."""

    def __init__(self, seed: np.ndarray, before: np.ndarray, after: np.ndarray):
        order = np.argsort(seed)
        self.seed, self.before, self.after = seed[order], before[order], after[order]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.seed & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of key is known, its place here)."""
        maybe = np.flatnonzero(self.bits[key & np.uint64((1 << _FILTER_BITS) - 1)])
        if not len(maybe) or not len(self.seed):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.seed, key[maybe]), len(self.seed) - 1)
        same = self.seed[at] == key[maybe]
        return maybe[same], at[same]


def _pieces(known, short: bool):
    """Rows (doc, row, _lm_text) to pieces of documents with the seeds in them that items have.
    A piece's words reach as far as the items could; without a table it is the whole document."""
    masks = MASKS + SHORT_MASKS if short else MASKS
    kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: Known | None = known.value if known is not None else None
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch, "_lm_text"):
                words, first = _hash_words(data, offsets)
                keys, ats, begins, ends = [], [], [], []
                for mask in masks:
                    key, at = seeds(words, first, mask)
                    if listed is not None:
                        which, where = listed.find(key)
                        key, at = key[which], at[which]
                        begins.append(at - listed.before[where])
                        ends.append(at + listed.after[where])
                    else:
                        begins.append(np.zeros(len(at), np.int64))
                        ends.append(np.full(len(at), len(words)))
                    keys.append(key)
                    ats.append(at)
                at = np.concatenate(ats)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, key = at[order], np.concatenate(keys)[order]
                doc = np.searchsorted(first, at, side="right") - 1
                begin = np.maximum(np.concatenate(begins)[order], first[doc])
                end = np.minimum(np.concatenate(ends)[order], first[doc + 1])
                # stretches of a document that touch are one piece
                begin = np.minimum.accumulate(begin[::-1])[::-1]
                new = np.flatnonzero(np.r_[True, (begin[1:] > np.maximum.accumulate(end)[:-1]) | (doc[1:] != doc[:-1])])
                stop = np.maximum.reduceat(end, new)
                edges = np.r_[new, len(at)]
                held = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(at - np.repeat(begin[new], np.diff(edges)))], names=["seed", "at"])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), held).cast(kind)
                own = [words[a:b].tobytes() for a, b in zip(begin[new].tolist(), stop.tolist(), strict=True)]
                where = pa.array(lo + doc[new])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(where), batch.column("row").take(where), pa.array(begin[new] - first[doc[new]]), pa.array(own, pa.binary()), lists], names=["doc", "row", "begin", "piece", "seeds"]
                )

    return run


def best(own: np.ndarray, words: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(agreeing words, start, end in words) of an item's best stretch on a diagonal, if it counts."""
    lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
    same = own[lo:hi] == words[lo + diagonal : hi + diagonal]
    # a stretch agrees in three of four words if its score, +1 or -3 a word, is not negative;
    # for each end the longest one starts where the running minimum first is as low
    score = np.r_[0, np.cumsum(np.where(same, 1, -3))]
    begin = np.searchsorted(-np.minimum.accumulate(score), -score, side="left")
    agree = np.r_[0, np.cumsum(same)]
    end = int(np.argmax(agree - agree[begin]))
    start = int(begin[end])
    matched = int(agree[end] - agree[start])
    if not matched or matched < min(MIN_WORDS, -(-len(own) * 3 // 4)):
        return None
    inside = np.flatnonzero(same[start:end])
    start, end = start + int(inside[0]), start + int(inside[-1]) + 1
    return matched, lo + diagonal + start, lo + diagonal + end


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, begin, piece, item, n, words, diagonals) to (doc, row, item, n, matched, start, end)."""
    names = ["doc", "row", "item", "n", "matched", "start", "end"]
    for batch in batches:
        rows = []
        for doc, row, begin, piece, item, n, own, diagonals in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "begin", "piece", "item", "n", "words", "diagonals")), strict=True):
            words, own = np.frombuffer(piece, np.uint64), np.frombuffer(own, np.uint64)
            got = [g for g in (best(own, words, d) for d in diagonals) if g]
            if got:
                matched, start, end = max(got, key=lambda g: (g[0], -g[1], -g[2]))
                rows.append((doc, row, item, n, matched, begin + start, begin + end))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _overlaps(base: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(doc, row, item, n, matched, start, end) of rows (doc, row, _lm_text); items with equal
    words are one, that of the smallest id."""
    spark = base.sparkSession
    small_batches(spark)
    items = benchmark.select(doc_key(item_col).alias("item"), F.col(item_text).alias("_lm_text")).mapInArrow(_item_words, "item long, n long, words binary")
    items = items.filter(F.col("n") >= LEAST_WORDS).groupBy(F.xxhash64("words").alias("key")).agg(F.min("item").alias("id"), F.first("n").alias("n"), F.first("words").alias("words"))
    keyed = items.select(F.col("key").alias("item"), "n", "words")
    held = keyed.mapInArrow(_item_seeds, "seed long, item long, n long, place long")
    reach = held.groupBy("seed").agg(F.max("place").alias("before"), F.max(F.col("n") - F.col("place")).alias("after"))
    size = items.agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).first()
    short, most = (size[2] or 0) <= SHORT, (size[1] or 0) * len(MASKS + SHORT_MASKS)  # seeds are fewer than this
    known = None
    if most <= BROADCAST_SEEDS or reach.count() <= BROADCAST_SEEDS:
        got = reach.toArrow()
        seed, before, after = (got.column(c).to_numpy() for c in ("seed", "before", "after"))
        known = spark.sparkContext.broadcast(Known(seed.view(np.uint64), before, after))
    pieces = base.mapInArrow(_pieces(known, short), "doc long, row long, begin long, piece binary, seeds array<struct<seed: long, at: long>>")
    pieces = durable(pieces, "leak-pieces")
    hits = pieces.select("doc", "row", "begin", F.explode("seeds").alias("s")).select("doc", "row", "begin", "s.seed", "s.at").join(held, "seed")
    hits = hits.groupBy("doc", "row", "begin", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    found = hits.join(pieces.drop("seeds"), ["doc", "row", "begin"]).join(items.select(F.col("key").alias("item"), "id", "n", "words"), "item")
    return found.drop("item").withColumnRenamed("id", "item").mapInArrow(_verified, "doc long, row long, item long, n long, matched long, start long, end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document that overlaps with an item: doc_id, n_items (different items it
    overlaps with), and of the best of them item_id, item_words, matched, start and end (words of the best
    stretch in the document) and similarity.  The best has the most agreeing words, then the
    smallest id.

    Words are runs of letters and digits after folding A-Z.  Null or empty texts overlap
    with nothing, nor do items under five words; items with equal words count as one, that of
    the smallest id.  A text of any length is searched whole.  Rows that repeat an id and text
    are one document; rows that repeat an id with other text are documents of their own, and so is each
    row without an id.  A null id, of a document or an item, stays null and sorts last.  No rows
    on either side give no rows.  Other columns are not read, whatever their names.
    """
    keyed = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_lm_text")), "doc_id", "_lm_text", "leak-rows")
    found = _overlaps(keyed.select(F.col("_lm_doc").alias("doc"), F.col("_lm_row").alias("row"), "_lm_text"), benchmark, item_col, item_text)
    order = F.struct("matched", -F.col("item"), -F.col("start"), -F.col("end"), "n")
    out = found.groupBy("doc", "row").agg(F.count_distinct("item").alias("n_items"), F.max(order).alias("b"))
    return out.select(
        from_key("doc").alias("doc_id"), "n_items", F.when(F.col("b.col2") != -NULL_ID, -F.col("b.col2")).alias("item_id"), F.col("b.n").alias("item_words"), F.col("b.matched").alias("matched"),
        (-F.col("b.col3")).alias("start"), (-F.col("b.col4")).alias("end"), (F.col("b.matched") / F.col("b.n")).alias("similarity"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows, with its own columns only.

    Each row is judged by its own text: rows without an id, or with the id of a row that
    overlaps, stay if their text overlaps with no item.  Other cases as in contaminated.
    """
    keyed = row_keyed(docs, id_col, text_col, "clean-rows")
    found = _overlaps(keyed.select(F.col("_lm_doc").alias("doc"), F.col("_lm_row").alias("row"), F.col(text_col).alias("_lm_text")), benchmark, "item_id", "text")
    # written, so that Spark knows its size and need not shuffle the documents where it is small
    gone = durable(found.select(F.col("doc").alias("_lm_doc"), F.col("row").alias("_lm_row")).distinct(), "leak-documents")
    return keyed.join(gone, ["_lm_doc", "_lm_row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
