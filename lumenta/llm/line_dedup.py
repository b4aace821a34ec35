"""Line dedup by overlapping three-line windows.

A line's key is the line without white space at its ends; blank lines take no part.  Three
consecutive lines of a document are a window.  A window whose keys also stand earlier
(smaller id, of one id or none another row, or the same document and an earlier line) covers its three lines; all covered
lines go.  Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_WHITE, Bytes, discard, durable, grams, row_keyed, signed, small_batches, table, text_slices

WINDOW = 3


def _worded_lines(text: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that are not blank: key start, key end, offsets by document; and all lines' first."""
    begin, end, first = text.lines()
    solid = np.flatnonzero(NOT_WHITE[text.data])
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = np.flatnonzero(b > a)
    return solid[a[full]], solid[b[full] - 1] + 1, np.searchsorted(full, first), first


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("_lm_doc").to_numpy(), batch.column("_lm_row").to_numpy()
            for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
                text = Bytes(data, offsets)
                start, end, first, _ = _worded_lines(text)
                whole, at = grams(text.hash(start, end), first, n)
                doc_of = np.repeat(np.arange(hi - lo), np.diff(first))[at]
                yield pa.RecordBatch.from_arrays([signed(whole), pa.array(ids[lo:hi][doc_of]), pa.array(rows[lo:hi][doc_of]), pa.array(at - first[doc_of])], names=["window", "doc", "row", "line"])

    return run


def _cut(n: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column(text_col), batch.column("_lm_hits")
            out = texts.to_pylist()
            lines, removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, offsets in text_slices(batch, text_col):
                text = Bytes(data, offsets)
                start, end, first, line_first = _worded_lines(text)
                lines[lo:hi] = np.diff(line_first)
                begin = None
                for i in range(lo, hi):
                    if not hits[i].is_valid:
                        continue
                    if begin is None:
                        begin, _, _ = text.lines()
                    at = np.unique(np.add.outer(np.array(hits[i].as_py(), np.int64), np.arange(n)).ravel())
                    drop = np.searchsorted(begin, start[first[i - lo] + at], side="right") - 1 - line_first[i - lo]
                    kept = np.delete(np.array(out[i].split("\n"), dtype=object), drop)
                    out[i] = "\n".join(kept)
                    removed[i] = len(drop)
            columns = [batch.column(c) if c != text_col else pa.array(out, texts.type) for c in batch.schema.names if c not in ("_lm_hits", "_lm_doc", "_lm_row")]
            names = [c for c in batch.schema.names if c not in ("_lm_hits", "_lm_doc", "_lm_row")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(removed)], names=[*names, "_lm_lines", "_lm_removed"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """docs with the text cut, and _lm_lines (lines before) and _lm_removed added.

    A null text stays null and has one (empty) line; a text whose lines all go becomes
    empty; a text of any length is cut whole, in one task.  No rows give no rows.  Extra
    columns are kept, but for names that begin with _lm_, which the operator uses.  Rows that repeat an id and text are the same document: one row does not remove
    another's lines.  Rows that repeat an id with other text are documents of their own, in
    the order of a hash; so is each row without an id, and those sort last.
    """
    small_batches(docs.sparkSession)
    keyed = row_keyed(docs, id_col, text_col, "line-rows")
    base = keyed.select("_lm_doc", "_lm_row", F.col(text_col).alias("_lm_text"))
    windows = durable(base.mapInArrow(_windows(n), "window long, doc long, row long, line long"), "line-windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "row", "line")).alias("first"), F.count(F.lit(1)).alias("found")).filter("found > 1").select("window", "first")
    first = durable(first, "line-first")  # with an exchange on either side, hot windows are split when joined
    later = windows.join(first.hint("merge"), "window").filter("doc != first.doc or row != first.row or line != first.line")
    hits = durable(later.groupBy(F.col("doc").alias("_lm_doc"), F.col("row").alias("_lm_row")).agg(F.collect_set("line").alias("_lm_hits")), "line-hits")
    discard(windows, first)
    whole = keyed.join(hits.hint("merge"), ["_lm_doc", "_lm_row"], "left")
    schema = T.StructType([*docs.schema.fields, T.StructField("_lm_lines", T.LongType()), T.StructField("_lm_removed", T.LongType())])
    order = [F.col(f"`{c}`") for c in docs.columns]
    return whole.select(*order, "_lm_doc", "_lm_row", "_lm_hits").mapInArrow(_cut(n, text_col), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("_lm_lines").alias("n_lines"), F.col("_lm_removed").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
w AS (
  SELECT doc_id, pos, key, lead(key, 1) OVER d AS k2, lead(key, 2) OVER d AS k3,
         lead(pos, 1) OVER d AS p2, lead(pos, 2) OVER d AS p3
  FROM k WHERE key <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (
  SELECT doc_id, pos, p2, p3, row_number() OVER (PARTITION BY key, k2, k3 ORDER BY doc_id, pos) AS rn
  FROM w WHERE k3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, p2, p3]) AS pos FROM r WHERE rn > 1)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""
