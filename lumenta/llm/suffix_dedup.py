"""Repeated-substring dedup over whole byte strings, by anchor fingerprints.

The method named for this operator merges the Burrows-Wheeler transforms of shards by
refining their interleave.  interleave.py does that, and its figures are beyond the budget
(README), so this operator finds the same repeated intervals in another way.  It builds no
transform and no suffix array:

* Parse.  A window is the string of LENGTH bytes at a position.  The smallest-hash gram of
  a window is its anchor; consecutive windows with one anchor form a phrase, so phrases
  overlap and each is at least LENGTH bytes long.  Equal windows have equal anchor grams.
* Settle.  Strings are sorted by their key (of phrases, the anchor gram) and a fingerprint of
  the whole.  A string that is not the first of its equals repeats in every window.  The first
  of strings that share a key with other strings stay open.
* Split.  Open strings are cut into ranges of fewer windows, which share a longer context: a
  range of w windows has LENGTH - w + 1 bytes in common, which is its key.  The last ranges
  have one window, whose key is the window itself, so none stays open.

The removed bytes are the union of the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, discard, durable, from_key, mix, row_keyed, small_batches, table, text_slices

LENGTH = 100
GRAM = 32
#: Windows that one kernel call looks at; a longer document is taken in pieces.
CHUNK = 1 << 20
_POSITION_BITS = 24
#: A string of windows is packed as (start * SIDE + anchor - start) * SIDE + windows.
SIDE = 128
PACK = SIDE * SIDE
#: Windows in a range, by round.
RANGES = (18, 1)
#: Strings of a task that are compared before they are dealt to others.
TOGETHER = 400_000
NAMES = ["key", "body", "doc", "row", "place", "parent", "stop"]


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, int, Bytes]]:
    """(first row, end row, position of the first byte, bytes); no window is lost between
    the pieces of a long document."""
    for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
        if hi - lo > 1 or len(data) <= CHUNK + length - 1:
            yield lo, hi, 0, Bytes(data, offsets)
            continue
        for at in range(0, max(1, len(data) - length + 1), CHUNK):
            part = data[at : at + CHUNK + length - 1]
            yield lo, hi, at, Bytes(part, np.array([0, len(part)], np.int64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(text: Bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, windows, anchor) of each phrase."""
    n = len(text.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    at = np.arange(n - gram + 1)
    hashed = text.hash(at, at + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    anchor = (_sliding_min(hashed & ~low | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    room = np.zeros(n + 1, np.int64)  # windows end inside their document
    sizes = np.diff(text.offsets)
    fits = np.flatnonzero(sizes >= length)
    room[text.offsets[fits]] += 1
    np.add.at(room, text.offsets[fits + 1] - length + 1, -1)
    valid = np.cumsum(room)[: len(anchor)] > 0
    before = np.zeros(len(valid), bool)
    before[1:] = valid[:-1] & (anchor[1:] == anchor[:-1])
    start = np.flatnonzero(valid & ~before)
    # a phrase ends before the next start, or where windows stop fitting
    doc = np.searchsorted(text.offsets, start, side="right") - 1
    end = np.minimum(np.r_[start[1:], len(valid)], text.offsets[doc + 1] - length + 1)
    return doc, start, end - start, anchor[start]


def spans_of(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal runs, where row is one of those with the run's doc."""
    if not len(doc):
        return np.zeros(0, np.int64), start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = np.cumsum(np.r_[False, doc[1:] != doc[:-1]]) << np.int64(40)  # a text has fewer bytes
    reach = np.maximum.accumulate(stop + base)
    new = np.flatnonzero(np.r_[True, (start + base)[1:] > reach[:-1]])
    return order[new], start[new], (reach - base)[np.r_[new[1:], len(doc)] - 1]


def _reduced(parts: Iterator[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    """Strings (key, body, doc, row, place, parent) without those that repeat among the many
    taken together; these become spans, with a stop, and a key of their own that deals them
    anywhere."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, body, doc, row, place, parent = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((place, row, doc, body, key))
        same = (key[order][1:] == key[order][:-1]) & (body[order][1:] == body[order][:-1])
        first, again = order[np.r_[True, ~same]], order[1:][same]
        own = np.unique(np.stack([doc[again], row[again]]), axis=1, return_inverse=True)[1].ravel() if len(again) else again
        start = place[again] // PACK
        at, start, stop = spans_of(own, start, start + place[again] % SIDE + length - 1)
        at = again[at]
        spread = mix((doc[at] ^ row[at]).view(np.uint64) + start.view(np.uint64)).view(np.int64)
        columns = [
            np.r_[key[first], spread], np.r_[body[first], spread], np.r_[doc[first], doc[at]], np.r_[row[first], row[at]],
            np.r_[place[first], start], np.r_[parent[first], np.zeros(len(at), np.int64)], np.r_[np.zeros(len(first), np.int64), stop],
        ]
        for k in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in columns], names=NAMES)

    for part in parts:
        if not len(part[0]):
            continue
        held.append(part)
        if sum(len(p[0]) for p in held) >= TOGETHER:
            yield from flush()
    if held:
        yield from flush()


def _phrases(length: int, gram: int):
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for lo, hi, base, text in _pieces(batch, length):
                doc, start, windows, anchor = phrases(text, length, gram)
                key = text.hash(anchor, anchor + gram).view(np.int64)
                body = text.hash(start, start + windows + (length - 1)).view(np.int64)
                place = ((start - text.offsets[doc] + base) * SIDE + anchor - start) * SIDE + windows
                yield key, body, ids[lo:hi][doc], rows[lo:hi][doc], place, np.zeros(len(doc), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _reduced(parsed(batches), length)

    return run


def _settled(length: int):
    """Strings sorted by key, body and place to what repeats, as spans (doc, row, start, stop),
    and what stays open, with its place in start and a stop of 0.  The keys at the ends of a
    task may go on in another and stay open; so a key of any number of strings can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mixed, pending = None, False, None
        for batch in batches:
            key, body, doc, row, place, parent, stop = (batch.column(c).to_numpy() for c in NAMES)
            sure, left = stop > 0, []
            spans = [(doc[sure], row[sure], place[sure], stop[sure])]
            key, body, doc, row, place, parent = (c[~sure] for c in (key, body, doc, row, place, parent))
            n = len(key)
            if n:
                go_on = last is not None and key[0] == last[0]
                new_key = np.r_[not go_on, key[1:] != key[:-1]]
                new = new_key | np.r_[not go_on or body[0] != last[1], body[1:] != body[:-1]]
                again = ~new
                spans.append((doc[again], row[again], place[again] // PACK, place[again] // PACK + place[again] % SIDE + length - 1))
                # which of the first strings share their key with another one
                group = np.cumsum(new_key) - (not go_on)
                bodies = np.bincount(group, weights=new).astype(np.int64)
                shared = bodies > 1
                if go_on:
                    shared[0] = mixed or bodies[0] > 0
                elif last is None:
                    shared[0] = True  # it may have begun in another task
                rows = (doc, row, place, parent)
                opened = new & shared[group]
                left.append(tuple(c[opened] for c in rows))
                if pending is not None and go_on and shared[0]:
                    left.append(pending)
                if pending is not None and (not go_on or shared[0] or group[-1] > 0):
                    pending = None
                if not shared[-1] and bodies[-1]:
                    pending = tuple(c[new & (group == group[-1])] for c in rows)
                mixed, last = bool(shared[-1]), (key[-1], body[-1])
            own = [np.concatenate(c) for c in zip(*spans, strict=True)]
            if len(own[0]):
                which = np.unique(np.stack(own[:2]), axis=1, return_inverse=True)[1].ravel()
                at, start, end = spans_of(which, own[2], own[3])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[0][at], own[1][at], start, np.zeros(len(at), np.int64), end)], names=["doc", "row", "start", "parent", "stop"])
            if left and sum(len(x[0]) for x in left):
                got = [np.concatenate(c) for c in zip(*left, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*got, np.zeros(len(got[0]), np.int64))], names=["doc", "row", "start", "parent", "stop"])
        if pending is not None:  # its key may go on in the next task
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*pending, np.zeros(len(pending[0]), np.int64))], names=["doc", "row", "start", "parent", "stop"])

    return run


def _strings(length: int):
    """The bytes of the places that each document's row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, places = batch.column("doc").to_numpy(), batch.column("row").to_numpy(), batch.column("places")
            for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
                own = places.slice(lo, hi - lo)
                named = own.flatten().to_numpy()
                of = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                start = offsets[of] + named // PACK
                size = named % SIDE + length - 1
                for k in range(0, len(named), 20_000):
                    part = slice(k, k + 20_000)
                    ends = np.cumsum(size[part])
                    at = np.repeat(start[part] - np.r_[0, ends[:-1]], size[part]) + np.arange(ends[-1])
                    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data[at])])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][of[part]]), pa.array(rows[lo:hi][of[part]]), pa.array(named[part]), found.cast(pa.binary())], names=["doc", "row", "parent", "string"])

    return run


def _split(length: int, width: int):
    """Strings to ranges of windows.  Ranges are cut by the distance from window to anchor, so
    equal windows fall in ranges of equal context."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            docs, rows, parents, places = (batch.column(c).to_numpy() for c in ("doc", "row", "parent", "place"))
            for lo, hi, data, offsets in text_slices(batch, "string"):
                text = Bytes(data, offsets)
                start, back, windows = places[lo:hi] // PACK, places[lo:hi] // SIDE % SIDE, places[lo:hi] % SIDE
                shift = start - parents[lo:hi] // PACK  # of the part in its string
                least = back - windows + 1  # distance of the last window
                low, high = least // width, back // width
                count = high - low + 1
                row = np.repeat(np.arange(hi - lo), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
                far, near = np.minimum(step * width + width - 1, back[row]), np.maximum(step * width, least[row])
                zero = offsets[row] + shift[row] + back[row]  # the anchor
                # the context is that of the whole range, as far as the string reaches
                context = text.hash(zero - np.maximum(step * width, 0), zero - (step * width + width - 1) + length)
                key = context + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                body = text.hash(zero - far, zero - near + length)
                place = ((start[row] + back[row] - far) * SIDE + far) * SIDE + far - near + 1
                yield key.view(np.int64), body.view(np.int64), docs[lo:hi][row], rows[lo:hi][row], place, parents[lo:hi][row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _reduced(parts(batches), length)

    return run


def _cut() -> object:
    """Texts with their spans (starts, stops) to the maximal runs removed and what is left."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc")
            hits = pa.array(batch.column("spans").to_pandas().map(lambda x: [] if x is None else x), batch.column("spans").type) if batch.column("spans").null_count else batch.column("spans")
            for lo, hi, data, offsets in text_slices(batch, "_lm_text"):
                own = hits.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                flat = own.flatten()
                start, stop = (flat.field(k).to_numpy() for k in (0, 1))
                at, start, stop = spans_of(of, start, np.minimum(stop, np.diff(offsets)[of]))
                of = of[at]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, offsets[of] + start, 1)
                np.add.at(edge, offsets[of] + stop, -1)
                kept = np.cumsum(edge[:-1]) == 0
                total = np.zeros(len(data) + 1, np.int64)
                np.cumsum(kept, out=total[1:])
                left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(total[offsets]), pa.py_buffer(data[kept])])
                cut = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], names=["start", "end"])).cast(kind)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offsets)), spans, left.cast(pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed byte runs) and kept
    (the bytes left, which may end inside a code point).

    A null or empty text has no bytes; texts under `length` bytes lose nothing; longer ones of
    any length are read whole, in pieces.  Rows that repeat an id and text are one document
    seen again and do not remove each other's bytes.  Rows that repeat an id with other text
    are documents of their own, in the order of a hash; so is each row without an id, and
    those sort last.  No rows give no rows.  Other columns of docs are not read, whatever
    their names.
    """
    if not 0 < gram <= length < gram + SIDE:
        raise ValueError("gram must be at most length, and length - gram under SIDE")
    small_batches(docs.sparkSession)
    keyed = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_lm_text")), "doc_id", "_lm_text", "suffix-rows")
    base = keyed.select(F.col("_lm_doc").alias("doc"), F.col("_lm_row").alias("row"), "_lm_text")
    strings_of = "key long, body long, doc long, row long, place long, parent long, stop long"

    def settle(parts: DataFrame, tag: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The written result, its spans that repeat, and the places that stay open."""
        dealt = parts.repartitionByRange("key", "body").sortWithinPartitions("key", "body", "doc", "row", "place")
        out = durable(dealt.mapInArrow(_settled(length), "doc long, row long, start long, parent long, stop long"), tag)
        return out, out.filter("stop > 0").select("doc", "row", "start", "stop"), out.filter("stop = 0").select("doc", "row", "parent", F.col("start").alias("place"))

    done, repeated, left = settle(base.mapInArrow(_phrases(length, gram), strings_of), "suffix-0")
    wanted = left.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    texts = base.join(wanted.hint("merge"), ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "row", "_lm_text", "places")
    strings = durable(texts.mapInArrow(_strings(length), "doc long, row long, parent long, string binary"), "suffix-strings")
    left, over = strings.withColumn("place", F.col("parent")), [done, strings]
    for k, width in enumerate(RANGES, 1):
        done, later, left = settle(left.mapInArrow(_split(length, width), strings_of), f"suffix-{k}")
        over.append(done)
        repeated = repeated.unionByName(later)
        left = left.join(strings.hint("merge"), ["doc", "row", "parent"])

    spans = repeated.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    hits = durable(spans, "suffix-hits")
    discard(*over)
    out = base.join(hits.hint("merge"), ["doc", "row"], "left").select("doc", "_lm_text", "spans")
    out = out.mapInArrow(_cut(), "doc long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.select(from_key("doc").alias("doc_id"), "n_bytes", "spans", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, len(h) // 2 - 99)) AS i, h FROM d WHERE len(h) >= 200),
x AS (
  SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n
  FROM (SELECT r, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM w)),
c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM x WHERE n > 1),
g AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i - p > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM c),
s AS (SELECT r, g, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY r, g),
k AS (SELECT r, s.a, s.b, coalesce(lag(s.b) OVER (PARTITION BY r ORDER BY s.a), 0) AS f FROM s),
t AS (
  SELECT r, sum(b - a)::BIGINT AS n, count(*) AS m, max(b) AS z, string_agg(substr(d.h, 2 * f + 1, 2 * (a - f)::BIGINT), '' ORDER BY a) AS q
  FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE q || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
