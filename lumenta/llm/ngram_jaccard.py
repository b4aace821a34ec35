"""N-gram Jaccard join.

Documents become sets of hashed word shingles; documents with equal sets are one class.
Exact prefix filtering brings together the classes that can link at all: under one global
order of shingles, two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each.  The order puts shingles that many documents hold last, so a
line that a third of the corpus repeats is no meeting point.  Each set also knows how many
of its shingles follow: no pair shares more from its first common shingle on, so most pairs
that meet late in their orders need no comparison there.

Each meeting shingle is one or more size-banded tiles.  A tile's members are sorted by
set size; for each, only the band of sizes that the threshold allows is compared, by
hashed bitmap signatures: differing bits bound the difference from below, and with the
sizes the overlap from above.  What survives is settled by intersection of the exact sorted
arrays.  Links are found in two passes: first from every tile's most central member, then,
only between classes that are not yet connected, over whole tiles.

No group emits its pairs.  A tile gives the clusters of members that the signatures cannot
tell apart, one row a member; a cluster's arrays then meet in one task, which grows
components from member to member and gives at most one link less than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_WHITE, Bytes, discard, durable, from_key, grams, mix, row_keyed, signed, small_batches, table, text_slices
from .components import connected

SHINGLE = 5
PERCENT = 75
#: A shingle goes to the end of the order when at least one document in so many has it ...
COMMON_SHARE = 1000
#: ... as counted from the runs of documents in which it occurs this often.
COMMON_IN_BATCH = 4
#: Shingles that one task holds together to count them.
COUNTED_TOGETHER = 2_000_000
#: Members of a block and shingles in their sets; a larger group is dealt to several tiles, and
#: a route of more rows to several tasks.
TILE, TILE_SHINGLES = 512, 1_000_000
#: Bits of the signature for each shingle, and the largest signature in 64-bit words.
BITS_PER_SHINGLE, MAX_SIGNATURE_WORDS = 4, 2048


def shingle_sets(batch: pa.RecordBatch, column: str, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, offsets) of bounded slices: each row's distinct shingles,
    sorted, between its offsets.  Null is an empty text."""
    for lo, hi, data, offsets in text_slices(batch, column):
        text = Bytes(data, offsets, fold_case=True)
        starts, ends, first = text.words(NOT_WHITE)
        hashed = text.hash(starts, ends)
        whole, at = grams(hashed, first, n)
        cut = np.searchsorted(at, first)
        short = np.flatnonzero((np.diff(cut) == 0) & (np.diff(first) > 0))
        if len(short):  # fewer than n words: the whole sequence is one shingle
            only = []
            for i in short:
                few = hashed[first[i] : first[i + 1]]
                only.append(mix(np.bitwise_xor.reduce(mix(few + np.arange(len(few), dtype=np.uint64))) + np.array([len(few)], np.uint64)))
            whole = np.insert(whole, cut[short], np.concatenate(only))
            extra = np.zeros(len(cut), np.int64)
            extra[short + 1] = 1
            cut = cut + np.cumsum(extra)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            whole[a:b].sort()
        keep = np.ones(len(whole), bool)
        keep[1:] = whole[1:] != whole[:-1]
        keep[cut[:-1][np.diff(cut) > 0]] = True
        kept = np.zeros(len(whole) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        yield lo, whole[keep], kept[cut]


def nodes_of(shingles: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The class of each set: 64 bits from two independent sums over its members."""
    full = np.flatnonzero(np.diff(cut))
    out = np.zeros(len(cut) - 1, np.int64)
    if len(full):
        one = np.add.reduceat(mix(shingles), cut[full])
        two = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), cut[full])
        out[full] = (mix(one) ^ (two * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap whose length depends on the size band only through powers of two, so that
    signatures of neighbouring bands can be folded onto the shorter one."""
    words = 1
    while words < MAX_SIGNATURE_WORDS and words * 64 < BITS_PER_SHINGLE * len(shingles):
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(words * 64)] = 1
    return np.packbits(bits).view(np.uint64)


def _summaries(column: str):
    """Per document its class and size; per batch the shingles that many documents hold."""

    def common(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        everything = np.concatenate(held)
        everything.sort()
        edges = np.flatnonzero(np.r_[True, everything[1:] != everything[:-1]])
        counts = np.diff(np.r_[edges, len(everything)])
        often = counts >= COMMON_IN_BATCH
        if n := int(often.sum()):
            hot = everything[edges[often]]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), signed(hot), pa.array(counts[often]), pa.array(np.ones(n, bool)), pa.nulls(n, pa.binary())], names=names)

    names = ["doc", "row", "node", "n", "common", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            ids, rows = batch.column("_lm_doc"), batch.column("_lm_row")
            for lo, shingles, cut in shingle_sets(batch, column):
                n = len(cut) - 1
                marks = [signature(shingles[a:b]).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), rows.slice(lo, n), pa.array(nodes_of(shingles, cut)), pa.array(np.diff(cut)), pa.array(np.zeros(n, bool)), pa.array(marks, pa.binary())], names=names
                )
                held.append(shingles)
                if sum(map(len, held)) >= COUNTED_TOGETHER:
                    yield from common(held)
                    held = []
        if held:
            yield from common(held)

    return run


def _prefixes(column: str, common, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        filter_bits = np.zeros(1 << 22, bool)
        filter_bits[last & np.uint64((1 << 22) - 1)] = True
        for batch in batches:
            for _, shingles, cut in shingle_sets(batch, column):
                nodes = nodes_of(shingles, cut)
                late = filter_bits[shingles & np.uint64((1 << 22) - 1)]
                if len(last) and late.any():
                    maybe = np.flatnonzero(late)
                    late[maybe] = last[np.minimum(np.searchsorted(last, shingles[maybe]), len(last) - 1)] == shingles[maybe]
                size = np.diff(cut)
                keep = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                row = np.repeat(np.arange(len(size)), size)
                before = np.zeros(len(late) + 1, np.int64)
                np.cumsum(late, out=before[1:])
                late_before = before[:-1] - before[cut[:-1]][row]
                early = size - (before[cut[1:]] - before[cut[:-1]])
                place = np.where(late, early[row] + late_before, np.arange(len(late)) - cut[:-1][row] - late_before)
                chosen = place < keep[row]
                yield pa.RecordBatch.from_arrays([signed(shingles[chosen]), pa.array(nodes[row[chosen]]), pa.array(size[row[chosen]].astype(np.int32)), pa.array((size[row] - place)[chosen].astype(np.int32))], names=["token", "node", "n", "rest"])

    return run


def _sets(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("node").to_numpy()
            for lo, shingles, cut in shingle_sets(batch, column):
                found = nodes_of(shingles, cut)
                own = np.flatnonzero(found == wanted[lo : lo + len(found)]).tolist()
                arrays = [shingles[cut[i] : cut[i + 1]] for i in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[own]), pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array([signature(a).tobytes() for a in arrays], pa.binary())], names=["node", "shingles", "mark"]
                )

    return run


def most_shared(one: bytes, two: bytes, n: int, m: int) -> int:
    """A bound from above on what sets of n and m members share, from their signatures."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    words = min(len(a), len(b))
    a, b = (x if len(x) == words else np.bitwise_or.reduce(x.reshape(-1, words), axis=0) for x in (a, b))
    differ = int(np.bitwise_count(a ^ b).sum(dtype=np.int64))
    return (n + m - max(differ, abs(n - m))) // 2


def overlap_at_least(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _verify(percent: int):
    def links(x: bytes, y: bytes, one: bytes, two: bytes) -> bool:
        n, m = len(x) // 8, len(y) // 8
        most = most_shared(one, two, n, m)
        return 100 * most >= percent * (n + m - most) and overlap_at_least(x, y, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "one", "two")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([links(*g) for g in given], pa.bool_()))

    return run


def grow(arrays: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what of the sets reaches each other, given what has one root already.

    A component grows from member to member; each is compared with the sets outside it only,
    all in one pass over their shingles.
    """
    size = np.array([len(a) for a in arrays])
    ids = np.unique(np.concatenate(arrays), return_inverse=True)[1].astype(np.int32)
    first = np.r_[0, np.cumsum(size)]
    has = np.zeros(int(ids.max()) + 1, bool)
    out: list[tuple[int, int]] = []
    outside = np.ones(len(arrays), bool)
    for seed in range(len(arrays)):
        if not outside[seed]:
            continue
        queue = np.flatnonzero(outside & (root == root[seed])).tolist()
        outside[queue] = False
        while queue:
            i = queue.pop()
            near = np.flatnonzero(outside & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            if not len(near):
                continue
            own = ids[first[i] : first[i + 1]]
            has[own] = True
            at = np.concatenate([ids[first[j] : first[j + 1]] for j in near])
            shared = np.add.reduceat(has[at], np.r_[0, np.cumsum(size[near])[:-1]], dtype=np.int64)
            has[own] = False
            for j in near[100 * shared >= percent * (size[near] + size[i] - shared)].tolist():
                if outside[j]:
                    out.append((i, j))
                    joined = np.flatnonzero(outside & (root == root[j])).tolist()
                    outside[joined] = False
                    queue += joined
    return out


def _by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], at_least: int = 1) -> Iterator[pa.Table]:
    """Rows sorted by keys as tables of whole keys, of one key each or, if at_least is given, of
    as many as it takes to have so many rows; a key may span batches."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            new |= v[1:] != v[:-1]
        cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
        if at_least > 1:  # the first key, all whole keys together, the last one
            cuts = np.unique(np.r_[cuts[:2], cuts[-2:]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and tuple(v[start] for v in values) != last and rows >= at_least:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            last = tuple(v[end - 1] for v in values)
            held.append(batch.slice(start, end - start))
            rows += end - start
    if held:
        yield pa.Table.from_batches(held)


def _fits(token: np.ndarray, tile: np.ndarray, n: np.ndarray, root: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, sorted by tile and size, may have a partner in their tile."""
    new = np.r_[True, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])]
    group = np.cumsum(new)
    run = np.cumsum(np.r_[True, new[1:] | (root[1:] != root[:-1])]) - 1  # of one component in one tile
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    last = np.r_[first[1:], len(n)] - 1
    # sizes that a partner may have if this is the first common shingle
    least = -(-percent * n // 100)
    most = np.minimum(100 * n // percent, rest.astype(np.int64) * (100 + percent) // percent - n)
    # the nearest larger and the nearest smaller set of another component
    after, before = np.minimum(last[run] + 1, len(n) - 1), np.maximum(first[run] - 1, 0)
    fits = (group[after] == group) & (root[after] != root) & (n[after] <= most)
    fits |= (group[before] == group) & (root[before] != root) & (n[before] >= least)
    by_size = (group << np.int64(40)) + n
    low = np.searchsorted(by_size, (group << np.int64(40)) + least)
    high = np.searchsorted(by_size, (group << np.int64(40)) + np.maximum(most, 0), side="right")
    return fits & (high - low > (n <= most))


def _meeting(percent: int):
    """Of rows sorted by token, part and size, each class once and only if another can be its
    partner there.  Parts of a token of many classes (0 and up) are kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("token", "part"), 50_000):
            t = t.combine_chunks()
            key = [t.column(c).to_numpy() for c in ("token", "part", "node")]
            t = t.filter(pa.array(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            while t.num_rows:
                token, part, node, n, rest = (t.column(c).to_numpy() for c in ("token", "part", "node", "n", "rest"))
                fits = _fits(token, part, n.astype(np.int64), node, rest, percent) | (part >= 0)
                if fits.all():
                    break
                t = t.filter(pa.array(fits))
            yield from t.select(["token", "node", "n", "rest"]).to_batches()

    return run


def _partners(percent: int):
    """Of rows sorted by tile and size, those with a partner of another component in their band
    of sizes; the others need no signature.  Adds the smallest node of the tile as its route:
    tiles of much the same members have one route, where each member's signature is sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("token", "tile"), 20_000):
            t = t.combine_chunks()
            while t.num_rows:  # a row that goes may have been the last partner of another
                fits = _fits(*(t.column(c).to_numpy() for c in ("token", "tile", "n", "root", "rest")), percent)
                if fits.all():
                    break
                t = t.filter(pa.array(fits))
            if not t.num_rows:
                continue
            token, tile = (t.column(c).to_numpy() for c in ("token", "tile"))
            start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])])
            routes = np.minimum.reduceat(t.column("node").to_numpy(), start)
            t = t.append_column("route", pa.array(np.repeat(routes, np.diff(np.r_[start, len(token)]))))
            yield from t.to_batches()

    return run


def _links(percent: int):
    """Rows (cluster, node, root, shingles) sorted by cluster to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("cluster",)):
            node = t.column("node").to_numpy()
            found = grow([np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()], t.column("root").to_numpy(), percent)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return run


def _fold(marks: list[np.ndarray], words: int) -> np.ndarray:
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in marks])


def _clusters(group: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """A label for each member of a tile: those that pairs of different components, which the
    signatures cannot rule out, connect have one label; -1 for a member of no such pair."""
    order = np.lexsort((group["node"], group["n"]))
    n, root, side, rest = (group[k][order] for k in ("n", "root", "side", "rest"))
    marks = [group["mark"][i] for i in order]
    split = bool(side.min() != side.max())
    label = np.arange(len(n))
    alone = np.ones(len(n), bool)
    folded: dict[int, np.ndarray] = {}
    for i in range(len(n) - 1):
        top = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        if top <= i + 1:
            continue
        band = np.arange(i + 1, top)
        band = band[(root[band] != root[i]) & (label[band] != label[i])]
        band = band[(100 + percent) * np.minimum(rest[band], rest[i]) >= percent * (n[band] + n[i])]
        if split:
            band = band[side[band] != side[i]]
        if not len(band):
            continue
        words = len(marks[i])  # the smallest set of the band has the shortest signature
        if words not in folded:
            folded[words] = _fold([m if len(m) >= words else np.resize(m, words) for m in marks], words)
        differ = np.bitwise_count(folded[words][band] ^ folded[words][i]).sum(axis=1, dtype=np.int64)
        most = (n[band] + n[i] - np.maximum(differ, n[band] - n[i])) // 2
        band = band[100 * most >= percent * (n[band] + n[i] - most)]
        if len(band):
            met = np.unique(label[np.r_[i, band]])
            label[np.isin(label, met)] = met[0]
            alone[i] = alone[band] = False
    out = np.empty(len(n), np.int64)
    out[order] = np.where(alone, -1, label)
    return out


def _tiles(percent: int):
    """Rows sorted by route, the signatures (kind 0) before the tiles, to clusters (cluster,
    node, root); equal sets of members have one cluster, so that tiles which find the same
    members can be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ("route", "part")):
            kind = t.column("kind").to_numpy()
            sent = int(np.searchsorted(kind, 1))
            known = t.column("node").to_numpy()[:sent]
            order = np.argsort(known)
            known = known[order]
            marks = [np.frombuffer(m, np.uint64) for m in t.column("mark").slice(0, sent).to_pylist()]
            rows = {k: t.column(k).to_numpy()[sent:] for k in ("token", "tile", "node", "n", "rest", "root", "side")}
            cuts = np.flatnonzero(np.r_[True, (rows["token"][1:] != rows["token"][:-1]) | (rows["tile"][1:] != rows["tile"][:-1]), True])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                group = {k: v[start:end] for k, v in rows.items()}
                group["mark"] = [marks[i] for i in order[np.searchsorted(known, group["node"])].tolist()]
                yield from _named(group, _clusters(group, percent))

    def _named(group: dict, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.flatnonzero(label >= 0)
        if not len(order):
            return
        order = order[np.lexsort((group["node"][order], label[order]))]
        cut = np.r_[np.flatnonzero(np.r_[True, np.diff(label[order]) > 0]), len(order)]
        node = group["node"][order]
        cluster = np.repeat(nodes_of(node.view(np.uint64), cut), np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(node), pa.array(group["root"][order])], names=["cluster", "node", "root"])

    return run


def _dealt(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows (token, node, n, rest, root) with their tiles.  A group of several blocks is dealt by its
    largest component: its own members need not meet each other, so each block of them is
    one tile with each block of the others, and only those are paired among themselves."""
    rows = rows.join(tokens.select("token", F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES)).alias("blocks")).hint("merge"), "token")
    shares = rows.filter("blocks > 1").groupBy("token", "root", "blocks").agg(F.count(F.lit(1)).alias("c"))
    shares = shares.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("members"), F.first("blocks").alias("blocks"))
    part = F.ceil(F.col("blocks") * F.col("most") / F.col("members"))
    split = shares.select("token", "major", part.alias("mine"), (F.col("blocks") - part + 1).alias("others"))
    rows = rows.drop("blocks").join(split, "token", "left")
    of_major = F.col("root") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(of_major, F.col("mine")).otherwise(F.col("others")))
    copies = F.when(F.col("major").isNull(), 1).when(of_major, F.col("others")).otherwise(F.col("others") + F.col("mine"))
    rows = rows.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    first = F.col("others") * F.col("others")
    among = F.col("k") < F.col("others")
    tile = (
        F.when(F.col("major").isNull(), 0)
        .when(of_major, first + F.col("k") * F.col("mine") + F.col("own"))
        .when(among, F.least("own", "k") * F.col("others") + F.greatest("own", "k"))
        .otherwise(first + F.col("own") * F.col("mine") + F.col("k") - F.col("others"))
    )
    side = F.when(F.col("major").isNull() | (~of_major & among & (F.col("own") == F.col("k"))), 0).when(of_major | (among & (F.col("own") < F.col("k"))), 1).otherwise(2)
    return rows.select("token", tile.cast("long").alias("tile"), "node", "n", "rest", "root", side.cast("long").alias("side"))


def linked(base: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, row, node, n, first_doc, first_row) for rows (_lm_doc, _lm_row, _lm_text), where doc
    and row name a document: its class and set size, and the smallest document that it
    reaches by links, itself included."""
    spark = base.sparkSession
    small_batches(spark)
    seen = durable(base.mapInArrow(_summaries("_lm_text"), "doc long, row long, node long, n long, common boolean, mark binary"), "jaccard-sets")
    members = seen.filter("not common").select("doc", "row", "node", "n")
    total = members.count()
    common = [
        r.node
        for r in seen.filter("common").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2 * COMMON_IN_BATCH, total // COMMON_SHARE)).select("node").toLocalIterator()
    ]  # at most COMMON_SHARE times the mean set size
    last = spark.sparkContext.broadcast(np.sort(np.array(common, np.int64).view(np.uint64)))

    rows = durable(base.mapInArrow(_prefixes("_lm_text", last, percent), "token long, node long, n int, rest int"), "jaccard-prefixes")
    meeting = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("holders")).filter("lo != hi").select("token", "holders")
    meeting = durable(meeting, "jaccard-meeting")  # with an exchange on either side, hot shingles are split when joined
    part = F.when(F.col("holders") > TILE, F.pmod(F.xxhash64("node"), F.ceil(F.col("holders") / TILE))).otherwise(-1)
    met = rows.join(meeting, "token").select("token", "node", "n", "rest", part.cast("long").alias("part"))
    met = met.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")
    meets = durable(met.mapInArrow(_meeting(percent), "token long, node long, n int, rest int"), "jaccard-meets")
    discard(rows, meeting)

    classes = members.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc", "row")).alias("first"), F.max("n").alias("n"))
    classes = durable(classes.select("node", F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), "n"), "jaccard-classes")
    central = meets.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.first("n").cast("long").alias("n"))
    central = durable(central.select("node", "n", (F.col("shared") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).alias("q")), "jaccard-central")

    def arrays_of(nodes: DataFrame, tag: str, few: bool = False) -> DataFrame:
        """(node, shingles, mark): the exact sorted arrays of some classes; where they are few
        they are written first, so that Spark knows their size and may broadcast them."""
        wanted = nodes.distinct().join(classes, "node").select("node", F.col("doc").alias("_lm_doc"), F.col("row").alias("_lm_row"))
        wanted = durable(wanted, f"{tag}-wanted") if few else wanted.hint("merge")
        texts = base.join(wanted, ["_lm_doc", "_lm_row"]).dropDuplicates(["_lm_doc", "_lm_row"])
        return durable(texts.select("node", "_lm_text").mapInArrow(_sets("_lm_text"), "node long, shingles binary, mark binary"), tag)

    # one kind of join at every size, so that the plan that is tested is the plan that runs
    ranked = meets.drop("n").join(central.select("node", "n", "q").hint("merge"), "node")
    hub = ranked.groupBy("token").agg(F.max(F.struct("q", "node", "n")).alias("hub"))
    stars = (
        ranked.join(hub.hint("merge"), "token")
        .filter((F.col("node") != F.col("hub.node")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
        .groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("n", "hub.n")).alias("n"))
        .filter(8 * F.col("shared") >= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)  # an opening move; what it leaves out comes below
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    stars = durable(stars, "jaccard-stars")
    arrays = arrays_of(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))), "jaccard-star-sets")
    x, y = (arrays.select(F.col("node").alias(n), F.col("shingles").alias(s), F.col("mark").alias(m)) for n, s, m in (("a", "x", "one"), ("b", "y", "two")))
    links = durable(stars.join(x, "a").join(y, "b").select("a", "b", "x", "y", "one", "two").mapInArrow(_verify(percent), "a long, b long"), "jaccard-links")
    discard(stars, arrays)
    roots = durable(connected(links, "jaccard-roots"), "jaccard-roots")

    open_rows = ranked.join(roots.hint("merge"), "node", "left").select("token", "node", "n", "rest", F.coalesce("root", "node").alias("root"))
    open_tokens = (
        open_rows.groupBy("token")
        .agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("n").alias("least"), F.max("n").alias("most"),
            F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"), F.min("node").alias("first"), F.max("node").alias("last"), F.sum("rest").alias("rest"),
        )
        .filter("lo != hi")
        .filter((F.col("members") > 2) | (100 * F.col("least") >= percent * F.col("most")))
        .groupBy("members", "shingles", "one", "two", "first", "last")  # of shingles that the same classes share the first in order is the tile
        .agg(F.max_by("token", "rest").alias("token"))
    )
    open_rows, open_tokens = durable(open_rows, "jaccard-open"), durable(open_tokens, "jaccard-open-tokens")
    discard(meets, central)
    tiles = _dealt(open_rows, open_tokens).repartition("token", "tile").sortWithinPartitions("token", "tile", "n")
    tiles = written = durable(tiles.mapInArrow(_partners(percent), T.StructType([*tiles.schema.fields, T.StructField("route", T.LongType())])), "jaccard-tiles")
    discard(open_rows, open_tokens)
    full = tiles.groupBy("route").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("parts")).filter("parts > 1")
    full = durable(full, "jaccard-full")  # of a known size: a few routes are broadcast
    tiles = tiles.join(full, "route", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("token", "tile"), "parts"), F.lit(0))).drop("parts")
    marks = seen.filter("not common").select("node", "mark").join(tiles.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sent = tiles.select("route", "part", "node").distinct().join(marks, "node").withColumn("kind", F.lit(0))
    both = tiles.withColumn("kind", F.lit(1)).unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition("route", "part").sortWithinPartitions("route", "part", "kind", "token", "tile")
    dealt = dealt.select("route", "part", "kind", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("token", "tile", "node", "n", "rest", "root", "side")], "mark")
    clusters = durable(dealt.mapInArrow(_tiles(percent), "cluster long, node long, root long").distinct(), "jaccard-clusters")
    discard(written, full)
    arrays = arrays_of(clusters.select("node"), "jaccard-cluster-sets", few=True)
    met = clusters.join(arrays.select("node", "shingles"), "node").repartition("cluster").sortWithinPartitions("cluster")
    more = durable(met.mapInArrow(_links(percent), "a long, b long"), "jaccard-more")
    discard(clusters, arrays, roots)
    roots = durable(connected(links.unionByName(more), "jaccard-roots"), "jaccard-roots")
    discard(links, more)

    grouped = classes.join(roots, "node", "left").select("node", "doc", "row", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min(F.struct("doc", "row")).alias("first"))
    ids = durable(grouped.join(first, "root").select("node", F.col("first.doc").alias("first_doc"), F.col("first.row").alias("first_row")), "jaccard-ids")
    discard(classes, roots)
    none = F.col("n") == 0
    return members.join(ids, "node", "left").withColumns({"first_doc": F.when(none, F.col("doc")).otherwise(F.col("first_doc")), "first_row": F.when(none, F.col("row")).otherwise(F.col("first_row"))})


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = row_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_lm_text")), "doc_id", "_lm_text", "jaccard-rows")
    return keyed.select("_lm_doc", "_lm_row", "_lm_text")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and the class of its set.

    Null or blank texts have empty sets and link with nothing; texts under five words are
    one shingle; a text of any length is one set, whole; rows with equal sets always link.  A
    null id stays null and sorts last within its component.  Rows that repeat an id keep a
    row each, judged by its own text.  No rows give no rows.  Other columns of docs are not
    read, whatever their names.
    """
    return linked(_base(docs, id_col, text_col), percent).select(
        from_key("doc").alias("doc_id"), F.col("n").alias("n_shingles"), from_key("first_doc").alias("component_id"), F.col("node").alias("class_id")
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of linked ones, that of the smallest id, and its
    own columns only.

    Rows are judged by their own text: rows with one id and different texts are documents of
    their own, in the order of a hash; so is each row without an id, and those sort last.
    Rows that repeat an id and its text are one document, of which one row stays.  Null and
    blank texts link with nothing, so each such document stays.
    """
    keyed = row_keyed(docs, id_col, text_col, "distinct-rows")
    found = linked(keyed.select("_lm_doc", "_lm_row", F.col(text_col).alias("_lm_text")), percent)
    gone = found.filter("doc != first_doc or row != first_row").select(F.col("doc").alias("_lm_doc"), F.col("row").alias("_lm_row"))
    kept = keyed.join(gone.hint("merge"), ["_lm_doc", "_lm_row"], "left_anti").dropDuplicates(["_lm_doc", "_lm_row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5_number(array_to_string(w[i : i + 4], ' ')))
                                 WHEN len(w) > 0 THEN [md5_number(array_to_string(w, ' '))] ELSE [] END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.x = b.x AND a.r < b.r JOIN n p ON p.r = a.r JOIN n q ON q.r = b.r
  WHERE 100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n)
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r, r AS o FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.o),
m AS (SELECT r, min(o) AS o FROM c GROUP BY r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, f.doc_id AS component_id
FROM d LEFT JOIN n USING (r) JOIN m USING (r) JOIN d f ON f.r = m.o
"""
