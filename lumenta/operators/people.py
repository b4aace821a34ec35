"""Scorers, faces, and the clustering of faces into people."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement, groupby, product
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S
from ..sources import containers
from . import catalog

#: Vectors that one task compares; more are dealt to blocks, each pair of which is one task.
BLOCK = 8_192
#: Of these, those on each side of a matrix of distances (32 MB).
PIECE = 2_048
#: Tasks at most that the pairs of blocks are dealt to.
TASKS = 2_000
#: Squared distances below this are taken from differences.
CLOSE = 1e-6
#: The distance of what has none.
FAR = 1e300
#: Forests that one task merges.
FOREST = 16
FACES = "hash string, faces array<struct<bbox: array<int>, embedding: string, score: double>>, no_face boolean"


def scored(df: DataFrame, column: str, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], name: str) -> DataFrame:
    """Df with a model's score.  The scorer is made once per worker; it takes a
    batch of the column and returns as many numbers."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = make_scorer()
        for batch in batches:
            yield score(batch)

    return df.withColumn(name, run(column))


def cascade(df: DataFrame, column: str, coarse, fine, threshold: float = 0.3) -> DataFrame:
    """The dear scorer sees only rows that the cheap one suspects."""
    first = scored(df, column, coarse, "coarse")
    suspects = scored(first.filter(F.col("coarse") >= threshold), column, fine, "score")
    return suspects.unionByName(first.filter((F.col("coarse") < threshold) | F.col("coarse").isNull()).withColumn("score", F.lit(0.0)))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of x from each of y by one product of matrices.  Its rounding
    would hide small distances, so those are taken again from the differences."""
    found = x @ y.T
    found *= -2
    found += (x * x).sum(axis=1)[:, None]
    found += (y * y).sum(axis=1)
    a, b = np.nonzero(found < CLOSE)
    for k in range(0, len(a), PIECE):
        i, j = a[k : k + PIECE], b[k : k + PIECE]
        found[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(found, out=found)


def _meetings(side: np.ndarray, alone: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of a tile by pairs of pieces: any two rows that it compares meet once, those of
    one piece where that is given twice.  Alone, all rows are compared, else those of two sides."""

    def pieces(at: np.ndarray) -> list[np.ndarray]:
        return np.array_split(at, -(-len(at) // PIECE)) if len(at) else []

    if alone:
        return list(combinations_with_replacement(pieces(np.arange(len(side))), 2))
    return list(product(pieces(np.flatnonzero(side == 0)), pieces(np.flatnonzero(side == 1))))


def nearest(x: np.ndarray, meetings: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The k smallest distances of each row from the rows that it meets, in order; infinite
    where it meets fewer."""
    best = np.full((len(x), k), np.inf)
    for a, b in meetings:
        gaps = _gaps(x[a], x[b])
        for own, other, g in [(a, b, gaps)] if a is b else [(a, b, gaps), (b, a, np.ascontiguousarray(gaps.T))]:
            m = min(k, len(other))
            at = other[np.argpartition(g, m - 1, axis=1)[:, :m]]
            found = [best[own], *(_distances(x[own], x[at[:, c]])[:, None] for c in range(m))]
            best[own] = np.sort(np.concatenate(found, axis=1), axis=1)[:, :k]
    return best


def _prim(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each edge of a minimum spanning tree of rows and columns."""
    m, n = w.shape
    turned = np.ascontiguousarray(w.T)
    near, least, parent = np.full(m + n, np.inf), np.full(m + n, np.inf), np.zeros(m + n, int)
    at = 0
    for _ in range(m + n - 1):
        near[at], least[at] = np.inf, -np.inf  # in the tree: neither next nor closer
        row, first = (w[at], m) if at < m else (turned[at - m], 0)
        closer = np.flatnonzero(row < least[first : first + len(row)])
        reach = row[closer]
        closer += first
        near[closer] = least[closer] = reach
        parent[closer] = at
        at = int(near.argmin())
    node, parent = np.arange(1, m + n), parent[1:]
    return np.minimum(node, parent), np.maximum(node, parent) - m


def spanning_tree(x: np.ndarray, core: np.ndarray, meetings: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Edges (a, b, d) of a minimum spanning forest of the mutual reachability of rows that
    meet.  Each meeting has a tree of its own; the forest lies in the union of these.  A vector
    that is no point, with a NaN or without bounds, is far from all."""
    core = np.where(np.isnan(core), FAR, core)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for a, b in meetings:
        w = _gaps(x[a], x[b])
        np.fmax(w, core[a][:, None], out=w)
        np.fmax(w, core[b], out=w)
        if a is b:
            np.fill_diagonal(w, -1)  # a row and itself, its column, are one point
        i, j = _prim(w)
        i, j = a[i], b[j]
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        found.append((i, j, np.fmax(_distances(x[i], x[j]), np.maximum(core[i], core[j]))))
    a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
    edges = pd.DataFrame({"a": a, "b": b, "d": d})
    return forest(edges) if len(meetings) > 1 else edges


def forest(edges: pd.DataFrame) -> pd.DataFrame:
    """Of edges (a, b, d), those that a minimum spanning forest keeps."""
    edges = edges.sort_values(["d", "a", "b"], kind="stable")
    names = np.unique(edges[["a", "b"]].to_numpy())
    up = np.arange(len(names))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    keep = np.zeros(len(edges), bool)
    ends = np.searchsorted(names, edges[["a", "b"]].to_numpy())
    for i, (a, b) in enumerate(ends.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[a], keep[i] = b, True
    return edges[keep]


def hdbscan(x: np.ndarray, min_size: int = 2) -> np.ndarray:
    """Density clusters of unit vectors; -1 is noise.  Core distances reach to the
    min_size-th point (itself included); the spanning tree of the mutual reachability is
    condensed and the clusters with the largest excess of mass are taken.  Labels go by the
    first member."""
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    meetings = _meetings(np.zeros(n), True)
    edges = spanning_tree(x, nearest(x, meetings, min(min_size, n))[:, -1], meetings)
    return condensed(n, list(zip(edges["d"].tolist(), edges["a"].tolist(), edges["b"].tolist(), strict=True)), min_size)


def condensed(n: int, edges: list[tuple[float, int, int]], min_size: int) -> np.ndarray:
    """Labels of n points from a spanning tree of theirs.  Edges of one length join at once:
    mutual reachability has many of them, and their order must not decide."""
    # single linkage: a node from n on joins earlier nodes at one distance
    up, top, size = list(range(n)), list(range(n)), [1] * n
    kids: dict[int, tuple[list[int], float]] = {}

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for d, level in groupby(sorted(edges), key=lambda e: e[0]):
        joined: dict[int, list[int]] = {}
        for _, a, b in level:
            a, b = find(a), find(b)
            large, small = joined.pop(a, [top[a]]), joined.pop(b, [top[b]])
            if len(large) < len(small):
                a, b, large, small = b, a, small, large
            up[b] = a
            large.extend(small)
            joined[a] = large
        for a, nodes in joined.items():
            top[a] = len(size)
            kids[len(size)] = nodes, d
            size.append(sum(size[k] for k in nodes))

    def points(a: int) -> list[int]:
        out, stack = [], [a]
        while stack:
            a = stack.pop()
            if a < n:
                out.append(a)
            else:
                stack.extend(kids[a][0])
        return out

    # condensed tree: cluster -> (mass, node, children)
    clusters, stack = [], [(top[find(0)], 0.0, None)]
    while stack:
        a, birth, above = stack.pop()
        me = len(clusters)
        clusters.append({"mass": 0.0, "top": a, "below": []})
        if above is not None:
            clusters[above]["below"].append(me)
        while a >= n:
            nodes, d = kids[a]
            level = min(1 / d if d > 0 else np.inf, 1e12)
            large = [k for k in nodes if size[k] >= min_size]
            if len(large) != 1:
                clusters[me]["mass"] += size[a] * (level - birth)
                stack += [(k, level, me) for k in large]
                break
            clusters[me]["mass"] += (size[a] - size[large[0]]) * (level - birth)
            a = large[0]
    best, chosen = [c["mass"] for c in clusters], [True] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):  # children come after their parents
        below = fsum(best[k] for k in clusters[i]["below"])
        if i == 0 or (clusters[i]["below"] and below > best[i]):
            best[i], chosen[i] = below if clusters[i]["below"] else best[i], False
    labels = np.full(n, -1)
    order = [0]
    picked = []
    while order:
        i = order.pop()
        if chosen[i]:
            picked.append(points(clusters[i]["top"]))
        else:
            order.extend(clusters[i]["below"])
    for k, members in enumerate(sorted(picked, key=min)):
        labels[members] = k
    return labels


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row to the tasks of its block with every block; side says which of the two."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tile = F.least("_own", "_other") * blocks + F.greatest("_own", "_other")
    return rows.withColumn("tile", tile).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other")


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _labelled(pdf: pd.DataFrame, labels: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": pdf["id"].to_numpy(), "person": [f"人物_{k + 1:03d}" if k >= 0 else None for k in labels]})


def cluster_people(faces: DataFrame, id_col: str = "id", vector_col: str = "embedding", min_size: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, person), person null for noise; ids are unique and not null.

    Up to block vectors are one task.  More are dealt to blocks.  Each pair of blocks gives the
    nearest distances between its points, then a spanning tree of them; a spanning tree of all
    lies in the union of these.  Trees are merged a few at a time, and the last task holds one
    edge for each point, never a distance of each pair.
    """
    rows = faces.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("v is not null")
    n = rows.count()
    if n <= block:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            return _labelled(pdf, hdbscan(_unit(pdf["v"]), min_size))

        return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(whole, "id long, person string")

    blocks, reach = -(-n // block), min(min_size, n)
    tasks = min(blocks * (blocks + 1) // 2, TASKS)
    dealt = _dealt(rows, blocks).repartition(tasks, "tile")

    def tile(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        pdf = pdf.sort_values("id", kind="stable")
        return pdf, _unit(pdf["v"]), _meetings(pdf["side"].to_numpy(), pdf["tile"].iloc[0] % (blocks + 1) == 0)  # a block with itself

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, meetings = tile(pdf)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "d": list(nearest(x, meetings, reach))})

    def tree(pdf: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
        pdf, x, meetings = tile(pdf)
        ids = pdf["id"].to_numpy()
        edges = spanning_tree(x, cores.sort_values("id", kind="stable")["core"].to_numpy(), meetings)
        return pd.DataFrame({"a": ids[edges["a"]], "b": ids[edges["b"]], "d": edges["d"].to_numpy(), "part": pdf["tile"].iloc[0]})

    core = dealt.groupBy("tile").applyInPandas(near, "id long, d array<double>")
    core = core.groupBy("id").agg(F.get(F.array_sort(F.flatten(F.collect_list("d"))), F.lit(reach - 1)).alias("core"))
    cores = _dealt(core, blocks).repartition(tasks, "tile")
    # the vectors' shuffle is the one above
    edges = dealt.groupBy("tile").cogroup(cores.groupBy("tile")).applyInPandas(tree, "a long, b long, d double, part long")
    parts = blocks * blocks
    while parts > FOREST:
        parts = -(-parts // FOREST)
        edges = edges.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part").applyInPandas(lambda k, p: forest(p).assign(part=k[0]), "a long, b long, d double, part long")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = forest(pdf)
        ids = np.unique(kept[["a", "b"]].to_numpy())
        at = np.searchsorted(ids, kept[["a", "b"]].to_numpy()).tolist()
        labels = condensed(len(ids), [(d, a, b) for d, (a, b) in zip(kept["d"].tolist(), at, strict=True)], min_size)
        return _labelled(pd.DataFrame({"id": ids}), labels)

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(last, "id long, person string")


# --------------------------------------------------------- records, reuse, albums


def fingerprint(df: DataFrame, column: str = "hash", *settings: object) -> DataFrame:
    """One row, fingerprint: 32 hex digits of the sorted set of a column's values and
    the settings.  Values meet in groups by the head of their own digest, and the groups'
    digests in one value, so no task holds the set."""
    parts = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct()
    parts = parts.groupBy(F.substring(F.sha2("v", 256), 1, 4).alias("head")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), "\n"), 256).alias("digest"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "digest"))), lambda x: x["digest"]), "\n")
    return parts.agg(F.substring(F.sha2(F.concat_ws("|", text, *[F.lit(str(s)) for s in settings]), 256), 1, 32).alias("fingerprint"))


def eligible_files(records: DataFrame, explicit_root: str = "") -> DataFrame:
    """(hash, path) of the pictures whose faces are wanted: copied, with a hash and a
    destination, of a picture kind, not under the explicit root; of a hash the last record
    (largest ord) counts."""
    name = F.lower(F.element_at(F.split("destination", "/"), -1))
    own = records.filter(F.col("status").isin("ok", "dry_run") & (F.col("file_hash") != "") & (F.col("destination") != ""))
    own = own.filter(S.extension(name).isin(*dims.FACE_EXTENSIONS))
    if explicit_root:
        own = own.filter(~F.startswith(F.lower("destination"), F.lit(explicit_root.lower() + "/")))
    return own.groupBy(F.col("file_hash").alias("hash")).agg(F.max_by("destination", "ord").alias("path"))


def face_records(files: DataFrame, cached: DataFrame, extract: Callable[[], Callable[[str], list[dict] | None]]) -> DataFrame:
    """FACES rows for files (hash, path): those that are cached, and what extract finds in
    the others.  extract is made once per worker; it takes a path and returns the faces (bbox,
    embedding as float32 in base64, score), or None if the file can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = extract()
        for batch in batches:
            found = [look(p) or [] for p in batch["path"]]
            yield pd.DataFrame({"hash": batch["hash"], "faces": found, "no_face": [not f for f in found]})

    known = cached.join(files.select("hash"), "hash", "left_semi")
    return known.unionByName(files.join(cached.select("hash"), "hash", "left_anti").select("hash", "path").mapInPandas(run, FACES))


def good_faces(records: DataFrame, min_score: float = 0.5, min_side: int = 40) -> DataFrame:
    """(hash, face, embedding) of each face that is sure and large enough; face is its place
    among the file's faces."""
    each = records.select("hash", F.posexplode("faces").alias("face", "f"))
    box = F.col("f.bbox")
    wide, high = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    return each.filter((F.col("f.score") >= min_score) & (wide >= min_side) & (high >= min_side) & F.col("f.embedding").isNotNull()).select("hash", "face", "f.embedding")


def members(faces: DataFrame, min_size: int = 2, cached: DataFrame | None = None, cached_print: str | None = None) -> tuple[DataFrame, str]:
    """(hash, face, person) of good_faces, and the fingerprint of the run.  The cached
    result is taken if it was made of the same files with the same min_size."""
    now = fingerprint(faces, "hash", min_size).first()["fingerprint"]
    if cached is not None and cached_print == now:
        return cached, now
    keyed = faces.withColumn("id", F.xxhash64("hash", "face"))
    found = cluster_people(keyed.withColumn("v", containers.vectors("embedding")), "id", "v", min_size)
    return keyed.join(found, "id", "left").select("hash", "face", "person"), now


def album(found: DataFrame, files: DataFrame, root: str, taken: DataFrame | None = None) -> DataFrame:
    """(person, hash, path, link): one link for each file of a person, named
    like the file in the person's folder, _f<n> where the name is taken.  A file counts once
    for a person however many of its faces are; hashes without a file are left out."""
    once = found.filter("person is not null").select("person", "hash").distinct().join(files.select("hash", "path"), "hash")
    once = once.withColumn("ord", F.struct("path", "hash")).withColumn("dest", F.concat_ws("/", F.lit(root), "person", F.element_at(F.split("path", "/"), -1)))
    return catalog.resolve_names(once, taken, "_f").select("person", "hash", "path", F.col("final").alias("link"))


def outliers(found: DataFrame) -> DataFrame:
    """Hashes all of whose faces are noise."""
    return found.filter("person is null").select("hash").distinct().join(found.filter("person is not null").select("hash"), "hash", "left_anti")


def face_pipeline(records: DataFrame, extract, cached: DataFrame, root: str, explicit_root: str = "", min_size: int = 2, clusters: DataFrame | None = None, clusters_print: str | None = None, cache_only: bool = False) -> dict[str, DataFrame | str]:
    """The tables of a run by name.  faces is the cache to keep; with cache_only that is
    all.  Else members and print are the clustering to keep, album the links to make, outliers
    the rest."""
    files = eligible_files(records, explicit_root)
    faces = face_records(files, cached, extract)
    if cache_only:
        return {"faces": faces}
    found, now = members(good_faces(faces), min_size, clusters, clusters_print)
    return {"faces": faces, "members": found, "print": now, "album": album(found, files, root), "outliers": outliers(found)}
