"""URL filters by Bloom filter cascades.

A cascade holds a list of keys exactly, relative to a known universe.  Level 0 is a Bloom
filter of the listed keys; level 1 holds the keys of the universe that level 0 wrongly
accepts; level 2 the listed keys that level 1 wrongly accepts; and so on until none is
left.  A key of the universe is listed if the first level that lacks it is an odd one.  The
universe is every key that any url of the corpus asks about, so membership is exact, and
judging needs no join: the cascade has a few bits per listed key and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bytes, discard, durable, mix, table, text_slices

#: (verdict, host, path): fits the host and its subdomains where the path starts so.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts, with their subdomains, that are blocked where no rule fits.
BLOCKED_HOSTS = tuple(
    f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "ads-track", "free-bets") for top in ("com", "net", "org")
)
#: Listed keys that a cascade is made of, about five bits each; more hosts are joined instead.
MAX_LISTED = 20_000_000


def _hashes(keys: pa.Array) -> np.ndarray:
    out = np.zeros(len(keys), np.uint64)
    batch = pa.RecordBatch.from_arrays([keys], names=["k"])
    for lo, hi, data, offsets in text_slices(batch, "k"):
        out[lo:hi] = Bytes(data, offsets).hash(offsets[:-1], offsets[1:])
    return out


class Bloom:
    def __init__(self, hashes: np.ndarray, rate: float, salt: int):
        self.rounds = max(1, round(-np.log2(rate)))
        self.size = max(64, int(len(hashes) * self.rounds / np.log(2)) + 1)
        self.salt = np.uint64(salt * 2 + 1)
        self.bits = np.zeros(self.size, bool)
        for at in self._places(hashes):
            self.bits[at] = True
        self.bits = np.packbits(self.bits)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        x = mix(hashes * self.salt + self.salt)
        step = mix(x + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for _ in range(self.rounds):
            yield (x % np.uint64(self.size)).astype(np.int64)
            x = x + step

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._places(hashes):
            out &= (self.bits[at >> 3] >> (7 - (at & 7))) & 1 == 1
        return out


class Cascade:
    def __init__(self, listed: Iterable[str], levels: list[Bloom] | None = None):
        self.listed = np.unique(_hashes(pa.array(sorted(set(listed)), pa.string())))
        self.levels = levels or []

    def start(self, universe_size: int) -> None:
        share = len(self.listed) / max(1, universe_size)
        self.levels = [Bloom(self.listed, min(0.5, max(share / 2**0.5, 2**-30)), 0)]

    def finish(self, wrong: np.ndarray) -> None:
        """wrong: the unlisted keys of the universe that level 0 accepts."""
        right, wrong = self.listed, np.setdiff1d(wrong, self.listed)
        while len(wrong):
            self.levels.append(Bloom(wrong, 0.5, len(self.levels)))
            right, wrong = wrong, right[self.levels[-1].holds(right)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe."""
        out = np.zeros(len(hashes), bool)
        left = np.arange(len(hashes))
        for level in self.levels:
            left = left[level.holds(hashes[left])]
            out[left] = ~out[left]
        return out


def _accepted(level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hashes(batch.column("key"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[level.value.holds(hashes)].view(np.int64))], names=["key"])

    return run


def build_cascade(universe: DataFrame, listed: Iterable[str]) -> Cascade:
    """universe: a column key, each key once."""
    cascade = Cascade(listed)
    cascade.start(universe.count())
    level = universe.sparkSession.sparkContext.broadcast(cascade.levels[0])
    # as many as listed keys over the root of two, by the choice of the first level's rate
    wrong = [r.key for r in universe.mapInArrow(_accepted(level), "key long").toLocalIterator()]
    cascade.finish(np.unique(np.array(wrong, np.int64).view(np.uint64)))
    cascade.listed = cascade.listed[:0]
    return cascade


def _parts(url: Column) -> tuple[Column, Column]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_lm_url, instr(_lm_url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column, labels: int) -> Column:
    """The host's last 1 to `labels` labels, as far as it has them."""
    at_most = F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)])
    return F.array_distinct(at_most)


def _judge(rules, blocking, hosts):
    """Each page's longest rule, whether it blocks, and whether a host of it is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, suffixes = batch.column("_lm_keys"), batch.column("_lm_hosts")
            text = keys.flatten()
            row = np.repeat(np.arange(n), np.diff(keys.offsets.to_numpy()))
            hashes = _hashes(text)
            fits = np.flatnonzero(rules.value.holds(hashes))
            length = pc.utf8_length(text.take(pa.array(fits))).to_numpy() if len(fits) else fits
            fits = fits[np.lexsort((fits, -length, row[fits]))]
            fits = fits[np.r_[True, row[fits][1:] != row[fits][:-1]]] if len(fits) else fits  # the longest of a row
            best, blocks, listed = np.full(n, -1), np.zeros(n, bool), np.zeros(n, bool)
            best[row[fits]] = fits
            blocks[row[fits]] = blocking.value.holds(hashes[fits])
            if hosts is not None:
                row = np.repeat(np.arange(n), np.diff(suffixes.offsets.to_numpy()))
                listed[row[hosts.value.holds(_hashes(suffixes.flatten()))]] = True
            rule = text.take(pa.array(best, mask=best < 0)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), rule, pa.array(blocks), pa.array(listed)], names=["page_id", "host", "path", "rule", "blocks", "listed"]
            )

    return run


def url_filter(pages: DataFrame, rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict and listed
    (the host or a parent is in the list).

    blocked is a list of hosts, or a table with a column host; the hosts of a table of more
    than MAX_LISTED are joined with the pages' different hosts instead of broadcast, with the
    same result.  A null url, or one without "://", has an empty host and path, no rule, and is
    allowed.  The longest rule wins; of two of one length the one met first in the order of host
    labels.  A url of any length is judged whole.  Repeated rows are judged alike, a null
    page_id stays null, and no rows give no rows.  Other columns of pages are not read,
    whatever their names.
    """
    spark = pages.sparkSession
    table = blocked.select(F.col("host").alias("_lm_listed")).filter("_lm_listed is not null").distinct() if isinstance(blocked, DataFrame) else None
    joined = table is not None and table.count() > MAX_LISTED
    if joined:
        host_labels = table.agg(F.max(F.size(F.split("_lm_listed", r"\.")))).first()[0]
    else:
        blocked = [r[0] for r in table.toLocalIterator()] if table is not None else list(blocked)
        host_labels = max([1, *(h.count(".") + 1 for h in blocked)])
    lengths = sorted({len(p) for _, _, p in rules})
    labels = max([1, *(h.count(".") + 1 for _, h, _ in rules)])
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_lm_url"))
    host, path = _parts(F.col("_lm_url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    keys = F.flatten(
        F.transform(
            _suffixes(F.col("host"), labels),
            lambda h: F.filter(F.array(*[F.when(F.length("path") >= n, F.concat(h, F.substring("path", 1, n))) for n in lengths]), lambda k: k.isNotNull()),
        )
    ) if lengths else F.array().cast("array<string>")
    base = base.withColumn("_lm_keys", keys).withColumn("_lm_hosts", _suffixes(F.col("host"), host_labels))
    wanted = [("_lm_keys", [h + p for _, h, p in rules]), ("_lm_keys", [h + p for v, h, p in rules if v == "block"])]
    universes = {c: durable(base.select(F.explode(c).alias("key")).distinct(), "url-keys") for c in ("_lm_keys", *([] if joined else ["_lm_hosts"]))}
    cascades = [spark.sparkContext.broadcast(build_cascade(universes[c], listed)) for c, listed in wanted]
    hosts = None if joined else spark.sparkContext.broadcast(build_cascade(universes["_lm_hosts"], blocked))
    discard(*universes.values())
    out = base.mapInArrow(_judge(*cascades, hosts), "page_id long, host string, path string, rule string, blocks boolean, listed boolean")
    if joined:
        found = base.select("host").distinct().select("host", F.explode(_suffixes(F.col("host"), host_labels)).alias("_lm_listed")).join(table, "_lm_listed").select("host").distinct()
        out = out.drop("listed").join(found.withColumn("_lm_hit", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("_lm_hit", F.lit(False)))
    verdict = F.when(F.when(F.col("rule").isNull(), F.col("listed")).otherwise(F.col("blocks")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def query(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_HOST_TESTS = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)
ORACLE = rf"""
WITH r(verdict, h, p) AS (VALUES {_RULE_ROWS}),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
  FROM u),
f AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, f.rule, ({_HOST_TESTS}) AS listed,
       coalesce(f.verdict, CASE WHEN {_HOST_TESTS} THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (page_id)
"""
