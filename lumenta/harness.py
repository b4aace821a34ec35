"""Queries over the driver's tables, by name, and the SQL that must agree with them.

Views stand for media catalogs: both engines read the same view text, and the queries
themselves are written twice, as DataFrame operators here and as plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dims
from .functions import scalars as S
from .operators import catalog as C
from .operators import people
from .operators import planning as P
from .plans import reports
from .sources import containers, filelists, media, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _pick(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_NAME = _pick("doc_id", "IMG_", "Screenshot_", "C360_", "_DSC", "DJI_", "pic ") + " || CAST(doc_id AS STRING) || " + _pick("doc_id", ".jpg", ".JPG", ".png", ".mp4", ".mov", ".dng", ".txt", ".srt")
_HASH = "md5(concat_ws('|', CAST(length(text) AS STRING), substring(text, 1, 16384), CASE WHEN length(text) > 32768 THEN right(text, 16384) END))"
VIEWS = {
    "files": f"""SELECT doc_id AS id, doc_id AS ord, text, source, lang, '/src/' || source || '/' || lang AS dir, {_NAME} AS name,
        '/src/' || source || '/' || lang || '/' || {_NAME} AS path, n_chars * 64 AS size, {_HASH} AS hash,
        CASE WHEN doc_id % 8 IN (3, 4) THEN 'video' WHEN doc_id % 8 IN (6, 7) THEN 'companion' ELSE 'photo' END AS media,
        1704067200 + doc_id * 60 AS mtime_s FROM documents""",
    "devices": f"""SELECT p_partkey AS id, '/d' || CAST(p_partkey % 97 AS STRING) AS dir,
        {_pick("p_partkey", "Canon", "NIKON CORPORATION", "SONY", "Sony Corporation", "Apple", "HUAWEI", "samsung", "Xiaomi", "DJI", "", "Sony Ericsson", "Acme", "Redmi", "poco")} AS make,
        {_pick("(p_partkey * 7)", "EOS 700D", "NIKON D90", "ILCE-7RM2", "Xperia Z", "iPhone 8", "MT7-CL00", "GT-I9100", "23127PN0CC", "FC8582", "", "iphone10,3", "Canon EOS RP", "14", "Note 12 Pro", "X6 5G", "2203129G")} AS model,
        CASE WHEN p_partkey % 3 = 0 THEN 'video' ELSE 'photo' END AS media_type,
        CAST(p_size AS BIGINT) * 4096 AS size, CAST(p_size * 20 AS INT) AS width, CAST((p_partkey % 50) * 20 AS INT) AS height,
        {_pick("p_partkey", "", "DJI Flip 1.0", "other", "dji fly")} AS app FROM part""",
    "scores": """SELECT doc_id AS id, CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS coarse, CAST(doc_id * 53 % 101 AS DOUBLE) / 100 AS fine,
        CAST(doc_id * 29 % 101 AS DOUBLE) / 100 AS a, CAST(doc_id * 71 % 101 AS DOUBLE) / 100 AS b, quality, toxic FROM labels""",
    "cache": """SELECT event_id AS id, user_id, event_type, '/c/' || CAST(user_id AS STRING) || '/' || CAST(event_id % 40 AS STRING) AS path,
        event_id % 7 AS size, props, CAST(event_id % 1000 AS DOUBLE) / 100 AS mtime FROM events""",
    "recs": f"""SELECT doc_id AS ord, '/src/' || source || '/' || lang || '/' || {_NAME} AS source, CASE WHEN doc_id % 10 < 8 THEN '/out/' || lang || '/' || CAST(doc_id % 3 AS STRING) || '/' || {_NAME} ELSE '' END AS destination,
        {_pick("doc_id", "camera", "phone", "unknown")} AS device_type, CASE WHEN doc_id % 8 IN (3, 4) THEN 'video' ELSE 'photo' END AS media_type,
        {_pick("doc_id", "Canon", "Xiaomi", "", "Apple")} AS make, {_pick("doc_id", "EOS 700D", "Mi 11", "", "iPhone, 8", "")} AS model,
        CASE WHEN doc_id % 6 <> 0 THEN '2024-01-0' || CAST(doc_id % 9 + 1 AS STRING) || ' 10:30:00' END AS date_taken, doc_id % 2 = 0 AS has_exif_date, n_chars * 64 AS file_size,
        {_pick("doc_id", "ok", "ok", "ok", "dry_run", "ok", "ok", "skipped_dup", "skipped_exists", "skipped_not_target", "error")} AS status,
        CASE WHEN doc_id % 10 = 9 THEN 'can''t read "it"' ELSE '' END AS error_msg, md5(text) AS file_hash, CASE WHEN doc_id % 10 = 6 THEN '/src/first' END AS dup_of,
        CASE WHEN doc_id % 2 = 0 THEN '100' ELSE '' END AS iso, CASE WHEN doc_id % 3 = 0 THEN '28/10' ELSE '' END AS aperture, '1/200' AS shutter, CASE WHEN doc_id % 5 <> 0 THEN '50/1' END AS focal_length,
        CASE WHEN doc_id % 4 = 1 THEN '镜头 50ｍｍ' ELSE '' END AS lens, CASE WHEN doc_id % 7 = 0 THEN '1.5, 2.5' END AS gps FROM documents""",
    "clips": f"""SELECT doc_id AS id, '/dji/' || CAST(CAST(floor(doc_id / 4) AS BIGINT) % 9 AS STRING) || '/' || CASE WHEN doc_id % 4 = 3 AND doc_id % 3 = 0 THEN 'dji_' ELSE 'DJI_' END || CAST(CAST(floor(doc_id / 4) AS BIGINT) AS STRING) ||
        {_pick("doc_id", ".MP4", ".SRT", ".lrf", ".txt")} AS path, n_chars AS size FROM documents""",
    "tree": """SELECT page_id AS id, split_part(split_part(url, '://', 2), '?', 1) AS p FROM pages""",
    "faces": """SELECT vec_id AS id, embedding, label FROM embeddings""",
}
_TABLES = {"files": "documents", "recs": "documents", "clips": "documents", "devices": "part", "scores": "labels", "cache": "events", "tree": "pages", "faces": "embeddings"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        table = _TABLES[name]
        return self.spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {t}").replace("\n", " "), t=self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet"))


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name; sql sees the views named."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
            own = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH {head}, {own[5:]}" if own[:5].upper() == "WITH " else f"WITH {head} {own}") if head else own
        return f

    return add


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_DEVICE_TYPE = f"""CASE WHEN lower(make) = '' THEN 'unknown'
  WHEN lower(make) IN {_list(dims.AMBIGUOUS_BRANDS)} THEN CASE WHEN {_any("lower(model)", dims.SONY_PHONE_KEYWORDS)} THEN 'phone'
    WHEN {_any("lower(model)", dims.SONY_CAMERA_KEYWORDS)} THEN 'camera' ELSE 'unknown' END
  WHEN {_any("lower(make)", dims.CAMERA_BRANDS)} THEN 'camera' WHEN {_any("lower(make)", dims.PHONE_BRANDS)} THEN 'phone' ELSE 'unknown' END"""
_TARGET = f"""(make <> '' AND lower(model) NOT IN {_list(dims.EXCLUDED_TARGETS)}
  AND ({_any("lower(make)", dims.TARGET_BRANDS)} OR {_any("lower(make) || ' ' || lower(model)", dims.TARGET_MODELS)}))"""
_SMALL = f"(media_type = 'photo' AND ((size > 0 AND size < {dims.MIN_FILE_BYTES}) OR (width BETWEEN 1 AND 299 AND height BETWEEN 1 AND 299)))"
_EXT = "lower(regexp_extract(name, '.(\\.[^./]*)$', 1))"
_QUARTER = """'Q' || quarter(d) || '-M' || (quarter(d) * 3 - 2) || '-' || (quarter(d) * 3 - 1) || '-' || (quarter(d) * 3)"""


# ---------------------------------------------------------------- deduplication


@query(f"""SELECT path, dup_of, CASE WHEN dup_of IS NULL THEN 'ok' ELSE 'skipped_dup' END AS status,
  CASE WHEN dup_of IS NULL THEN 'out/' || folder || '/' || name END AS destination
  FROM (SELECT path, name, CASE WHEN row_number() OVER w > 1 THEN first_value(path) OVER w END AS dup_of,
    year(d) || '-' || {_QUARTER} AS folder FROM (SELECT *, make_timestamp(mtime_s * 1000000) AS d FROM files) WINDOW w AS (PARTITION BY hash ORDER BY ord))""", "files")
def dedup_organize(v):
    """F14 W01 F09 F10 R02"""
    found = C.deduplicate(v.files.withColumn("hash", S.fast_hash(F.col("text"))))
    folder = S.date_folder(F.timestamp_seconds("mtime_s"))
    return found.select("path", "dup_of", "status", F.when(F.col("dup_of").isNull(), F.concat_ws("/", F.lit("out"), folder, "name")).alias("destination"))


@query("SELECT id, hash FROM files", "files")
def fast_hash(v):
    return v.files.select("id", S.fast_hash(F.col("text")).alias("hash"))


@query("SELECT path, o AS dup_of FROM (SELECT path, first_value(path) OVER w AS o, row_number() OVER w AS n FROM files WINDOW w AS (PARTITION BY hash ORDER BY ord)) WHERE n > 1", "files")
def dedup_dup_pairs(v):
    """W01 G10"""
    return C.deduplicate(v.files).filter("dup_of is not null").select("path", "dup_of")


@query("""WITH i AS (SELECT hash, min(path) AS p FROM files WHERE id % 3 = 0 GROUP BY hash)
  SELECT path FROM files f WHERE id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.hash = f.hash)""", "files")
def existing_anti_join(v):
    """J05"""
    return P.not_existing(v.files.filter("id % 3 <> 0"), v.files.filter("id % 3 = 0")).select("path")


@query("""WITH x AS (SELECT hash, min(path) FILTER (WHERE id % 14 = 0) AS p, min(path) FILTER (WHERE id % 14 <> 0) AS q FROM files WHERE id % 7 = 0 GROUP BY hash),
  t AS (SELECT *, id % 5 = 0 AS explicit FROM files),
  r AS (SELECT t.path, row_number() OVER w AS n, first_value(t.path) OVER w AS f, CASE WHEN explicit THEN x.p ELSE x.q END AS known
    FROM t LEFT JOIN x USING (hash) WINDOW w AS (PARTITION BY hash, explicit ORDER BY ord))
  SELECT path, CASE WHEN o IS NULL THEN 'ok' ELSE 'skipped_dup' END AS status, coalesce(o, '') AS dup_of
  FROM (SELECT path, coalesce(CASE WHEN known <> path THEN known END, CASE WHEN n > 1 THEN f END) AS o FROM r)""", "files")
def explicit_override_dedup(v):
    """A known hash outside the special folder does not stop an explicit file."""
    index = v.files.filter("id % 7 = 0").select("hash", F.col("path").alias("existing"), (F.col("id") % 14 == 0).alias("special"))
    return C.deduplicate(v.files, index, special=F.col("id") % 5 == 0).select("path", "status", F.coalesce("dup_of", F.lit("")).alias("dup_of"))


@query("SELECT hash, coalesce(min(path) FILTER (WHERE contains(path, 'src1')), min(path)) AS path, count(*) AS copies FROM files GROUP BY hash", "files")
def best_representative(v):
    """G09"""
    return C.best_representative(v.files, album="src1")


@query("SELECT a.path, b.path AS reuse FROM (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY ord) AS n FROM files) a JOIN (SELECT hash, min(path) AS path FROM files WHERE id % 2 = 1 GROUP BY hash) b USING (hash) WHERE n = 1", "files")
def reuse_lookup(v):
    """An entry is used once, by the first file of its hash."""
    return P.reused(v.files, v.files.filter("id % 2 = 1"))


@query("SELECT count(*) AS files, (sum(size) - sum(size) FILTER (WHERE n = 1))::BIGINT AS freed_bytes FROM (SELECT size, row_number() OVER (PARTITION BY hash ORDER BY ord) AS n FROM files)", "files")
def freed_bytes(v):
    """Duplicates go, so what is left is one file of each hash."""
    t = C.deduplicate(v.files)
    return t.agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("status") == "skipped_dup", F.col("size")).otherwise(0)).alias("freed_bytes"))


# ----------------------------------------------------------------- cache joins

_CACHE_HIT = "f.size = c.size AND abs(f.mtime - c.mtime) < 0.01 AND f.mtime > 0 AND c.mtime > 0"


@query(f"WITH c AS (SELECT path, max(size) AS size, max(mtime) AS mtime FROM cache WHERE id % 2 = 1 OR id % 6 = 0 GROUP BY path) SELECT f.id, c.path IS NOT NULL AND {_CACHE_HIT} IS TRUE AS hit FROM cache f LEFT JOIN c ON f.path = c.path", "cache")
def incremental_cache_hits(v):
    """J01 F39"""
    c = v.cache.filter("id % 2 = 1 or id % 6 = 0").groupBy("path").agg(F.max("size").alias("c_size"), F.max("mtime").alias("c_mtime"))
    zero = F.lit(0.0)
    hit = (F.col("size") == F.col("c_size")) & S.same_time(F.col("mtime"), zero, F.col("c_mtime"), zero)
    return v.cache.join(c, "path", "left").select("id", F.coalesce(hit, F.lit(False)).alias("hit"))


@query("WITH n AS (SELECT path, max(id) AS value FROM cache WHERE id % 2 = 0 GROUP BY path), o AS (SELECT path, max(id) AS value FROM cache WHERE id % 3 = 0 GROUP BY path) SELECT path, coalesce(n.value, o.value) AS value FROM n FULL JOIN o USING (path)", "cache")
def cache_merge_precedence(v):
    """J02 S03"""
    new, old = (v.cache.filter(f"id % {k} = 0").groupBy("path").agg(F.max("id").alias("value")) for k in (2, 3))
    return C.upsert(new, old, ["path"])


@query("SELECT id, coalesce(s.coarse, -1) AS score FROM files LEFT JOIN scores s USING (id)", "files", "scores")
def score_cache_left_join(v):
    """J08 S06"""
    return v.files.join(v.scores, "id", "left").select("id", F.coalesce("coarse", F.lit(-1.0)).alias("score"))


@query("SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM cache WHERE json_extract(props, '$.k') IS NOT NULL", "cache")
def json_cache_explode(v):
    """A18"""
    return v.cache.select("id", F.explode(records.cache_entries(F.col("props"), "bigint")).alias("key", "k")).filter("key = 'k' and k is not null").select("id", "k")


@query(r"""SELECT id, id * 3 AS size, CAST(id AS DOUBLE) / 8 AS mtime, CASE WHEN id % 5 <> 0 THEN 'a"b \' || event_type || ' 相' END AS make, [event_type, ''] AS words FROM cache""", "cache")
def cache_roundtrip(v):
    """Quotes, backslashes, other scripts, nulls and lists survive."""
    make = F.when(F.col("id") % 5 != 0, F.concat(F.lit('a"b \\'), "event_type", F.lit(" 相")))
    entry = F.struct((F.col("id") * 3).alias("size"), (F.col("id").cast("double") / 8).alias("mtime"), make.alias("make"), F.array("event_type", F.lit("")).alias("words"))
    text = F.to_json(F.struct(entry.alias("entry")))
    return v.cache.select("id", F.from_json(text, "entry struct<size: bigint, mtime: double, make: string, words: array<string>>").alias("j")).select("id", "j.entry.*")


@query("SELECT id, coarse FROM scores WHERE coarse <> 1.0", "scores")
def cache_clean(v):
    """K15"""
    return v.scores.filter(F.col("coarse") != 1.0).select("id", "coarse")


# ------------------------------------------------------- cleanup and restoring


@query("SELECT path, hash, size FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.id % 8 = 0 AND g.path = f.path)", "files")
def restore_missing(v):
    """J11"""
    return P.missing(v.files, v.files.filter("id % 8 = 0")).select("path", "hash", "size")


@query("WITH o AS (SELECT hash, min(path) AS found FROM files WHERE id % 4 <> 0 GROUP BY hash) SELECT path, found FROM files LEFT JOIN o USING (hash)", "files")
def restore_match(v):
    """J12"""
    return C.restore_matches(v.files.select("path", "hash", "size"), v.files.filter("id % 4 <> 0")).select("path", "found")


@query("WITH t AS (SELECT hash, min(path) AS target FROM files WHERE id % 5 = 0 GROUP BY hash) SELECT path, target, CASE WHEN target IS NULL THEN 'unique' ELSE 'matched' END AS kind FROM files LEFT JOIN t USING (hash)", "files")
def cleanup_hash_match(v):
    """J09"""
    return P.cleanup_matches(v.files, v.files.filter("id % 5 = 0")).select("path", "target", "kind")


_PAIRS = "p AS (SELECT a.path AS source, b.path AS dest FROM files a JOIN (SELECT id - 1 AS id, path || CASE WHEN id % 9 = 0 THEN 'x' ELSE '' END AS path FROM files) b USING (id))"


@query(f"""WITH {_PAIRS} SELECT p.source, dest, CASE WHEN d.size IS NULL THEN 'dest_missing' WHEN s.size <> d.size THEN 'size_mismatch'
  WHEN s.hash <> d.hash THEN 'hash_mismatch' ELSE 'verified' END AS outcome FROM p JOIN files s ON s.path = p.source LEFT JOIN files d ON d.path = dest""", "files")
def cleanup_verify_ladder(v):
    """J10"""
    b = v.files.select((F.col("id") - 1).alias("id"), F.concat("path", F.when(F.col("id") % 9 == 0, "x").otherwise("")).alias("dest"))
    return C.verify_pairs(v.files.select("id", F.col("path").alias("source")).join(b, "id").select("source", "dest"), v.files)


@query("WITH t AS (SELECT DISTINCT hash FROM files WHERE id % 5 = 0) SELECT source, count(*) AS files, count(t.hash) AS matched, sum(CASE WHEN t.hash IS NULL THEN 0 ELSE size END)::BIGINT AS matched_bytes FROM files LEFT JOIN t USING (hash) WHERE id % 5 <> 0 GROUP BY source", "files")
def cleanup_stats(v):
    """G12"""
    t = v.files.filter("id % 5 = 0").select("hash").distinct().withColumn("m", F.lit(1))
    j = v.files.filter("id % 5 <> 0").join(t, "hash", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count("m").alias("matched"), F.sum(F.when(F.col("m") == 1, F.col("size")).otherwise(0)).alias("matched_bytes"))


@query("WITH o AS (SELECT hash, min(path) AS found FROM files WHERE id % 4 <> 0 GROUP BY hash) SELECT count(*) AS missing, count(found) AS restorable, sum(CASE WHEN found IS NOT NULL THEN size ELSE 0 END)::BIGINT AS bytes FROM files LEFT JOIN o USING (hash)", "files")
def restore_stats(v):
    """G13"""
    m = C.restore_matches(v.files.select("path", "hash", "size"), v.files.filter("id % 4 <> 0"))
    return m.agg(F.count(F.lit(1)).alias("missing"), F.count("found").alias("restorable"), F.sum(F.when(F.col("found").isNotNull(), F.col("size")).otherwise(0)).alias("bytes"))


@query("SELECT coalesce(path, '[hash=' || s.id || ', path not found]') AS path, coarse, row_number() OVER (ORDER BY coarse DESC, s.id) AS rank FROM scores s LEFT JOIN (SELECT * FROM files WHERE id % 3 <> 0) f ON s.id = f.id", "files", "scores")
def score_paths(v):
    """A report in one order, numbered without a task that holds all."""
    t = P.score_paths(v.scores.select(F.col("id").alias("hash"), F.struct("coarse", "id").alias("score")), v.files.filter("id % 3 <> 0").select(F.col("id").alias("hash"), "path"))
    return C.numbered(t.select("path", "score.coarse", "score.id"), [-F.col("coarse"), F.col("id")], "rank").select("path", "coarse", "rank")


@query("WITH k AS (SELECT path, lower(name) AS n, id FROM files WHERE id % 2 = 0), b AS (SELECT n, max_by(path, id) AS path FROM k GROUP BY n) SELECT w.id, coalesce(k.path, b.path) AS found FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '/else/' || upper(name) ELSE path END AS path, lower(name) AS n FROM files) w LEFT JOIN k ON w.path = k.path LEFT JOIN b ON w.n = b.n", "files")
def fuzzy_name_match(v):
    """A third of the files is looked for in another folder and case."""
    moved = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/else/"), F.upper("name"))).otherwise(F.col("path"))
    return P.similar_names(v.files.select("id", moved.alias("path")), v.files.filter("id % 2 = 0").select("path", "id")).select("id", "found")


# --------------------------------------------------------------- classification


@query(f"SELECT id, {_DEVICE_TYPE} AS device_type FROM devices", "devices")
def classify_device(v):
    """P01"""
    return v.devices.select("id", S.device_type(F.col("make"), F.col("model")).alias("device_type"))


@query(f"SELECT id, {_TARGET} AS target FROM devices", "devices")
def target_device(v):
    """P02"""
    return v.devices.select("id", S.target_device(F.col("make"), F.col("model")).alias("target"))


_STATUS = f"CASE WHEN t = 'unknown' AND media_type <> 'photo' THEN CASE WHEN make <> '' THEN 'skipped_not_target' ELSE 'skipped_no_device' END WHEN t <> 'unknown' AND NOT target THEN 'skipped_not_target' WHEN t = 'unknown' AND {_SMALL} THEN 'skipped_filtered' ELSE 'ok' END"


def _status(d: DataFrame) -> DataFrame:
    """P03 P04 P05, with unknown photos taken."""
    make, model = F.col("make"), F.col("model")
    t, small = S.device_type(make, model), S.small_image(F.col("media_type"), F.col("size"), F.col("width"), F.col("height"))
    lost = F.when(make != "", "skipped_not_target").otherwise("skipped_no_device")
    status = (
        F.when((t == "unknown") & (F.col("media_type") != "photo"), lost)
        .when((t != "unknown") & ~S.target_device(make, model), "skipped_not_target")
        .when((t == "unknown") & small, "skipped_filtered")
        .otherwise("ok")
    )
    return d.withColumn("device_type", t).withColumn("target", S.target_device(make, model)).withColumn("status", status)


_STATUS_CTE = f"WITH s AS (SELECT *, {_STATUS} AS status FROM (SELECT *, {_DEVICE_TYPE} AS t, {_TARGET} AS target FROM devices))"


@query(f"{_STATUS_CTE} SELECT id, status FROM s", "devices")
def unknown_policy(v):
    return _status(v.devices).select("id", "status")


@query(f"{_STATUS_CTE} SELECT status, media_type, count(*) AS n FROM s GROUP BY ALL", "devices")
def status_ladder(v):
    """P03-P05 G01"""
    return _status(v.devices).groupBy("status", "media_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_STATUS_CTE} SELECT status, count(*) AS n, count(*) FILTER (WHERE media_type = 'video') AS videos FROM s GROUP BY status", "devices")
def status_counts(v):
    """G02"""
    return _status(v.devices).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("media_type") == "video").alias("videos"))


@query(f"SELECT id, make <> '' AND {_any('lower(make)', dims.TARGET_BRANDS)} AS target FROM devices", "devices")
def reporter_target(v):
    """P14"""
    return v.devices.select("id", ((F.col("make") != "") & S.any_of(F.lower("make"), dims.TARGET_BRANDS)).alias("target"))


@query("""WITH votes AS (SELECT dir, make, model, count(*) AS n, min(id) AS f FROM devices WHERE media_type = 'photo' AND make <> '' GROUP BY ALL),
  best AS (SELECT dir, make, model FROM votes QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, f) = 1),
  j AS (SELECT d.*, b.make AS bm, b.model AS bo, media_type = 'video' AND d.make = '' AND b.make IS NOT NULL AS whole,
    coalesce(media_type = 'video' AND d.make <> '' AND d.model = '' AND lower(d.make) = lower(b.make), false) AS part FROM devices d LEFT JOIN best b USING (dir))
  SELECT id, CASE WHEN whole THEN bm ELSE make END AS make, CASE WHEN whole OR part THEN bo ELSE model END AS model, whole OR part AS inferred FROM j""", "devices")
def majority_vote_infer(v):
    """G06 J03"""
    return C.infer_video_device(v.devices).select("id", "make", "model", "inferred")


@query("WITH votes AS (SELECT dir, make, model, count(*) AS n, min(id) AS f FROM devices WHERE media_type = 'photo' AND make <> '' GROUP BY ALL) SELECT count(*) AS folders, sum(n)::BIGINT AS votes FROM (SELECT dir, n FROM votes QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, f) = 1)", "devices")
def infer_counts(v):
    """G22"""
    return C.majority(v.devices.filter("media_type = 'photo' and make <> ''"), ["dir"], ["make", "model"], "id").agg(F.count(F.lit(1)).alias("folders"), F.sum("votes").alias("votes"))


@query("SELECT id, coalesce(bool_or(contains(lower(make), 'dji') OR starts_with(lower(app), 'dji')) OVER (PARTITION BY dir), false) AS in_folder FROM devices", "devices")
def folder_flag_propagate(v):
    """J04"""
    return C.spread_flag(v.devices, S.drone_flag(F.col("make"), F.col("app"))).select("id", "in_folder")


@query("SELECT dir, first(app ORDER BY id) AS label FROM devices WHERE contains(lower(make), 'dji') OR starts_with(lower(app), 'dji') GROUP BY dir", "devices")
def first_label(v):
    """W07"""
    return v.devices.filter(S.drone_flag(F.col("make"), F.col("app"))).groupBy("dir").agg(F.min_by("app", "id").alias("label"))


@query("SELECT id, contains(lower(make), 'dji') OR starts_with(lower(app), 'dji') AS drone FROM devices", "devices")
def drone_flag(v):
    """F26"""
    return v.devices.select("id", S.drone_flag(F.col("make"), F.col("app")).alias("drone"))


def _map_sql(key: str, names: dict[str, str]) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in names.items()) + " END"


#: A name's first code: of the codes of one name the first in the list.
_FIRST_CODES = {name.lower(): code.upper() for code, name in reversed(dims.XIAOMI_NAMES.items())}


@query(f"""WITH a AS (SELECT id, app, coalesce({_map_sql("lower(make)", dims.MAKE_NAMES)}, make) AS mk, model FROM devices),
  b AS (SELECT id, app, mk, CASE WHEN mk <> '' AND starts_with(lower(model), lower(mk)) THEN trim(substr(model, length(mk) + 1)) ELSE model END AS md FROM a),
  c AS (SELECT id, app, mk, coalesce({_map_sql("lower(md)", dims.MODEL_ALIASES)}, md) AS md FROM b),
  e AS (SELECT id, mk, md, lower(mk) AS lo, CASE WHEN contains(lower(mk), 'dji') THEN NULL WHEN {_any("lower(mk)", ("xiaomi", "redmi", "poco"))} THEN {_map_sql("lower(md)", dims.XIAOMI_NAMES)}
    WHEN contains(lower(mk), 'huawei') THEN {_map_sql("lower(md)", dims.HUAWEI_NAMES)} WHEN contains(lower(mk), 'samsung') THEN {_map_sql("lower(md)", dims.SAMSUNG_NAMES)} END AS nm,
    {_map_sql("lower(md)", dims.DRONE_MODELS)} AS dm, CASE {' '.join(f"WHEN contains(lower(app), '{k}') THEN '{x}'" for k, x in dims.DRONE_APPS.items())} END AS da,
    CASE WHEN {_any("lower(mk)", ("xiaomi", "redmi", "poco"))} AND {_map_sql("lower(md)", dims.XIAOMI_NAMES)} IS NULL THEN {_map_sql("lower(trim(mk || ' ' || md))", _FIRST_CODES)} END AS code FROM c)
  SELECT id, CASE WHEN mk = '' AND md = '' THEN '{dims.UNKNOWN_MODEL}' WHEN contains(lo, 'dji') AND coalesce(dm, da) IS NOT NULL THEN coalesce(dm, da)
    WHEN code IS NOT NULL THEN mk || ' ' || md || ' ' || code WHEN nm IS NOT NULL AND starts_with(lower(nm), lo) THEN nm || ' ' || md
    WHEN nm IS NOT NULL THEN mk || ' ' || nm || ' ' || md ELSE trim(mk || ' ' || md) END AS label FROM e""", "devices")
def device_label(v):
    """F11 F12 F13 J15"""
    return C.label_devices(v.devices, "make", "model", "app").select("id", "label")


@query(r"""WITH p AS (SELECT id, make || ' ' || model AS label, CASE WHEN id % 3 = 0 THEN '/out/All_3_' || dir[2:] || '/' || lower(make) || ' ' || model || ' (second)/f' ELSE dir || '/f' END AS path FROM devices)
  SELECT id, CASE WHEN starts_with(path, '/d1/') THEN label || ' (one)' WHEN starts_with(path, '/d2/') THEN label || ' (two)'
    WHEN starts_with(path, '/out/') AND trim(label) = label AND lower(trim(replace(split_part(path, '/', 4), ' (second)', ''))) = lower(label) THEN split_part(path, '/', 4)
    ELSE label END AS label FROM p""", "devices")
def device_suffixes(v):
    """F12"""
    label = F.concat_ws(" ", "make", "model")
    below = F.concat(F.lit("/out/All_3_"), F.expr("substring(dir, 2)"), F.lit("/"), F.lower("make"), F.lit(" "), F.col("model"), F.lit(" (second)/f"))
    path = F.when(F.col("id") % 3 == 0, below).otherwise(F.concat("dir", F.lit("/f")))
    return v.devices.select("id", S.device_suffix(label, path, {"/d1": "one", "/d2": "two"}, "/out").alias("label"))


@query(f"{_STATUS_CTE} SELECT make, model, t AS device_type, count(*) AS count, count(*) FILTER (WHERE media_type = 'video') AS videos, count(*) FILTER (WHERE media_type <> 'video') AS photos FROM s GROUP BY ALL", "devices")
def device_stats(v):
    """G03"""
    video = F.col("media_type") == "video"
    return _status(v.devices).groupBy("make", "model", "device_type").agg(F.count(F.lit(1)).alias("count"), F.count_if(video).alias("videos"), F.count_if(~video).alias("photos"))


@query(f"{_STATUS_CTE} SELECT dir, count(*) AS total, count(*) FILTER (WHERE t = 'camera') AS camera, count(*) FILTER (WHERE t = 'phone') AS phone, count(*) FILTER (WHERE t = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'ok') AS copied, count(*) FILTER (WHERE status = 'skipped_filtered') AS filtered FROM s GROUP BY dir", "devices")
def folder_stats(v):
    """G04"""
    n = lambda c: F.count_if(c)
    t, s = F.col("device_type"), F.col("status")
    return _status(v.devices).groupBy("dir").agg(
        F.count(F.lit(1)).alias("total"), n(t == "camera").alias("camera"), n(t == "phone").alias("phone"), n(t == "unknown").alias("unknown"),
        n(s == "ok").alias("copied"), n(s == "skipped_filtered").alias("filtered"),
    )


@query("SELECT make, model, n, row_number() OVER (ORDER BY n DESC, make, model) AS rank FROM (SELECT make, model, count(*) AS n FROM devices GROUP BY ALL)", "devices")
def ranked_devices(v):
    """T02 W06"""
    t = v.devices.groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "make", "model")).cast("long"))


@query("SELECT id FROM devices WHERE contains(lower(make), 'so') AND contains(lower(model), 'x')", "devices")
def report_filter(v):
    """P15"""
    wanted = {"make": "SO", "model": "x"}
    out = v.devices
    for c, text in wanted.items():
        out = out.filter(F.contains(F.lower(c), F.lit(text.lower())))
    return out.select("id")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE media_type = 'photo') AS photos, count(*) FILTER (WHERE media_type = 'video') AS videos, count(*) FILTER (WHERE status IN ('ok', 'dry_run')) AS copied, count(*) FILTER (WHERE status IN ('skipped_dup', 'skipped_exists')) AS duplicates, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status IN ('ok', 'dry_run') AND starts_with(destination, '/out/en/')) AS explicit, count(*) FILTER (WHERE status IN ('ok', 'dry_run') AND starts_with(destination, '/out/de/')) AS documents FROM recs", "recs")
def run_counts(v):
    """G01 G07"""
    return reports.run_summary(v.recs, "/OUT/en", "/out/de").select("total", "photos", "videos", "copied", "duplicates", "errors", "explicit", "documents")


# ---------------------------------------------------------------------- scalars


@query(f"SELECT o_orderkey AS id, year(d) || '-' || {_QUARTER} AS folder FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")
def quarter_folder(v):
    """F09 F10"""
    return v.orders.select(F.col("o_orderkey").alias("id"), S.date_folder(F.col("o_orderdate")).alias("folder"))


@query("SELECT o_orderkey AS id, o_orderdate AS parsed FROM orders")
def exif_dates(v):
    """F01, over the layouts."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-M-d H:m:s")).otherwise(F.date_format("o_orderdate", "yyyy年MM月dd日 HH时mm分ss"))
    return v.orders.select(F.col("o_orderkey").alias("id"), S.exif_datetime(text).alias("parsed"))


@query("SELECT o_orderkey AS id, o_orderdate AS parsed FROM orders")
def iso_dates(v):
    """F02"""
    k = F.col("o_orderkey") % 2
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return v.orders.select(F.col("o_orderkey").alias("id"), S.iso_datetime(text).alias("parsed"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN date_trunc('day', o_orderdate)::TIMESTAMP WHEN o_orderkey % 5 IN (2, 4) THEN o_orderdate + INTERVAL 600000000 SECOND ELSE o_orderdate END AS parsed FROM orders")
def filename_dates(v):
    """F03-F06"""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    seconds = (F.unix_timestamp(d.cast("timestamp")) + 600_000_000).cast("string")
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), F.date_format(d, "yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k == 1, F.concat(F.date_format(d, "yyyy-MM-dd HH.mm.ss"), F.lit(".png")))
        .when(k == 2, F.concat(F.lit("mmexport"), seconds, F.lit("000.jpg")))
        .when(k == 4, F.concat(seconds, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("DSC_"), F.date_format(d, "yyyyMMdd"), F.lit(".jpg")))
    )
    return v.orders.select(F.col("o_orderkey").alias("id"), S.name_datetime(name, F.lit("2026-01-01").cast("timestamp")).alias("parsed"))


@query("""SELECT o_orderkey AS id, CASE WHEN k = 0 THEN o_orderdate WHEN o_orderdate <= TIMESTAMP '2000-01-02' AND k <> 3 THEN o_orderdate WHEN k >= 2 AND year(o_orderdate) <= 2000 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS taken
  FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def effective_date(v):
    """Metadata, a plausible file time, the name's date if its year is, none."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    name = F.when(k >= 2, F.concat(F.lit("DSC_"), F.date_format(d, "yyyyMMdd"), F.lit(".jpg"))).otherwise("x.jpg")
    mtime = F.when(k != 3, d).otherwise(F.lit("1975-01-01").cast("timestamp_ntz"))
    return v.orders.select(F.col("o_orderkey").alias("id"), S.effective_date(d, k == 0, mtime, name, F.lit("2000-01-01").cast("timestamp_ntz")).alias("taken"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN CASE WHEN q = 1 THEN '1' ELSE '1/' || q END WHEN k = 1 THEN CASE WHEN q = 1 THEN '1/2' WHEN q % 2 = 0 THEN (q // 2)::VARCHAR ELSE (q // 2) || '.5' END WHEN k = 2 THEN q || '/0' ELSE 'f' || q END AS shown
  FROM (SELECT *, l_orderkey % 4 AS k, l_quantity::BIGINT AS q FROM lineitem)""")
def fraction_format(v):
    """F16: parts of a second, halves, a division by zero and no fraction at all."""
    q, k = F.col("l_quantity").cast("long").cast("string"), F.col("l_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("1/"), q)).when(k == 1, F.concat(q, F.lit("/2"))).when(k == 2, F.concat(q, F.lit("/0"))).otherwise(F.concat(F.lit("f"), q))
    return v.lineitem.select("l_orderkey", "l_linenumber", S.fraction(text).alias("shown"))


def _size(s: str, gap: str = "") -> str:
    steps = [f"WHEN {s} < {1024 ** (k + 1)} THEN printf('%.1f{gap}{u}', {s}::DOUBLE / {1024**k})" for k, u in enumerate(("KB", "MB", "GB"), 1)]
    return f"(CASE WHEN {s} < 1024 THEN {s} || '{'.0 ' if gap else ''}B' {' '.join(steps)} ELSE printf('%.1f{gap}TB', {s}::DOUBLE / {1024**4}) END)"


@query(f"SELECT id, {_size('s')} AS shown FROM (SELECT id, id % 1000 * 1024 * CASE id % 4 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 2147483648 ELSE 1 END AS s FROM files)", "files")
def human_size(v):
    """F17, from bytes to terabytes"""
    k = F.col("id") % 4
    scale = F.when(k == 1, F.lit(1024)).when(k == 2, F.lit(1048576)).when(k == 3, F.lit(2147483648)).otherwise(F.lit(1))
    return v.files.select("id", S.human_size(F.col("id") % 1000 * 1024 * scale).alias("shown"))


@query(f"SELECT id, {_size('s', ' ')} AS shown FROM (SELECT id, id % 1000 * 512 * CASE WHEN id % 2 = 0 THEN 1 ELSE 524288 END AS s FROM files)", "files")
def report_size(v):
    """F18"""
    return v.files.select("id", S.human_size(F.col("id") % 1000 * 512 * F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.lit(524288)), spaced=True).alias("shown"))


@query("SELECT p_partkey AS id, trim('ISO' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' f/' || p_size ELSE '' END || CASE WHEN p_size = 1 THEN ' 1s' ELSE ' 1/' || p_size || 's' END) AS shown FROM part")
def exposure_params(v):
    """F19"""
    size = F.col("p_size").cast("string")
    return v.part.select(F.col("p_partkey").alias("id"), S.exposure(size, F.when(F.col("p_partkey") % 2 == 0, size), F.concat(F.lit("1/"), size), F.lit("")).alias("shown"))


@query("SELECT p_partkey AS id, round(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END * (p_partkey % 90 + CAST(p_size AS DOUBLE) / 60 + 0.5 / 3600), 6) AS degrees FROM part")
def gps_decimal(v):
    """F20"""
    ref = F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("N")
    return v.part.select(F.col("p_partkey").alias("id"), F.round(S.gps_decimal(F.col("p_partkey") % 90, F.col("p_size").cast("double"), F.lit(0.5), ref), 6).alias("degrees"))


@query("SELECT id FROM files WHERE contains(lower(name), 'screenshot')", "files")
def screenshot_filter(v):
    """F24"""
    return v.files.filter(S.screenshot(F.col("name"))).select("id")


@query(f"SELECT id, CASE WHEN {_EXT} IN {_list(dims.VIDEO_EXTENSIONS)} THEN 'video' ELSE 'photo' END AS kind FROM files WHERE {_EXT} IN {_list(dims.VIDEO_EXTENSIONS + dims.IMAGE_EXTENSIONS)}", "files")
def ext_filter(v):
    """A05 S02"""
    return v.files.select("id", S.media_type(F.col("name")).alias("kind")).filter("kind is not null")


@query(f"SELECT id FROM tree WHERE len(list_filter(string_split(p, '/')[:-2], lambda x: lower(x) IN {_list((*dims.EXCLUDED_DIRS, 'en'))} OR x LIKE '.%' OR x LIKE '$%')) = 0", "tree")
def dir_prune(v):
    """A04, with one more excluded name."""
    names = (*dims.EXCLUDED_DIRS, "en")
    parts = F.split("p", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda x: F.lower(x).isin(*names) | x.startswith(".") | x.startswith("$"))
    return v.tree.filter(~bad).select("id")


@query("SELECT id, starts_with(lower(name), 'c360_') AS own, CASE WHEN starts_with(lower(name), 'c360_') THEN 'Xiaomi' END AS make FROM files", "files")
def prefix_infer(v):
    """F41"""
    make = S.named_device(F.col("name"))
    return v.files.select("id", make.isNotNull().alias("own"), make.alias("make"))


@query("SELECT id, name FROM files", "files")
def po_strip(v):
    """F42"""
    with_suffix = F.regexp_replace("name", r"(\.[^.]+)$", "_PO12$1")
    return v.files.select("id", S.natural_name(with_suffix).alias("name"))


@query("SELECT id, regexp_extract(path, '[^/]*$') AS base, dir, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext FROM files", "files")
def path_parts(v):
    """F23"""
    path = F.col("path")
    base = F.substring_index(path, "/", -1)
    return v.files.select("id", base.alias("base"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.regexp_extract(base, r"(\.[^.]*)$", 1).alias("ext"))


@query("SELECT id, round(exp(a) / (exp(a) + exp(b)), 9) AS p FROM scores", "scores")
def softmax_pick(v):
    """F27"""
    return v.scores.select("id", F.round(F.element_at(S.softmax(F.array("a", "b")), 1), 9).alias("p"))


@query("SELECT p_partkey AS id, CAST((p_partkey % 3) * 3600 + p_size * 60 + 7 AS DOUBLE) + 0.5 AS seconds FROM part")
def duration_parse(v):
    """F32"""
    text = F.format_string("  Duration: %02d:%02d:07.50, start: 0", (F.col("p_partkey") % 3).cast("int"), F.col("p_size"))
    return v.part.select(F.col("p_partkey").alias("id"), S.duration(text).alias("seconds"))


@query("SELECT p_partkey AS id, u.i AS frame, round(u.i * greatest(s / 4, 1.0), 6) AS at FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 30.0 ELSE CAST(p_size AS DOUBLE) / 3 END AS s FROM part), (SELECT unnest([1, 2, 3]) AS i) u WHERE u.i * greatest(s / 4, 1.0) < s")
def frame_timestamps(v):
    """F31"""
    seconds = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double") / 3)
    t = v.part.select(F.col("p_partkey").alias("id"), F.posexplode(S.frame_times(seconds)).alias("frame", "at"))
    return t.select("id", (F.col("frame") + 1).alias("frame"), F.round("at", 6).alias("at"))


# ----------------------------------------------------------------------- scores


@query("SELECT id, round(CASE WHEN a < 0.15 THEN 0.15 * greatest(a, b) WHEN greatest(a, b) >= 0.8 THEN greatest(a, b) WHEN a >= 0.4 AND b >= 0.4 THEN greatest(a, b) ELSE 0.3 * greatest(a, b) END, 9) AS score FROM scores", "scores")
def fuse_scores(v):
    """F29 L05"""
    return v.scores.select("id", F.round(S.fuse(F.col("a"), F.col("b")), 9).alias("score"))


@query("SELECT id, CASE WHEN coarse >= 0.3 THEN fine ELSE 0 END AS score FROM scores", "scores")
def cascade_scores(v):
    """The second scorer sees only what the first one suspects.  The scorers read
    their number from the text that stands for a picture."""
    pictures = v.scores.select("id", F.concat_ws(",", "coarse", "fine").alias("picture"))
    first, second = (lambda k: lambda: lambda texts: texts.str.split(",").str[k].astype(float))(0), (lambda k: lambda: lambda texts: texts.str.split(",").str[k].astype(float))(1)
    return people.cascade(pictures, "picture", first, second).select("id", "score")


@query("SELECT id, greatest(CASE WHEN a >= 0.5 THEN a ELSE 0 END, CASE WHEN b >= 0.5 THEN b ELSE 0 END) AS score FROM scores", "scores")
def detection_max(v):
    """F30"""
    parts = F.array(F.struct(F.lit("A").alias("class"), F.col("a").alias("score")), F.struct(F.lit("B").alias("class"), F.col("b").alias("score")), F.struct(F.lit("C").alias("class"), F.col("fine").alias("score")))
    return v.scores.select("id", S.detection_score(parts, ("A", "B")).alias("score"))


@query("SELECT id % 50 AS clip, max(CASE WHEN coarse >= 0.3 THEN fine ELSE 0 END) AS score FROM scores GROUP BY ALL", "scores")
def frame_max_score(v):
    """G21 L03"""
    return v.scores.groupBy((F.col("id") % 50).alias("clip")).agg(F.max(F.when(F.col("coarse") >= 0.3, F.col("fine")).otherwise(0.0)).alias("score"))


@query("SELECT least(floor(coarse * 10 + 1e-9), 9)::BIGINT AS bin, count(*) AS n FROM scores GROUP BY ALL", "scores")
def score_histogram(v):
    """G14"""
    return v.scores.groupBy(F.least(F.floor(F.col("coarse") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN coarse = 1 THEN 'fake' WHEN coarse >= 0.8 THEN 'high' WHEN coarse >= 0.5 THEN 'mid' WHEN coarse >= 0.3 THEN 'low' ELSE 'none' END AS bucket, count(*) AS n FROM scores GROUP BY ALL", "scores")
def score_buckets(v):
    """G15"""
    c = F.col("coarse")
    return v.scores.groupBy(F.when(c == 1, "fake").when(c >= 0.8, "high").when(c >= 0.5, "mid").when(c >= 0.3, "low").otherwise("none").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t.t AS threshold, count(*) FILTER (WHERE coarse >= t.t) AS n FROM scores, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS t) t GROUP BY ALL", "scores")
def threshold_curve(v):
    """One pass, one counter per threshold."""
    steps = (0.1, 0.3, 0.5, 0.7, 0.9)
    row = v.scores.agg(*[F.count_if(F.col("coarse") >= t).alias(str(k)) for k, t in enumerate(steps)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(k)).alias("n")) for k, t in enumerate(steps)])).alias("s")).select("s.*")


@query("SELECT id, fine, row_number() OVER (ORDER BY fine DESC, id) AS rank FROM scores WHERE fine BETWEEN 0.4 AND 0.6 ORDER BY fine DESC, id LIMIT 20", "scores")
def score_band_topk(v):
    """T07"""
    top = v.scores.filter(F.col("fine").between(0.4, 0.6)).orderBy(F.desc("fine"), "id").limit(20)
    return top.select("id", "fine", F.row_number().over(Window.orderBy(F.desc("fine"), "id")).cast("long").alias("rank"))


@query("SELECT id, coarse FROM scores ORDER BY coarse DESC, id LIMIT 50", "scores")
def top_scores(v):
    """T04"""
    return v.scores.orderBy(F.desc("coarse"), "id").limit(50).select("id", "coarse")


@query("SELECT id, coarse FROM scores ORDER BY id LIMIT 500", "scores")
def first_n(v):
    """T05"""
    return v.scores.orderBy("id").limit(500).select("id", "coarse")


@query("SELECT dir, count(*) AS n FROM files GROUP BY dir ORDER BY n DESC, dir LIMIT 30", "files")
def top_groups(v):
    """T06 G19"""
    return v.files.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(30)


@query("SELECT id, path FROM files ORDER BY md5('7:' || path), path LIMIT 200", "files")
def random_sample(v):
    """T08"""
    return C.random_sample(v.files.select("id", "path"), 200, "path", 7)


@query("""SELECT media, count(*) AS files, CASE WHEN s > 0 THEN b / 1048576 / s ELSE 0 END AS mb_per_s, CASE WHEN s > 0 THEN count(*) / s ELSE 0 END AS files_per_s
  FROM (SELECT media, sum(size) OVER w::DOUBLE AS b, (max(mtime_s) OVER w - min(mtime_s) OVER w)::DOUBLE AS s FROM files WINDOW w AS (PARTITION BY media)) GROUP BY media, b, s""", "files")
def copy_throughput(v):
    """G24"""
    return C.throughput(v.files.withColumn("at", F.timestamp_seconds("mtime_s")), "media")


@query("SELECT dir, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY dir", "files")
def dir_counts(v):
    """G19"""
    return v.files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("SELECT c AS class, count(*) AS n FROM (SELECT unnest([CASE WHEN a >= 0.5 THEN 'A' END, CASE WHEN b >= 0.5 THEN 'B' END, CASE WHEN fine >= 0.5 THEN 'C' END]) AS c FROM scores) WHERE c IS NOT NULL GROUP BY ALL", "scores")
def class_frequency(v):
    """G17"""
    named = F.array_compact(F.array(*[F.when(F.col(c) >= 0.5, k) for c, k in (("a", "A"), ("b", "B"), ("fine", "C"))]))
    return v.scores.select(F.explode(named).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE '2' END AS label FROM scores", "scores")
def label_lookup(v):
    """The code itself where no label is known."""
    code = F.when(F.col("toxic") == 1, "0").when(F.col("quality") == 1, "1").otherwise("2")
    return v.scores.select("id", F.coalesce(S.lookup(code, {"0": "toxic", "1": "good"}), code).alias("label"))


@query("SELECT id, (a >= 0.45)::INT + (b >= 0.45)::INT AS loose, (a >= 0.6)::INT + (b >= 0.6)::INT AS strict FROM scores", "scores")
def two_tier_parts(v):
    """L13"""
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("score")) for c in ("a", "b")])
    return v.scores.select("id", F.size(P.class_parts(parts, 0.45)).alias("loose"), F.size(P.class_parts(parts, 0.6)).alias("strict"))


@query("SELECT id, a AS first, b AS second, CAST(NULL AS DOUBLE) AS other, a + b AS total FROM scores", "scores")
def detail_map(v):
    """L06"""
    m = P.detail(("x", "y"), F.array("a", "b"))
    return v.scores.select("id", F.element_at(m, "x").alias("first"), F.element_at(m, "y").alias("second"), F.try_element_at(m, F.lit("z")).alias("other"), F.aggregate(F.map_values(m), F.lit(0.0), lambda x, y: x + y).alias("total"))


@query("SELECT id, round(coarse, 2) AS score, '/p ' || id || ' | x' AS path FROM scores WHERE id % 9 <> 0", "scores")
def score_list_parse(v):
    """What K14 writes is read back; comments and blank lines are no rows."""
    line = F.when(F.col("id") % 18 == 0, F.concat(F.lit("# "), F.col("id").cast("string"))).when(F.col("id") % 9 == 0, "").otherwise(F.format_string("%.2f | /p %d | x", "coarse", "id"))
    return v.scores.select("id", records.score_line(line).alias("p")).filter("p is not null").select("id", "p.score", "p.path")


@query("SELECT id, round(coarse, 4) AS coarse, CASE WHEN id % 4 <> 0 THEN greatest(round(a, 2), round(b, 2)) END AS top, '/x/' || id || ' y.jpg' AS path, CASE WHEN id % 4 = 0 THEN 0 ELSE 2 END AS parts FROM scores", "scores")
def detection_parse(v):
    """What K14 writes is read back, with parts and without."""
    part = F.array(*[F.struct(F.lit(c).alias("class"), F.col(x).alias("score")) for c, x in (("AA", "a"), ("BB", "b"))])
    lines = reports.detection_lines(v.scores.select("coarse", F.when(F.col("id") % 4 != 0, part).otherwise(F.array().cast("array<struct<class:string,score:double>>")).alias("parts"), F.format_string("/x/%d y.jpg", "id").alias("path")))
    t = lines.select(records.detection_line(F.col("line")).alias("d")).select("d.*")
    found = F.array_max(F.transform("parts", lambda p: p["score"]))
    return t.select(F.regexp_extract("path", "/x/([0-9]+)", 1).cast("long").alias("id"), "coarse", found.alias("top"), "path", F.size("parts").alias("parts"))


# ------------------------------------------------------------- eligibility, routes

_RAW = _list(dims.RAW_EXTENSIONS)


@query(f"SELECT id FROM files WHERE media <> 'companion' AND {_EXT} NOT IN {_RAW} AND id % 6 <> 5", "files")
def eligible_explicit(v):
    """P09 F25"""
    return v.files.filter(P.explicit_eligible(F.col("name"), F.col("id") % 6 != 5)).select("id")


@query(f"SELECT id FROM files WHERE media = 'photo' AND {_EXT} NOT IN {_RAW} AND NOT contains(lower(name), 'screenshot') AND NOT starts_with(name, 'DJI') AND id % 7 <> 0 AND id % 6 <> 5", "files")
def eligible_document(v):
    """P10"""
    device = F.when(F.col("id") % 7 == 0, "camera").otherwise("phone")
    return v.files.filter(P.document_eligible(F.col("name"), F.col("id") % 6 != 5, F.startswith("name", F.lit("DJI")), device)).select("id")


@query("SELECT file_hash AS hash, max_by(destination, ord) AS path FROM recs WHERE status IN ('ok', 'dry_run') AND destination <> '' AND NOT starts_with(lower(destination), '/out/en/1/') AND regexp_matches(lower(destination), '\\.(jpg|png)$') GROUP BY ALL", "recs")
def eligible_face(v):
    """The last record of a hash counts."""
    return people.eligible_files(v.recs, "/out/EN/1")


@query("""SELECT id AS hash, f AS face FROM (SELECT id, unnest([0, 1]) AS f FROM faces) WHERE CASE WHEN f = 0 THEN id % 90 >= 40 AND id % 70 >= 40 AND CAST(id % 100 AS DOUBLE) / 100 >= 0.5 ELSE id % 11 <> 0 END""", "faces")
def face_quality(v):
    """Of two faces of a file, the sure and large ones that have a vector."""
    def face(wide, high, score, vector):
        return F.struct(F.array(F.lit(5), F.lit(7), (wide + 5).cast("int"), (high + 7).cast("int")).alias("bbox"), vector.alias("embedding"), score.alias("score"))

    i, text = F.col("id"), F.lit("AAAA")
    faces = F.array(face(i % 90, i % 70, (i % 100).cast("double") / 100, text), face(F.lit(40), F.lit(40), F.lit(0.5).cast("double"), F.when(i % 11 != 0, text)))
    return people.good_faces(v.faces.select(i.alias("hash"), faces.alias("faces"))).select("hash", "face")


@query("SELECT id, id % 5 IN (0, 1, 3, 4) AS classified, id % 5 = 3 OR id % 5 = 4 AS frozen, id % 5 <> 2 AS protected FROM devices", "devices")
def already_classified(v):
    """P06 P07 P13"""
    folder = F.element_at(F.array(*[F.lit(x) for x in ("All_1_x", "ALL_5_y", "misc", "All_7_d", "all_999_e")]), (F.col("id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", F.lit("/Out"), folder, F.lit("a.jpg"))
    return v.devices.select("id", S.classified(path, "/out").alias("classified"), S.frozen(path, "/out").alias("frozen"), (~path.startswith("/Out/misc")).alias("protected"))


@query(f"""SELECT path, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 AND id % 4 <> 0 THEN path ELSE '/out/{dims.ROOTS["unknown"]}/{dims.UNKNOWN_DATE}/' || id || '.jpg' END AS destination, id % 3 = 0 OR id % 3 = 1 AND id % 4 <> 0 AS in_place
  FROM (SELECT id, CASE id % 3 WHEN 0 THEN '/OUT/All_999_x/' WHEN 1 THEN CASE WHEN id % 4 = 0 THEN '/out/All_6_x/' ELSE '/out/all_1_x/' END ELSE '/in/' END || id || '.jpg' AS path FROM devices)""", "devices")
def no_downgrade(v):
    """Frozen files stay, and so do those of a device folder that would go to the unknown ones."""
    i = F.col("id")
    folder = F.when(i % 3 == 0, "/OUT/All_999_x/").when(i % 3 == 1, F.when(i % 4 == 0, "/out/All_6_x/").otherwise("/out/all_1_x/")).otherwise("/in/")
    none = F.lit(None)
    t = v.devices.select(
        F.concat(folder, i.cast("string"), F.lit(".jpg")).alias("path"), F.lit("unknown").alias("device_type"), F.lit(False).alias("target"), F.lit("x").alias("label"), none.cast("timestamp").alias("date"),
        F.lit(False).alias("has_exif"), F.lit(False).alias("drone"), none.cast("double").alias("explicit_score"), none.cast("double").alias("document_score"),
    )
    return P.routed(t, "/out").select("path", "destination", "in_place")


@query(f"""WITH t AS (SELECT f.id, name, path, coarse, a, s.id % 3 AS k, make_timestamp(mtime_s * 1000000) AS d, f.id % 2 = 0 AS exif FROM files f JOIN scores s USING (id)),
  p AS (SELECT *, year(d) || '-' || {_QUARTER} AS folder, contains(lower(name), 'screenshot') AS shot, starts_with(name, 'DJI') AS drone FROM t),
  b AS (SELECT *, CASE WHEN shot THEN '{dims.ROOTS["document"]}/{dims.ROOTS["screenshot"]}/' || CASE WHEN k < 2 THEN 'label/' ELSE '' END || folder
    ELSE CASE k WHEN 0 THEN '{dims.ROOTS["camera"]}/label/' WHEN 1 THEN '{dims.ROOTS["phone"]}/label/' ELSE '{dims.ROOTS["unknown"]}/' END || folder || CASE WHEN k = 2 AND NOT exif THEN '{dims.BY_FILE_TIME}' ELSE '' END END || '/' || name AS base FROM p),
  c AS (SELECT *, CASE WHEN drone THEN '{dims.ROOTS["drone"]}/label/' || folder || '/' || name WHEN NOT shot AND k <> 0 AND a >= 0.5 THEN '{dims.ROOTS["document"]}/' || base ELSE base END AS base2 FROM b)
  SELECT id, '/out/' || CASE WHEN coarse >= 0.5 THEN '{dims.ROOTS["explicit"]}/' ELSE '' END || base2 AS dest, CASE WHEN coarse >= 0.5 THEN printf('%.3f', coarse) END AS tag FROM c""", "files", "scores")
def route_precedence(v):
    """Later rules override earlier ones."""
    k = F.col("id") % 3
    t = v.files.join(v.scores, "id").select(
        "id", "path", F.when(k == 0, "camera").when(k == 1, "phone").otherwise("unknown").alias("device_type"), F.lit(True).alias("target"), F.lit("label").alias("label"), F.timestamp_seconds("mtime_s").alias("date"),
        (F.col("id") % 2 == 0).alias("has_exif"), F.startswith("name", F.lit("DJI")).alias("drone"), F.col("coarse").alias("explicit_score"), F.col("a").alias("document_score"),
    )
    return P.routed(t, "/out").select("id", F.col("destination").alias("dest"), F.col("explicit_tag").alias("tag"))


@query(f"SELECT id, '{dims.ROOTS['document']}/' || substr(path, 6) AS document, 'drone/label/' || name AS drone, printf('%.3f', CAST(id % 101 AS DOUBLE) / 100) AS tag FROM files", "files")
def dest_variants(v):
    """R03-R06"""
    return v.files.select(
        "id", F.concat_ws("/", F.lit(dims.ROOTS["document"]), F.expr("substring(path, 6)")).alias("document"),
        F.concat_ws("/", F.lit("drone"), F.lit("label"), "name").alias("drone"), F.format_string("%.3f", (F.col("id") % 101).cast("double") / 100).alias("tag"),
    )


@query(r"""WITH plan AS (SELECT id, '/o/' || CASE WHEN id % 2 = 0 THEN 'N' ELSE 'n' END || id % 60 || CASE WHEN id % 7 = 3 THEN '_po' || (id % 5 + 1) ELSE '' END || '.jpg' AS dest FROM files),
  taken AS (SELECT DISTINCT '/O/n' || id % 60 || CASE WHEN id % 4 = 0 THEN '_PO2' WHEN id % 4 = 1 THEN '_po4' ELSE '' END || '.JPG' AS dest FROM files WHERE id % 60 < 30),
  used AS (SELECT lower(dest) AS u FROM plan UNION SELECT lower(dest) FROM taken),
  q AS (SELECT id, dest, lower(dest) AS k, row_number() OVER (PARTITION BY lower(dest) ORDER BY id) - 1 + CASE WHEN lower(dest) IN (SELECT lower(dest) FROM taken) THEN 1 ELSE 0 END AS n FROM plan),
  g AS (SELECT k, max(n) AS m FROM q GROUP BY k),
  free AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM (SELECT k, unnest(generate_series(1, m + 10)) AS i FROM g) WHERE replace(k, '.jpg', '_po' || i || '.jpg') NOT IN (SELECT u FROM used))
  SELECT q.id, CASE WHEN q.n = 0 THEN dest ELSE replace(dest, '.jpg', '_po' || free.i || '.jpg') END AS final FROM q LEFT JOIN free ON free.k = q.k AND free.n = q.n""", "files")
def conflict_names(v):
    """Names in both cases, natural names with the suffix, and names that are taken."""
    i = F.col("id")
    number = (i % 60).cast("string")
    suffix = F.when(i % 7 == 3, F.concat(F.lit("_po"), (i % 5 + 1).cast("string"))).otherwise("")
    plan = v.files.select("id", "ord", F.concat(F.lit("/o/"), F.when(i % 2 == 0, "N").otherwise("n"), number, suffix, F.lit(".jpg")).alias("dest"))
    there = F.when(i % 4 == 0, "_PO2").when(i % 4 == 1, "_po4").otherwise("")
    taken = v.files.filter(i % 60 < 30).select(F.concat(F.lit("/O/n"), number, there, F.lit(".JPG")).alias("dest"))
    return C.resolve_names(plan, taken).select("id", "final")


@query("""WITH m AS (SELECT DISTINCT label, CAST(floor(id / 2) AS BIGINT) AS hash FROM faces), p AS (SELECT *, '/p/' || hash % 50 || '.jpg' AS path FROM m WHERE hash % 13 <> 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY label, path ORDER BY hash) - 1 AS n FROM p)
  SELECT '人物_' || printf('%03d', label + 1) AS person, hash, '/all/人物_' || printf('%03d', label + 1) || '/' || hash % 50 || CASE WHEN n > 0 THEN '_f' || n ELSE '' END || '.jpg' AS link FROM n""", "faces")
def link_names(v):
    """One link for each file of a person, past the names of others."""
    hash = F.floor(F.col("id") / 2).cast("long")
    found = v.faces.select(F.format_string("人物_%03d", F.col("label") + 1).alias("person"), hash.alias("hash"))
    files = v.faces.select(hash.alias("hash")).distinct().filter("hash % 13 <> 0").withColumn("path", F.concat(F.lit("/p/"), (F.col("hash") % 50).cast("string"), F.lit(".jpg")))
    return people.album(found, files, "/all").select("person", "hash", "link")


@query(r"""WITH a AS (SELECT id, path, regexp_extract(path, '^(.*/)', 1) AS dir, regexp_extract(path, '([^/]*)\.[^.]*$', 1) AS stem FROM clips WHERE id % 4 = 0 AND id % 5 <> 0)
  SELECT c.path AS source, '/out/' || a.id % 7 || '/' || regexp_extract(c.path, '[^/]*$') AS destination, a.id AS ord FROM clips c JOIN a ON a.dir = regexp_extract(c.path, '^(.*/)', 1) AND a.stem = regexp_extract(c.path, '([^/]*)\.[^.]*$', 1)
  WHERE c.id % 4 <> 0""", "clips")
def companion_join(v):
    """Files beside an accepted drone clip, with its very stem, that are no media."""
    a = v.clips.filter("id % 4 = 0 and id % 5 <> 0")
    dest = F.concat(F.lit("/out/"), (F.col("id") % 7).cast("string"), F.lit("/x.MP4"))
    a = a.select(F.col("path").alias("source"), dest.alias("destination"), F.col("id").alias("ord"), F.lit("DJI").alias("make"), F.lit("").alias("model"))
    return C.companions(a, v.clips.select("path", "size")).select("source", "destination", "ord")


@query(f"SELECT id, CASE WHEN media = 'video' THEN '{dims.NOTES["video"]}' ELSE '{dims.NOTES["device"]}' END AS note, 'x; ' || media AS appended FROM files WHERE media <> 'companion'", "files")
def notes_and_labels(v):
    """F35 F36"""
    t = v.files.filter("media <> 'companion'")
    return t.select("id", S.note(F.lit(""), F.col("media"), F.lit(""), F.lit("unknown"), F.lit(True), F.col("mtime_s"), F.col("mtime_s")).alias("note"), F.concat_ws("; ", F.lit("x"), "media").alias("appended"))


@query(f"{_STATUS_CTE} SELECT id, {_map_sql('status', dims.STATUS_LABELS)} AS shown, {_map_sql('t', dims.DEVICE_LABELS)} AS kind, make || CASE WHEN model <> '' THEN ' / ' || model ELSE '' END AS device FROM s", "devices")
def status_labels(v):
    """F37 F38"""
    device = F.concat_ws(" / ", "make", S.filled(F.col("model")))
    return _status(v.devices).select("id", S.lookup(F.col("status"), dims.STATUS_LABELS).alias("shown"), S.lookup(F.col("device_type"), dims.DEVICE_LABELS).alias("kind"), device.alias("device"))


# ------------------------------------------------------------ trees, lists, sets


@query("SELECT prefix, len(string_split(prefix, '/')) - 1 AS depth, count(*) FILTER (WHERE own) AS own_count, count(*) AS total_count FROM (SELECT dir AS prefix, true AS own FROM files UNION ALL SELECT '/src/' || source, false FROM files UNION ALL SELECT '/src', false FROM files) GROUP BY ALL", "files")
def path_rollup(v):
    """G05"""
    return C.path_rollup(v.files).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT split_part(p, '/', 1) AS top, count(*) AS n, sum(length(p))::BIGINT AS chars FROM tree GROUP BY ALL", "tree")
def top_component_counts(v):
    """G18"""
    return v.tree.groupBy(F.substring_index("p", "/", 1).alias("top")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("chars"))


@query("SELECT folder, n, min(line) AS first, max(line) AS last FROM (SELECT regexp_extract(destination, '^(.*)/[^/]*$', 1) AS folder, count(*) OVER (PARTITION BY regexp_extract(destination, '^(.*)/[^/]*$', 1)) AS n, regexp_extract(destination, '[^/]*$') AS line FROM recs WHERE status IN ('ok', 'dry_run') AND destination <> '') GROUP BY ALL", "recs")
def filelist_rows(v):
    """How many rows each list has, and which come first and last."""
    body = reports.filelist_lines(v.recs).filter("part = 1").withColumn("name", F.trim(F.substring_index("line", " | ", 1)))
    return body.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("SELECT id, name, path AS source FROM files WHERE NOT starts_with(name, 'pic')", "files")
def filelist_parse(v):
    """Lines of eight columns; others are skipped."""
    line = F.when(F.col("name").startswith("pic"), F.concat(F.lit("# "), "name")).otherwise(F.concat_ws(" | ", "name", *[F.lit("x")] * 6, "path"))
    return v.files.select("id", filelists.pair(line).alias("p")).filter("p is not null").select("id", "p.name", "p.source")


@query("SELECT hash FROM files WHERE id % 2 = 0 EXCEPT SELECT hash FROM files WHERE id % 3 = 0", "files")
def outlier_except(v):
    """S04"""
    return v.files.filter("id % 2 = 0").select("hash").subtract(v.files.filter("id % 3 = 0").select("hash"))


@query("SELECT dir, bool_and(name LIKE '%.txt' OR name LIKE '%.srt') AS junk FROM files GROUP BY dir", "files")
def junk_folder(v):
    """S05"""
    kinds = v.files.groupBy("dir").agg(F.collect_set(S.extension(F.col("name"))).alias("k"))
    return kinds.select("dir", (F.size(F.array_except("k", F.array(F.lit(".txt"), F.lit(".srt")))) == 0).alias("junk"))


@query("SELECT path, 'item' AS kind FROM files WHERE media <> 'companion' UNION ALL SELECT path, 'companion' FROM files WHERE media = 'companion'", "files")
def union_records(v):
    """S01 S07"""
    items, rest = v.files.filter("media <> 'companion'"), v.files.filter("media = 'companion'")
    return items.select("path", F.lit("item").alias("kind")).unionByName(rest.select("path", F.lit("companion").alias("kind")))


@query("SELECT source, count(*) AS files, count(*) FILTER (WHERE media = 'photo') AS photos, count(*) FILTER (WHERE media = 'video') AS videos, count(DISTINCT dir) AS dirs FROM files GROUP BY source", "files")
def scan_stats(v):
    """G08"""
    m = F.col("media")
    return v.files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(m == "photo").alias("photos"), F.count_if(m == "video").alias("videos"), F.count_distinct("dir").alias("dirs"))


# ------------------------------------------------------------------------- faces


@query("SELECT id, i, round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS x FROM (SELECT id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM faces)", "faces")
def l2_normalize(v):
    """F33"""
    t = v.faces.select("id", F.posexplode(S.normalised(F.col("embedding"))).alias("i", "x"))
    return t.select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM faces) GROUP BY ALL", "faces")
def centroids(v):
    """G20"""
    t = v.faces.select("label", F.posexplode("embedding").alias("i", "x"))
    return t.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("""WITH d AS (SELECT DISTINCT hash FROM files), g AS (SELECT substring(sha256(hash), 1, 4) AS h, sha256(string_agg(hash, chr(10) ORDER BY hash)) AS x FROM d GROUP BY ALL)
  SELECT substring(sha256(string_agg(x, chr(10) ORDER BY h) || '|2'), 1, 32) AS fingerprint FROM g""", "files")
def fingerprint(v):
    """Of a whole set and a setting, from the digests of its parts."""
    return people.fingerprint(v.files, "hash", 2)


@query("SELECT '人物_' || printf('%03d', label + 1) AS person, count(*) AS face_count, count(DISTINCT CAST(floor(id / 2) AS BIGINT)) AS photo_count FROM faces GROUP BY label", "faces")
def face_index_rows(v):
    """L09 K11"""
    found = v.faces.select(F.format_string("人物_%03d", F.col("label") + 1).alias("person"), F.concat(F.lit("/p/"), F.floor(F.col("id") / 2).cast("string")).alias("path"))
    line = F.from_json("line", "person string, face_count bigint, photo_count bigint")
    return reports.people_lines(found).select(line.alias("j")).select("j.*").distinct()


@query("SELECT '人物_' || printf('%03d', label + 1) AS person, '/p/' || CAST(floor(id / 2) AS BIGINT) AS path FROM faces GROUP BY ALL", "faces")
def ordered_distinct(v):
    """A file stands once in a person's index, however many of its faces are."""
    found = v.faces.select(F.format_string("人物_%03d", F.col("label") + 1).alias("person"), F.concat(F.lit("/p/"), F.floor(F.col("id") / 2).cast("string")).alias("path"))
    return reports.people_lines(found).select(F.from_json("line", "person string, path string").alias("j")).select("j.*")


@query(None)
def people_clusters(v):
    """No SQL twin; tests hold it against planted clusters and against one task."""
    return people.cluster_people(v.faces, min_size=4)


@query("SELECT id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM faces", "faces")
def vector_roundtrip(v):
    """F34"""
    back = containers.vectors(containers.vector_texts("embedding"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.faces.select("id", back.alias("v")).select("id", F.size("v").cast("long").alias("n"), F.round(total, 6).alias("total"))


_FILES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the tables itself, through the folder source.  A table is a
    file or a folder of part files, which are not counted one by one, nor what Spark passes over
    in it."""
    below = F.col("path").substr(F.lit(len(media.normal(sf_dir)) + 2), F.length("path"))
    found = media.scan(spark, sf_dir, every_file=True).withColumn("below", below).filter(~F.col("below").rlike("(^|/)[_.]"))
    tables = found.groupBy(F.substring_index("below", "/", 1).alias("name")).agg((F.max("size") > 0).alias("filled"), F.bool_or(F.col("mtime").isNotNull()).alias("dated"))
    return tables.filter(F.col("name").isin([f"{t}.parquet" for t in _FILES])).select("name", S.extension(F.col("name")).alias("ext"), "filled", "dated")


QUERIES["folder_scan"] = folder_scan
ORACLE_SQL["folder_scan"] = f"SELECT unnest([{', '.join(repr(t + '.parquet') for t in _FILES)}]) AS name, '.parquet' AS ext, true AS filled, true AS dated"


# ---------------------------------------------------------------- container bytes


@query("SELECT id, CASE WHEN id % 5 <> 0 THEN strftime(make_timestamp((1600000000 + id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') END AS created, 'Maker' || id % 7 AS make FROM files", "files")
def movie_boxes(v):
    """A movie box with its time, and a user box with its maker, built here byte by byte."""
    stamp = F.hex(F.when(F.col("id") % 5 != 0, F.lit(1600000000 + 2082844800) + F.col("id") * 60).otherwise(F.lit(7)))
    head = F.concat(F.lit("00000010"), F.hex(F.lit("mvhd")), F.lit("00000000"), F.lpad(stamp, 8, "0"))
    text = F.concat(F.lit("Maker"), (F.col("id") % 7).cast("string"))
    maker = F.concat(F.lit("00000012A96D616B00060000"), F.hex(text))
    user = F.concat(F.lit("0000001A"), F.hex(F.lit("udta")), maker)
    data = F.concat(F.lit("0000000C"), F.hex(F.lit("ftyp")), F.hex(F.lit("qt  ")), F.lit("00000032"), F.hex(F.lit("moov")), head, user)
    return v.files.select("id", containers.boxes(F.unhex(data)).alias("b")).select("id", F.col("b")["creation_time"].alias("created"), F.col("b")["make"].alias("make"))


@query("SELECT id, 'M' || id % 10 AS make, CAST(id % 60000 AS VARCHAR) AS iso FROM files", "files")
def exif_tags(v):
    """A TIFF block with a text and a number, built here byte by byte."""
    low, high = F.col("id") % 60000 % 256, F.floor(F.col("id") % 60000 / 256).cast("long")
    number = F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(high), 2, "0"))
    text = F.hex(F.concat(F.lit("M"), (F.col("id") % 10).cast("string")))
    data = F.concat(F.lit("49492A0008000000" + "0200" + "0F01020003000000"), text, F.lit("0000" + "2788030001000000"), number, F.lit("0000" + "00000000"))
    return v.files.select("id", containers.exif(F.unhex(data)).alias("e")).select("id", F.col("e")["make"].alias("make"), F.col("e")["iso"].alias("iso"))


# ------------------------------------------------------------------------- reports


def _width(c: str) -> str:
    return f"(length({c}) + len(regexp_extract_all({c}, '{S.wide_characters()}')))"


@query(f"SELECT id, {_width('t')} AS width, t || repeat(' ', 30 - {_width('t')}) AS shown FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '镜头ＡＢ' ELSE '' END || name AS t FROM files)", "files")
def display_width(v):
    """F21"""
    t = F.concat(F.when(F.col("id") % 3 == 0, "镜头ＡＢ").otherwise(""), "name")
    return v.files.select("id", S.display_width(t).alias("width"), S.padded(t, F.lit(30)).alias("shown"))


@query("""SELECT id, CASE WHEN length(t) > 50 THEN substr(t, 1, 46 - length(e) ) || '...' || e ELSE t END AS shown FROM (
  SELECT id, t, regexp_extract(t, '.(\\.[^./]*)$', 1) AS e FROM (SELECT id, repeat(md5(hash), id % 4 + 1) || name AS t FROM files))""", "files")
def short_names(v):
    """F22"""
    t = F.concat(F.expr("repeat(md5(hash), CAST(id % 4 + 1 AS INT))"), "name")
    return v.files.select("id", S.short_name(t).alias("shown"))


@query("SELECT id FROM files WHERE id % 4 NOT IN (1, 2)", "files")
def other_drives(v):
    """A07"""
    i = F.col("id") % 4
    path = F.concat(F.when(i == 0, "C:").when(i == 1, "d:").when(i == 2, "E:").otherwise(""), "path")
    return v.files.filter(S.on_other_drive(path, ("D:/out", "e:/x", "/plain"))).select("id")


_CELLS = (
    "regexp_extract(destination, '[^/]*$')", "coalesce(date_taken, '')", _size("file_size"), "CASE WHEN make <> '' THEN trim(make || ' ' || model) ELSE '' END",
    "concat_ws(' ', CASE WHEN ord % 2 = 0 THEN 'ISO100' END, CASE WHEN ord % 3 = 0 THEN 'f/2.8' END, '1/200s', CASE WHEN ord % 5 <> 0 THEN '50mm' END)", "lens", "coalesce(gps, '')", "source",
)


def _row(values) -> str:
    return " || ' | ' || ".join(f"{v} || repeat(' ', w{k} - {_width(v)})" if k < 7 else v for k, v in enumerate(values))


@query(f"""WITH r AS (SELECT regexp_extract(destination, '^(.*)/[^/]*$', 1) AS folder, {', '.join(f'{c} AS c{k}' for k, c in enumerate(_CELLS))} FROM recs WHERE status IN ('ok', 'dry_run') AND destination <> ''),
  w AS (SELECT folder, count(*) AS n, {', '.join(f'greatest(max({_width(f"c{k}")}), {len(n)}) AS w{k}' for k, n in enumerate(reports.FILELIST))} FROM r GROUP BY folder),
  h AS (SELECT folder, unnest(['# 文件列表 — 共 ' || n || ' 个文件', '# 目标目录: ' || folder, '# 列: {' | '.join(f'{a}({b})' for a, b in zip(reports.FILELIST_NAMES, reports.FILELIST, strict=True))}', '#',
    {_row([f"'{n}'" for n in reports.FILELIST])}, {" || '-+-' || ".join(f"repeat('-', w{k})" for k in range(8))}]) AS line FROM w)
  SELECT folder, 0 AS part, line FROM h UNION ALL SELECT folder, 1, {_row([f'c{k}' for k in range(8)])} FROM r JOIN w USING (folder)""", "recs")
def filelist_lines(v):
    """K04"""
    return reports.filelist_lines(v.recs).select("folder", "part", "line")


def _csv(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '[\",\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END)"


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY source, destination) AS n FROM recs),
  c AS (SELECT n::VARCHAR AS c0, source AS c1, destination AS c2, {_map_sql('device_type', dims.DEVICE_LABELS)} AS c3, CASE WHEN media_type = 'video' THEN '视频' ELSE '照片' END AS c4, make AS c5, model AS c6, coalesce(date_taken, '') AS c7,
    file_size::VARCHAR AS c8, CASE WHEN has_exif_date THEN '是' ELSE '否' END AS c9, {_map_sql('status', dims.STATUS_LABELS)} AS c10, file_hash AS c11, coalesce(dup_of, '') AS c12, error_msg AS c13 FROM n)
  SELECT 0 AS part, chr(65279) || '{",".join(reports.CSV)}' AS line UNION ALL SELECT 1, {" || ',' || ".join(_csv(f'c{k}') for k in range(14))} FROM c""", "recs")
def csv_report(v):
    """K06 W06"""
    return reports.csv_lines(v.recs).select("part", "line")


@query("""WITH f AS (SELECT regexp_extract(source, '^(.*)/[^/]*$', 1) AS path FROM recs), n AS (SELECT count(*) AS n FROM recs)
  SELECT 0 AS part, 'head' AS section, 3 AS lines UNION ALL SELECT 2, 'foot', 2 UNION ALL SELECT 1, '0', 3 UNION ALL SELECT 1, '1', count(DISTINCT path) + 2 FROM f
  UNION ALL SELECT 1, '2', count(*) + 2 FROM (SELECT DISTINCT make, model, device_type FROM recs) UNION ALL SELECT 1, '3', count(*) + 2 FROM recs WHERE status = 'skipped_dup'
  UNION ALL SELECT 1, '4', n + 2 FROM n UNION ALL SELECT 1, '5', n + 1 FROM n""", "recs")
def html_report(v):
    """The lines of each section."""
    section = F.when(F.col("part") == 0, "head").when(F.col("part") == 2, "foot").otherwise(F.substring("key", 1, 1))
    return reports.html_lines(v.recs, "report").groupBy("part", section.alias("section")).agg(F.count(F.lit(1)).alias("lines"))


@query("""SELECT path, total, camera, phone, unknown, copied, dup, not_target, '<tr><td>' || row_number() OVER (ORDER BY total DESC, path) || '</td><td>' || path || '</td><td>' || total || '</td>' AS line FROM (
  SELECT regexp_extract(source, '^(.*)/[^/]*$', 1) AS path, count(*) AS total, count(*) FILTER (WHERE device_type = 'camera') AS camera, count(*) FILTER (WHERE device_type = 'phone') AS phone, count(*) FILTER (WHERE device_type = 'unknown') AS unknown,
  count(*) FILTER (WHERE status IN ('ok', 'dry_run')) AS copied, count(*) FILTER (WHERE status = 'skipped_dup') AS dup, count(*) FILTER (WHERE status = 'skipped_not_target') AS not_target FROM recs GROUP BY 1)""", "recs")
def report_folders(v):
    """The counts of each folder and how its line on the page begins."""
    lines = reports.html_lines(v.recs, "report").filter("part = 1 and startswith(key, '11')")
    shown = lines.select(F.regexp_extract("line", "^(<tr><td>[0-9]+</td><td>([^<]*)</td><td>[0-9]+</td>)", 1).alias("line"), F.regexp_extract("line", "^<tr><td>[0-9]+</td><td>([^<]*)</td>", 1).alias("path"))
    return reports.folder_summary(v.recs).drop("filtered").join(shown, "path")


@query(f"""WITH {_PAIRS}, t AS (SELECT p.source, dest, s.size AS a, d.size AS b, CASE WHEN d.size IS NULL THEN 'dest_missing' WHEN s.size <> d.size THEN 'size_mismatch'
    WHEN s.hash <> d.hash THEN 'hash_mismatch' ELSE 'verified' END AS o FROM p JOIN files s ON s.path = p.source LEFT JOIN files d ON d.path = dest),
  l AS (SELECT *, regexp_extract(source, '^(.*)/[^/]*$', 1) AS folder FROM t),
  g AS (SELECT folder, count(*) AS n, count(*) FILTER (WHERE o = 'verified') AS ok, coalesce(sum(a) FILTER (WHERE o = 'verified'), 0)::BIGINT AS bytes FROM l GROUP BY folder)
  SELECT folder, 0 AS part, unnest(['# 源文件清理日志 (溯源记录) - 试运行(dry-run)', '# 生成时间: now', '# 源目录: ' || folder, '# 记录数: ' || n, '#', '# 格式: 状态 | 源文件 | 大小 | 目标文件', '{reports.RULE}']) AS line FROM g
  UNION ALL SELECT folder, 1, CASE o WHEN 'verified' THEN '可删除(dry-run)' WHEN 'dest_missing' THEN '目标文件不存在' WHEN 'size_mismatch' THEN '大小不匹配(' || {_size('a')} || ' vs ' || {_size('b')} || ')' ELSE '哈希不匹配' END
    || ' | ' || source || ' | ' || CASE WHEN o = 'dest_missing' THEN '-' ELSE {_size('a')} END || ' | ' || dest FROM l
  UNION ALL SELECT folder, 2, unnest(['{reports.RULE}', '# 小计: 可删除 ' || ok || ' 个文件, 释放 ' || {_size('bytes')}]) FROM g""", "files")
def cleanup_log(v):
    """K08"""
    b = v.files.select((F.col("id") - 1).alias("id"), F.concat("path", F.when(F.col("id") % 9 == 0, "x").otherwise("")).alias("dest"))
    checked = C.verify_pairs(v.files.select("id", F.col("path").alias("source")).join(b, "id").select("source", "dest"), v.files, sizes=True)
    return reports.cleanup_lines(checked, "now").select("folder", "part", "line")


@query(f"""WITH o AS (SELECT hash, min(path) AS found FROM files WHERE id % 4 = 1 GROUP BY hash), m AS (SELECT path, hash, size, found FROM files LEFT JOIN o USING (hash)), g AS (SELECT count(found) AS ok, count(*) - count(found) AS lost FROM m)
  SELECT 0 AS part, unnest(['# 恢复日志 - 试运行(dry-run)', '# 生成时间: now', '# 备份目录: /b', '# 来源目录: /o', '# 格式: 状态 | 恢复到 | 大小 | 复制自', '{reports.RULE}']) AS line
  UNION ALL SELECT 1, CASE WHEN found IS NULL THEN '无来源(hash=' || substr(hash, 1, 12) || ')' ELSE '可恢复(dry-run)' END || ' | ' || path || ' | ' || {_size('size')} || ' | ' || coalesce(found, '-') FROM m
  UNION ALL SELECT 2, unnest(['{reports.RULE}', '# 小计: 可恢复 ' || ok || ', 已存在 7, 无来源 ' || lost || ', 错误 0']) FROM g""", "files")
def restore_log(v):
    """K09"""
    m = C.restore_matches(v.files.select("path", "hash", "size"), v.files.filter("id % 4 = 1"))
    return reports.restore_lines(m, "/b", "/o", "now", 7).select("part", "line")


@query("""SELECT 0 AS part, 0 AS n, unnest(['# NSFW 文件列表 (阈值 >= 0.50)', '# 共 ' || n || ' 个文件', '# 格式: 分数 | 文件路径', '']) AS line FROM (SELECT count(*) AS n FROM scores WHERE coarse >= 0.5)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY coarse DESC, '/p/' || id), printf('%.4f', coarse) || ' | /p/' || id FROM scores WHERE coarse >= 0.5""", "scores")
def score_list(v):
    """K14 T02"""
    lines = reports.score_list_lines(v.scores.select(F.col("coarse").alias("score"), F.concat(F.lit("/p/"), F.col("id").cast("string")).alias("path")), 0.5)
    return lines.select("part", F.when(F.col("part") == 1, F.col("key").cast("long")).otherwise(0).alias("n"), "line")


# ------------------------------------------------------------------------- plans


@query("""WITH i AS (SELECT hash, min('/OLD/' || path) AS reuse FROM files WHERE id % 3 = 0 GROUP BY hash), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS n FROM files)
  SELECT path, CASE WHEN n > 1 OR id % 8 = 1 THEN 'skip' WHEN reuse IS NOT NULL AND NOT contains(reuse, '/src1/') THEN 'rename' ELSE 'copy' END AS action, CASE WHEN n = 1 THEN coalesce(reuse, path) ELSE path END AS src FROM r LEFT JOIN i USING (hash)""", "files")
def copy_plan(v):
    """Actions as rows; nothing is moved."""
    index = v.files.filter("id % 3 = 0").select("hash", F.concat(F.lit("/OLD/"), "path").alias("path"))
    files = C.deduplicate(v.files).withColumn("destination", F.concat(F.lit("/out"), "path")).withColumn("in_place", F.col("id") % 8 == 1)
    return P.copy_plan(files, P.reused(v.files, index), ("/old//src/src1",)).select("path", "action", "src")


@query(f"""SELECT dir || '/' || id AS source, CASE WHEN t <> 'unknown' OR has OR m IS NOT NULL THEN 'out/' || t || '/' || coalesce(year(d) || '-' || {_QUARTER}, '{dims.UNKNOWN_DATE}') ELSE '' END AS destination,
  t AS device_type, media_type, make, model, coalesce(strftime(d, '%Y-%m-%d %H:%M:%S'), '') AS date_taken, has AS has_exif_date, size AS file_size,
  CASE WHEN t = 'unknown' AND make <> '' THEN '' WHEN t = 'unknown' AND media_type = 'video' THEN '{dims.NOTES["video"]}' WHEN t = 'unknown' THEN '{dims.NOTES["device"]}'
    WHEN has THEN '' WHEN m IS NOT NULL THEN '{dims.NOTES["mtime"]}' ELSE '{dims.NOTES["date"]}' END AS note
  FROM (SELECT *, CASE WHEN has THEN e ELSE m END AS d, {_DEVICE_TYPE} AS t FROM (SELECT *, id % 2 = 0 AS has, CASE WHEN id % 2 = 0 THEN make_timestamp((1704067200 + id * 3600) * 1000000) END AS e,
    CASE WHEN id % 5 <> 0 THEN make_timestamp((1609459200 + id * 3600) * 1000000) END AS m FROM devices))""", "devices")
def copy_records(v):
    """R08"""
    t = v.devices.withColumn("has_exif_date", F.col("id") % 2 == 0).withColumn("source", F.concat_ws("/", "dir", "id"))
    t = t.withColumn("date_taken", F.when(F.col("has_exif_date"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)))
    t = t.withColumn("mtime", F.when(F.col("id") % 5 != 0, F.timestamp_seconds(F.lit(1609459200) + F.col("id") * 3600)))
    t = t.withColumn("device_type", S.device_type(F.col("make"), F.col("model"))).withColumn("effective_date", F.coalesce("date_taken", "mtime"))
    dest = F.concat_ws("/", F.lit("out"), "device_type", S.date_folder(F.col("effective_date")))
    return C.records(t.withColumn("destination", dest))


@query("SELECT CASE WHEN contains(path, '/src2/') THEN 'keep_protected' ELSE 'delete_dup' END AS action, path FROM (SELECT path, row_number() OVER (PARTITION BY hash ORDER BY NOT contains(path, 'src1'), path) AS n FROM files) WHERE n > 1", "files")
def dup_delete_plan(v):
    """K02 P13"""
    return P.duplicate_plan(v.files, "src1", ("/SRC/src2/",)).select("action", "path")


@query("""WITH f AS (SELECT dir || '/' || id % 11 AS dir, CASE WHEN id % 3 = 1 THEN 'Thumbs.db' ELSE name END AS name, id FROM files)
  SELECT dir FROM f WHERE id % 2 = 0 EXCEPT SELECT dir FROM f WHERE id % 2 = 1 AND lower(name) NOT IN ('filelist.txt', 'thumbs.db', 'desktop.ini', '.ds_store')""", "files")
def empty_dir_plan(v):
    """Half of the files go; folders where only junk stays go too."""
    f = v.files.select(F.concat_ws("/", "dir", (F.col("id") % 11).cast("string")).alias("dir"), F.when(F.col("id") % 3 == 1, "Thumbs.db").otherwise(F.col("name")).alias("name"), "id")
    return P.empty_folders(f.filter("id % 2 = 0"), f.filter("id % 2 = 1"))


@query(r"""WITH f AS (SELECT id, '/r/' || id % 40 || CASE WHEN id % 3 = 0 THEN '' ELSE '_po' || (id % 7 + 1) || '_' || id || '_po1' END || '.jpg' AS path, id % 2 AS size, 'h' || id % 4 AS hash FROM files),
  o AS (SELECT path, size, hash, regexp_replace(path, '_po[0-9]+(\.[^.]+)$', '\1') AS "natural" FROM f WHERE regexp_matches(path, '_po[0-9]+\.[^.]+$')),
  n AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.path = o."natural") AS there, row_number() OVER (PARTITION BY "natural" ORDER BY path) AS k FROM o)
  SELECT path, "natural", CASE WHEN NOT there AND k = 1 THEN 'rename' WHEN EXISTS (SELECT 1 FROM f WHERE f.path = n."natural" AND f.size = n.size AND f.hash = n.hash) THEN 'delete' ELSE 'skip' END AS action FROM n""", "files")
def po_repair_plan(v):
    """K12 F42"""
    i = F.col("id")
    suffix = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("_po"), (i % 7 + 1).cast("string"), F.lit("_"), i.cast("string"), F.lit("_po1")))
    f = v.files.select(F.concat(F.lit("/r/"), (i % 40).cast("string"), suffix, F.lit(".jpg")).alias("path"), (i % 2).alias("size"), F.concat(F.lit("h"), (i % 4).cast("string")).alias("hash"))
    return P.repair_plan(f.distinct())


@query("SELECT path, '/links/' || substr(path, 6) AS link, CASE WHEN id % 7 = 0 THEN 'skip' ELSE 'link' END AS action FROM files WHERE media = 'photo'", "files")
def link_plan(v):
    """What is there already, in whatever case, is skipped."""
    there = v.files.filter("id % 7 = 0").select(F.concat(F.lit("/LINKS/"), F.expr("substring(path, 6)")).alias("path"))
    return P.link_plan(v.files.filter("media = 'photo'"), "/src", "/links", there)


@query("WITH f AS (SELECT dir || '/' || id % 11 AS dir, CASE WHEN id % 5 = 0 THEN 'filelist.txt' ELSE name END AS name FROM files) SELECT DISTINCT dir FROM f WHERE name <> 'filelist.txt' AND dir NOT IN (SELECT dir FROM f WHERE name = 'filelist.txt')", "files")
def filelist_backfill(v):
    """K05"""
    f = v.files.select(F.concat_ws("/", "dir", (F.col("id") % 11).cast("string")).alias("dir"), F.when(F.col("id") % 5 == 0, "filelist.txt").otherwise(F.col("name")).alias("name"))
    return P.unlisted(f)


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'Canon' WHEN id % 2 = 0 THEN 'fm' WHEN id % 4 = 1 THEN '' WHEN id % 3 = 0 THEN 'st' ELSE '' END AS make, CASE WHEN id % 3 = 1 THEN 'm2' ELSE 'm1' END AS model, CASE WHEN id % 7 = 0 THEN 'enc' ELSE '' END AS app,
  CASE WHEN id % 6 <> 0 THEN id % 1000 END AS width FROM devices""", "devices")
def ffprobe_merge(v):
    """A key of the file hides the stream's, even if empty; brands tell a maker."""
    i = F.col("id")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = F.when(i % 5 == 0, F.create_map(F.lit("Compatible_Brands"), F.lit("qt  CAEP"))).when(i % 2 == 0, F.create_map(F.lit("MAKE"), F.lit("fm"))).when(i % 4 == 1, F.create_map(F.lit("make"), F.lit(""))).otherwise(none)
    stream = F.map_concat(F.when((i % 3 == 0) & (i % 5 != 0), F.create_map(F.lit("make"), F.lit("st"))).otherwise(none), F.when(i % 7 == 0, F.create_map(F.lit("Encoder"), F.lit("enc"))).otherwise(none))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.map_concat(F.create_map(F.lit("model"), F.lit("m1")), F.when(i % 3 == 1, F.create_map(F.lit("com.android.model"), F.lit("m2"))).otherwise(none)).alias("tags"))
    video = F.struct(F.lit("video").alias("codec_type"), F.when(i % 6 != 0, (i % 1000).cast("int")).alias("width"), stream.alias("tags"))
    text = F.to_json(F.struct(F.struct(own.alias("tags")).alias("format"), F.array(audio, video).alias("streams")))
    return v.devices.select("id", records.probe(text).alias("p")).select("id", "p.make", "p.model", F.col("p.writing_application").alias("app"), "p.width")
