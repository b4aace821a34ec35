"""Relational operators of the catalog: DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S


def label_devices(df: DataFrame, make: str, model: str, app: str | None = None) -> DataFrame:
    """F12 steps 1-5, F13, J15: df with the folder label of its device.  Each step is a
    column of its own, so that no expression is repeated in the generated code."""
    make_col, low, key = F.col("_mk"), F.col("_lo"), F.col("_key")
    df = df.withColumn("_mk", F.trim(F.coalesce(make, F.lit("")))).withColumn("_md", F.trim(F.coalesce(model, F.lit(""))))
    df = df.withColumn("_app", F.lower(F.coalesce(app, F.lit(""))) if app else F.lit(""))
    df = df.withColumn("_mk", F.coalesce(S.lookup(F.lower("_mk"), dims.MAKE_NAMES), make_col)).withColumn("_lo", F.lower("_mk"))
    doubled = (low != "") & F.startswith(F.lower("_md"), low)
    df = df.withColumn("_md", F.when(doubled, F.trim(F.substring(F.col("_md"), F.length(make_col) + 1, F.length("_md")))).otherwise(F.col("_md")))
    df = df.withColumn("_md", F.coalesce(S.lookup(F.lower("_md"), dims.MODEL_ALIASES), F.col("_md"))).withColumn("_key", F.lower("_md"))
    by_app = [F.when(F.contains(F.col("_app"), F.lit(k)), F.lit(v)) for k, v in dims.DRONE_APPS.items()]
    own = S.any_of(low, ("xiaomi", "redmi", "poco"))
    df = df.withColumn("_drone", F.when(F.contains(low, F.lit("dji")), F.coalesce(S.lookup(key, dims.DRONE_MODELS), *by_app)))
    df = df.withColumn(
        "_name",
        F.when(F.contains(low, F.lit("dji")), F.lit(None).cast("string"))
        .when(own, S.lookup(key, dims.XIAOMI_NAMES))
        .when(F.contains(low, F.lit("huawei")), S.lookup(key, dims.HUAWEI_NAMES))
        .when(F.contains(low, F.lit("samsung")), S.lookup(key, dims.SAMSUNG_NAMES)),
    )
    df = df.withColumn("_code", F.when(own & F.col("_name").isNull(), S.lookup(F.trim(F.concat_ws(" ", low, key)), S.first_codes())))
    parts = (
        F.when(F.col("_code").isNotNull(), F.concat_ws(" ", "_mk", "_md", "_code"))
        .when(F.startswith(F.lower("_name"), low), F.concat_ws(" ", "_name", "_md"))
        .when(F.col("_name").isNotNull(), F.concat_ws(" ", "_mk", "_name", "_md"))
        .otherwise(F.concat_ws(" ", S.filled(make_col), S.filled(F.col("_md"))))
    )
    df = df.withColumn("_parts", parts).withColumn("label", F.coalesce("_drone", S.folder_name(F.col("_parts"))))
    return df.drop("_mk", "_md", "_app", "_lo", "_key", "_drone", "_name", "_code", "_parts")


def with_first(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """df with first, a struct of the order and values of the row that comes first in its group.
    Groups are reduced before the shuffle; in the join back a hot one can be split."""
    head = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(F.struct(order, *values)).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(head, reduce(lambda a, b: a & b, same)).drop(*[f"_by_{c}" for c in by])


def numbered(df: DataFrame, order: list[Column], name: str = "n", rows_a_task: int | None = None) -> DataFrame:
    """Df with each row's number, from 1, in one order over all rows, which order must make
    unique.  Many rows are dealt to ranges between sampled bounds; a row's number is its
    place in its range after all rows of the ranges before.  Only bounds and the counts of the
    ranges come to the driver, 20 bounds for each of 2000 ranges at most."""
    total = df.count()
    rows_a_task = rows_a_task or max(20_000, total // 2_000)
    parts = -(-total // rows_a_task)
    if parts <= 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    keyed = df.withColumn("_key", F.struct(*order))
    sample = [r["_key"] for r in keyed.sample(min(1.0, 20 / rows_a_task), seed=1).select("_key").orderBy("_key").collect()]
    bounds = sample[len(sample) // parts :: max(1, len(sample) // parts)]
    fields = keyed.schema["_key"].dataType.fields

    def place(lo: int, hi: int) -> Column:
        """How many of the bounds lo to hi lie at or below the key, plus lo: a search tree."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("_key") < F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(bounds[mid], fields, strict=True)]), place(lo, mid)).otherwise(place(mid + 1, hi))

    keyed = keyed.withColumn("_range", place(0, len(bounds)))
    counts = dict(keyed.groupBy("_range").count().collect())
    before = [sum(counts.get(j, 0) for j in range(k)) for k in range(len(bounds) + 1)]
    at = F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range"))
    return keyed.withColumn(name, at + F.row_number().over(Window.partitionBy("_range").orderBy("_key"))).drop("_key", "_range")


def majority(photos: DataFrame, key: list[str], value: list[str], order: str) -> DataFrame:
    """The most frequent value of each key; of equal ones the first seen."""
    votes = photos.groupBy(*key, *value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = votes.groupBy(*key).agg(F.min(F.struct(-F.col("votes"), "_first", *value)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{v}").alias(v) for v in value], (-F.col("_b.col1")).alias("votes"))


def infer_video_device(files: DataFrame) -> DataFrame:
    """Videos without a maker take their folder's; those without a model take it if the
    maker agrees."""
    votes = majority(files.filter("media_type = 'photo' and make <> ''"), ["dir"], ["make", "model"], "id")
    votes = votes.select("dir", F.col("make").alias("_make"), F.col("model").alias("_model"))
    video = F.col("media_type") == "video"
    whole = video & (F.col("make") == "") & F.col("_make").isNotNull()
    model = video & (F.col("make") != "") & (F.col("model") == "") & (F.lower("make") == F.lower("_make"))
    out = files.join(votes, "dir", "left")
    return out.withColumns({
        "model": F.when(whole | model, F.col("_model")).otherwise(F.col("model")),
        "make": F.when(whole, F.col("_make")).otherwise(F.col("make")),
        "inferred": F.coalesce(whole | model, F.lit(False)),
    }).drop("_make", "_model")


def spread_flag(files: DataFrame, flag: Column, key: str = "dir") -> DataFrame:
    """in_folder says if any file of the folder has the flag."""
    found = files.groupBy(F.col(key).alias("_by")).agg(F.bool_or(flag).alias("in_folder"))
    return files.join(found, F.col(key).eqNullSafe(F.col("_by"))).drop("_by")


def deduplicate(files: DataFrame, index: DataFrame | None = None, in_place: Column | None = None, special: Column | None = None) -> DataFrame:
    """The first file (smallest ord, which is unique) of a hash is accepted unless
    the index (hash, existing) has it; the others get dup_of.  Files in place are accepted as
    they are.  Files for which special holds are a world of their own: they are compared among
    themselves, and an index entry stops them only if its column special says so."""
    in_place = F.lit(False) if in_place is None else in_place
    own = F.lit(False) if special is None else F.coalesce(special, F.lit(False))
    out = with_first(files.withColumn("_special", own), ["hash", "_special"], "ord", "path")
    if index is not None:
        known = index if "special" in index.columns else index.withColumn("special", F.lit(False))
        known = known.groupBy(F.col("hash").alias("_hash"), F.col("special").alias("_known")).agg(F.min("existing").alias("existing"))
        out = out.join(known, (F.col("hash") == F.col("_hash")) & (F.col("_special") == F.col("_known")), "left")
    else:
        out = out.withColumn("existing", F.lit(None).cast("string"))
    original = F.coalesce(F.when(F.col("existing") != F.col("path"), F.col("existing")), F.when(F.col("ord") != F.col("first.ord"), F.col("first.path")))
    dup = F.when(~in_place, original)
    out = out.withColumn("dup_of", dup).withColumn("status", F.when(dup.isNull(), "ok").otherwise("skipped_dup"))
    return out.select(*[F.col(f"`{c}`") for c in files.columns], "dup_of", "status")


def upsert(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of new first.  A key stands once in each."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti").select(*new.columns))


def resolve_names(plan: DataFrame, taken: DataFrame | None = None, mark: str = "_po") -> DataFrame:
    """W03, W04 (mark "_f"): the first file that wants a (case-folded) name gets it unless it is
    taken; the others get <mark><n> with the smallest free n, in order, past every name that is wanted by
    others or taken.  Two groups never generate one name, so each group is numbered alone."""
    parts = r"^(.*/)?([^/]*?)(\.[^./]*)?$"
    stem = F.concat(F.regexp_extract("dest", parts, 1), F.regexp_extract("dest", parts, 2))
    ext = F.regexp_extract("dest", parts, 3)
    key = F.lower("dest")
    out = plan.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1)
    used = plan.select("dest")
    if taken is not None:
        known = taken.select(key.alias("_d")).distinct().withColumn("_t", F.lit(1))
        out = out.join(known, key == F.col("_d"), "left").withColumn("n", F.col("n") + F.coalesce("_t", F.lit(0))).drop("_d", "_t")
        used = used.union(taken.select("dest"))
    # a used name that is <stem>_po<k><ext> blocks k in the group of <stem><ext>
    number = rf"(?s)^(.*){mark}([1-9][0-9]{{0,17}})$"
    blocked = used.select(key.alias("dest")).distinct().filter(stem.rlike(number))
    blocked = blocked.select(F.concat(F.regexp_extract(stem, number, 1), ext).alias("_k"), F.regexp_extract(stem, number, 2).cast("long").alias("_b"))
    # below the j-th blocked number b there are b - j free ones: it moves every n above that
    free = F.col("_b") - F.row_number().over(Window.partitionBy("_k").orderBy("_b"))
    blocked = blocked.select("_k", free.alias("_at"), F.lit(1).alias("_block"))
    both = out.withColumns({"_k": key, "_at": F.col("n").cast("long"), "_block": F.lit(0)}).unionByName(blocked, allowMissingColumns=True)
    before = Window.partitionBy("_k").orderBy("_at", "_block").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("n") == 0, F.col("dest")).otherwise(F.concat(stem, F.lit(mark), F.col("n").cast("string"), ext))
    out = both.withColumn("n", F.col("n") + F.sum("_block").over(before)).filter("_block = 0")
    return out.select(*[F.col(f"`{c}`") for c in plan.columns], "n").withColumn("final", named)


def best_representative(files: DataFrame, hash_col: str = "hash", album: str = "All_相册") -> DataFrame:
    """Of each hash one path, in an album folder if there is one."""
    order = F.struct(~F.contains(F.col("path"), F.lit(album)), F.col("path"))
    return files.groupBy(hash_col).agg(F.min_by("path", order).alias("path"), F.count(F.lit(1)).alias("copies"))


def verify_pairs(pairs: DataFrame, files: DataFrame, sizes: bool = False) -> DataFrame:
    """(source, dest) pairs against the files that are there, with s_size and d_size if
    sizes are wanted."""
    s = files.select(F.col("path").alias("source"), F.col("size").alias("s_size"), F.col("hash").alias("s_hash"))
    d = files.select(F.col("path").alias("dest"), F.col("size").alias("d_size"), F.col("hash").alias("d_hash"))
    outcome = (
        F.when(F.col("s_size").isNull(), "src_missing")
        .when(F.col("d_size").isNull(), "dest_missing")
        .when(F.col("s_size") != F.col("d_size"), "size_mismatch")
        .when(F.col("s_hash") != F.col("d_hash"), "hash_mismatch")
        .otherwise("verified")
    )
    return pairs.join(s, "source", "left").join(d, "dest", "left").withColumn("outcome", outcome).select(*pairs.columns, "outcome", *(("s_size", "d_size") if sizes else ()))


def restore_matches(missing: DataFrame, organised: DataFrame) -> DataFrame:
    """Only files of a wanted size are looked at; of each hash the first path."""
    sizes = missing.select("size").distinct()
    best = organised.join(sizes, "size", "left_semi").groupBy("hash").agg(F.min("path").alias("found"))
    return missing.join(best, "hash", "left")


def path_rollup(files: DataFrame, path_col: str = "dir") -> DataFrame:
    """Files directly in, and anywhere under, each folder."""
    parts = F.split(F.col(path_col), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), (k - 1).alias("depth"), (k == F.size(parts)).alias("own")))
    return files.select(F.explode(prefixes).alias("p")).groupBy("p.prefix", "p.depth").agg(F.count_if("p.own").alias("own_count"), F.count(F.lit(1)).alias("total_count"))


def companions(accepted: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are no media and share folder and stem with an accepted file follow
    it to its destination's folder, each once, with the first (smallest ord) of them; one that
    stands there already stays.  accepted has source, destination, ord, make and model; files
    has path and size.  Gives source, destination, ord, make, model and size; clashes of names are for resolve_names."""
    parts = r"(?s)^(.*/)?([^/]+?)(\.[^./]*)?$"

    def pieces(path: str) -> tuple[Column, Column]:
        return F.regexp_extract(path, parts, 1), F.regexp_extract(path, parts, 2)

    folder, stem = pieces("source")
    a = accepted.select(folder.alias("_dir"), stem.alias("_stem"), "ord", F.regexp_extract("destination", r"(?s)^(.*/)?", 1).alias("_to"), "make", "model")
    folder, stem = pieces("path")
    other = files.filter(S.media_type(F.element_at(F.split("path", "/"), -1)).isNull())
    other = other.select(F.col("path").alias("source"), folder.alias("_dir"), stem.alias("_stem"), "size")
    met = other.join(a, ["_dir", "_stem"]).groupBy(F.lower("source")).agg(F.min(F.struct("ord", "source", "_to", "make", "model", "size")).alias("c")).select("c.*")
    out = met.withColumn("destination", F.concat("_to", F.element_at(F.split("source", "/"), -1)))
    out = out.withColumns({"make": F.coalesce(S.filled(F.col("make")), F.lit("DJI")), "model": F.coalesce("model", F.lit(""))})
    return out.filter(F.lower("destination") != F.lower("source")).select("source", "destination", "ord", "make", "model", "size")


def random_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows at random.  The order is a hash of the key, so that a rerun gives the same
    rows; each task keeps its own first n, and only those are merged."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def throughput(done: DataFrame, *by: str) -> DataFrame:
    """Files and megabytes a second between the first and the last time (at) of each
    group; 0 where no time passed."""
    seconds = F.max("at").cast("double") - F.min("at").cast("double")
    t = done.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("double").alias("b"), seconds.alias("s"))

    def rate(of: Column) -> Column:
        return F.when(F.col("s") > 0, of / F.col("s")).otherwise(0.0)

    return t.select(*by, "files", rate(F.col("b") / 1048576).alias("mb_per_s"), rate(F.col("files")).alias("files_per_s"))


def records(files: DataFrame) -> DataFrame:
    """What a report keeps of a file.  A file without a device type, an EXIF date or a
    modification time has nowhere to go: its destination is empty.  Needs source, destination,
    device_type, media_type, make, model, date_taken, mtime, effective_date, has_exif_date and
    size; an optional device_source comes first among the notes."""
    source = F.col("device_source") if "device_source" in files.columns else F.lit("")
    lost = (F.col("device_type") == "unknown") & ~F.col("has_exif_date") & F.col("mtime").isNull()
    return files.select(
        "source",
        F.when(lost, "").otherwise(F.col("destination")).alias("destination"),
        *("device_type", "media_type", "make", "model"),
        F.coalesce(F.date_format("effective_date", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("date_taken"),
        "has_exif_date",
        F.col("size").alias("file_size"),
        S.note(source, F.col("media_type"), F.col("make"), F.col("device_type"), F.col("has_exif_date"), F.col("date_taken"), F.col("mtime")).alias("note"),
    )
