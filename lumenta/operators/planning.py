"""Eligibility, routing and plans: what would be done to which file, as tables.

Columns follow the record of a file: path (or source), destination, hash, size, ord (its unique
place in processing order), device_type, make, label, date and the flags that each function
names.  Nothing is moved or deleted here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S
from . import catalog as C

# ------------------------------------------------------------------ eligibility


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def explicit_eligible(name: Column, needs_copy: Column) -> Column:
    """Pictures and videos to be copied, but no RAW files."""
    return needs_copy & S.media_type(name).isNotNull() & ~S.raw_image(name)


def document_eligible(name: Column, needs_copy: Column, drone: Column, device: Column) -> Column:
    """P10: photos to be copied that are no screenshot, drone, camera or RAW file."""
    return needs_copy & (S.media_type(name) == "photo") & ~S.raw_image(name) & ~S.screenshot(name) & ~drone & (device != "camera")


def protected(path: Column, prefixes) -> Column:
    """Below one of the folders that nothing may be removed from; case is ignored."""
    return reduce(lambda a, b: a | b, [F.startswith(F.lower(path), F.lit(p.lower().rstrip("/") + "/")) for p in prefixes], F.lit(False))


# ---------------------------------------------------------------------- routing


def destination_root(device: Column, target: Column, copy_all: bool = False) -> Column:
    """Files of other devices have roots of their own in the mode that copies all."""
    r = dims.ROOTS
    if not copy_all:
        return F.when(device == "phone", r["phone"]).when(device == "camera", r["camera"]).otherwise(r["unknown"])
    own = F.when(device == "phone", r["target_phone"]).when(device == "camera", r["target_camera"])
    other = F.when(device == "phone", r["other_phone"]).when(device == "camera", r["other_camera"]).otherwise(r["other_unknown"])
    return F.when(target, F.coalesce(own, F.lit(r["unknown"]))).otherwise(other)


def dated_path(root: Column, label: Column, date: Column, has_exif: Column, name: Column, known: Column) -> Column:
    """root/label/date/name, without the label where the device is not known; a
    folder by file time says so there."""
    folder = S.date_folder(date)
    marked = F.when(date.isNotNull() & ~has_exif, F.concat(folder, F.lit(dims.BY_FILE_TIME))).otherwise(folder)
    return F.when(known, F.concat_ws("/", root, label, folder, name)).otherwise(F.concat_ws("/", root, marked, name))


def below(path: Column, output: str, root: str) -> Column:
    """The path's place in the output tree, under another root."""
    inside = F.startswith(F.lower(path), F.lit(output.lower() + "/"))
    relative = F.when(inside, F.substring(path, F.lit(len(output) + 2), F.length(path))).otherwise(base_name(path))
    return F.concat(F.lit(f"{output}/{root}/"), relative)


def routed(files: DataFrame, output: str, threshold: float = 0.5, document_threshold: float = 0.5, move_explicit: bool = True, copy_all: bool = False) -> DataFrame:
    """Files with destination, in_place and the explicit score's text.

    files has path, device_type, target, label, date, has_exif, drone, explicit_score and
    document_score (null: not scored).  Later rules win: frozen files stay; screenshots;
    documents, but no camera's; drones; explicit files, below their root by the place they had so far; a file
    that stands in a device folder is not sent to the unknown ones.  A destination that is the
    path itself, whatever its case, is in place.
    """
    path, device, name = F.col("path"), F.col("device_type"), base_name(F.col("path"))
    known, r = device.isin("camera", "phone"), {k: f"{output}/{v}" for k, v in dims.ROOTS.items()}
    date, exif, label = F.col("date"), F.col("has_exif"), F.col("label")
    frozen, drone, shot = S.frozen(path, output), F.coalesce(F.col("drone"), F.lit(False)), S.screenshot(name)
    plain = dated_path(F.concat(F.lit(output + "/"), destination_root(device, F.col("target"), copy_all)), label, date, exif, name, known)
    folder = S.date_folder(date)
    shots = F.lit(f"{r['document']}/{dims.ROOTS['screenshot']}")
    step = files.withColumn("_to", F.when(frozen, path).when(shot, F.when(known, F.concat_ws("/", shots, label, folder, name)).otherwise(F.concat_ws("/", shots, folder, name))).otherwise(plain))
    document = ~frozen & ~shot & ~drone & (device != "camera") & (F.col("document_score") >= document_threshold)
    step = step.withColumn("_to", F.when(F.coalesce(document, F.lit(False)), below(F.col("_to"), output, dims.ROOTS["document"])).otherwise(F.col("_to")))
    step = step.withColumn("_to", F.when(~frozen & drone, F.concat_ws("/", F.lit(r["drone"]), label, folder, name)).otherwise(F.col("_to")))
    explicit = F.coalesce(F.col("explicit_score") >= threshold, F.lit(False))
    if move_explicit:
        step = step.withColumn("_to", F.when(~frozen & explicit, below(F.col("_to"), output, dims.ROOTS["explicit"])).otherwise(F.col("_to")))
    lowered = S.classified(path, output) & F.startswith(F.lower("_to"), F.lit(r["unknown"].lower() + "/"))
    step = step.withColumn("destination", F.when(lowered, path).otherwise(F.col("_to")))
    tag = F.when(explicit, F.format_string("%.3f", "explicit_score"))
    return step.withColumn("in_place", F.lower("destination") == F.lower("path")).withColumn("explicit_tag", tag).drop("_to")


# ------------------------------------------------------------------------ joins


def not_existing(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose hash the index lacks."""
    return files.join(index.select("hash"), "hash", "left_anti")


def reused(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, reuse): the first file (smallest ord) of a hash takes the index's path, once."""
    first = files.groupBy("hash").agg(F.min_by("path", "ord").alias("path"))
    return first.join(C.best_representative(index).select("hash", F.col("path").alias("reuse")), "hash").select("path", "reuse")


def cleanup_matches(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files with target, a path of the index with their hash, and kind."""
    t = index.groupBy("hash").agg(F.min("path").alias("target"))
    return files.join(t, "hash", "left").withColumn("kind", F.when(F.col("target").isNull(), "unique").otherwise("matched"))


def missing(cached: DataFrame, there: DataFrame) -> DataFrame:
    """Cached files that are not there any more."""
    return cached.join(there.select("path"), "path", "left_anti")


def score_paths(scores: DataFrame, files: DataFrame) -> DataFrame:
    """(path, score) of every path of a scored hash; a hash without one says so."""
    lost = F.concat(F.lit("[hash="), F.col("hash").cast("string"), F.lit(", path not found]"))
    return scores.join(files.select("hash", "path"), "hash", "left").select(F.coalesce("path", lost).alias("path"), "score")


def similar_names(wanted: DataFrame, known: DataFrame, order: str = "id") -> DataFrame:
    """Wanted with found: the known file of its path, else the last one of its name, whose
    case does not count."""
    by_path = known.select("path", F.col("path").alias("_same")).distinct()
    by_name = known.groupBy(F.lower(base_name(F.col("path"))).alias("_n")).agg(F.max_by("path", order).alias("_like"))
    out = wanted.join(by_path, "path", "left").withColumn("_n", F.lower(base_name(F.col("path")))).join(by_name, "_n", "left")
    return out.withColumn("found", F.coalesce("_same", "_like")).drop("_same", "_like", "_n")


# ------------------------------------------------------------------------ plans


def copy_plan(files: DataFrame, reuse: DataFrame, protected_roots=()) -> DataFrame:
    """(action, src, path, destination) of the accepted files: one that the index has
    elsewhere is renamed from there, or copied where that place is protected; files in place are
    skipped, and so are duplicates.  files has path, destination, status and in_place."""
    known = files.join(reuse.select("path", "reuse"), "path", "left")
    action = F.when((F.col("status") != "ok") | F.col("in_place"), "skip").when(F.col("reuse").isNotNull() & ~protected(F.col("reuse"), protected_roots), "rename").otherwise("copy")
    return known.select(action.alias("action"), F.coalesce("reuse", "path").alias("src"), "path", "destination")


def duplicate_plan(files: DataFrame, album: str, protected_roots=()) -> DataFrame:
    """(action, path) of every file but the representative of its hash; protected ones
    are kept and reported."""
    best = C.best_representative(files, album=album).select("hash", F.col("path").alias("kept"))
    rest = files.join(best, "hash").filter(F.col("path") != F.col("kept"))
    return rest.select(F.when(protected(F.col("path"), protected_roots), "keep_protected").otherwise("delete_dup").alias("action"), "path", "kept")


def empty_folders(gone: DataFrame, left: DataFrame, junk=dims.JUNK_FILES) -> DataFrame:
    """Folders (dir) of files that go, in which nothing or only junk stays; left has
    dir and name of what stays."""
    real = left.filter(~F.lower("name").isin(*junk)).select("dir")
    return gone.select("dir").distinct().join(real, "dir", "left_anti")


def unlisted(files: DataFrame, name: str = "filelist.txt") -> DataFrame:
    """Folders (dir) with files but without a list."""
    return files.filter(F.col("name") != name).select("dir").distinct().join(files.filter(F.col("name") == name).select("dir"), "dir", "left_anti")


def repair_plan(files: DataFrame) -> DataFrame:
    """(path, natural, action) of files whose name has a conflict's suffix: the first one by
    path is renamed where the natural name is free; one that equals the file of that name, or
    the one renamed to it, is deleted; the others are skipped."""
    own = files.filter(base_name(F.col("path")).rlike(r"(?i)_po[0-9]+\.[^.]+$")).select("path", "size", "hash", S.natural_name(F.col("path")).alias("natural"))
    there = files.select(F.lower("path").alias("_p"), F.struct("size", "hash").alias("_there"))
    first = own.groupBy(F.lower("natural").alias("_k")).agg(F.min(F.struct("path", "size", "hash")).alias("_first"))
    out = own.join(first, F.lower("natural") == F.col("_k")).join(there, F.col("_k") == F.col("_p"), "left")
    free = F.col("_there").isNull()
    size, content = (F.when(free, F.col(f"_first.{c}")).otherwise(F.col(f"_there.{c}")) for c in ("size", "hash"))
    action = F.when(free & (F.col("path") == F.col("_first.path")), "rename").when((F.col("size") == size) & (F.col("hash") == content), "delete").otherwise("skip")
    return out.select("path", "natural", action.alias("action"))


def link_plan(files: DataFrame, source: str, root: str, there: DataFrame) -> DataFrame:
    """(path, link, action): files of a tree linked at the same place below another root;
    what is there already is skipped."""
    out = files.withColumn("link", F.concat(F.lit(root + "/"), F.substring("path", F.lit(len(source) + 2), F.length("path"))))
    taken = there.select(F.lower("path").alias("_t")).distinct()
    out = out.join(taken, F.lower("link") == F.col("_t"), "left")
    return out.select("path", "link", F.when(F.col("_t").isNull(), "link").otherwise("skip").alias("action"))


# ----------------------------------------------------------------------- scores


def class_parts(detections: Column, floor: float) -> Column:
    """The detections (class, score) at or over a floor."""
    return F.filter(detections, lambda x: x["score"] >= floor)


def detail(classes, values: Column) -> Column:
    """A model's probabilities by class."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), values)
