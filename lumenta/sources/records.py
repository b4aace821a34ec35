"""Text records of other programs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = "format struct<tags: map<string, string>>, streams array<struct<codec_type: string, width: int, height: int, tags: map<string, string>>>"
#: The tags that name a maker, a model, a time and a program, the first that is
#: not empty counts; and brands that tell a maker.
PROBE_TAGS = {
    "make": ("com.apple.quicktime.make", "com.android.manufacturer", "manufacturer", "make"),
    "model": ("com.apple.quicktime.model", "com.android.model", "model"),
    "creation_time": ("com.apple.quicktime.creationdate", "creation_time", "date"),
    "writing_application": ("encoder", "writing_application"),
}
PROBE_BRANDS = {"caep": "Canon", "niko": "Nikon"}


def probe(text: Column) -> Column:
    """A struct of PROBE_TAGS, width and height from a probe's JSON.  Keys have any
    case.  A key of the file hides that of the streams, even if empty; of the streams the
    first one counts.  Sizes are those of the first video stream."""
    j = F.from_json(text, PROBE)
    none = F.array().cast("array<struct<k:string,v:string>>")

    def low(tags: Column) -> Column:
        return F.coalesce(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))), none)

    own = F.reverse(low(j["format"]["tags"]))  # of keys that differ in case the later one counts
    rest = F.coalesce(F.flatten(F.transform(j["streams"], lambda s: low(s["tags"]))), none)
    everything = F.concat(own, rest)

    def value(name: str) -> Column:
        return F.get(F.filter(everything, lambda p: p["k"] == name), F.lit(0))["v"]

    found = {k: F.coalesce(*[F.nullif(value(n), F.lit("")) for n in names], F.lit("")) for k, names in PROBE_TAGS.items()}
    brands = F.lower(F.coalesce(value("compatible_brands"), F.lit("")))
    told = F.coalesce(*[F.when(F.contains(brands, F.lit(b)), maker) for b, maker in PROBE_BRANDS.items()], F.lit(""))
    found["make"] = F.when(found["make"] != "", found["make"]).otherwise(told)
    video = F.get(F.filter(j["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.struct(*[c.alias(k) for k, c in found.items()], video["width"].alias("width"), video["height"].alias("height"))


def cache_entries(text: Column, kind: str = "string") -> Column:
    """A JSON object as a map, one entry a file."""
    return F.from_json(text, f"map<string, {kind}>")


def score_line(line: Column) -> Column:
    """(score, path) of "score | path"; null for comments and blank lines."""
    parts = F.split(F.trim(line), r" \| ", 2)
    own = ~F.trim(line).rlike("^(?:$|#)") & (F.size(parts) == 2)
    return F.when(own, F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("score"), F.get(parts, F.lit(1)).alias("path")))


def detection_line(line: Column) -> Column:
    """(coarse, parts, path) of a detection's line, parts an array of (class, score)."""
    listed = F.filter(F.split(F.regexp_extract(line, r"nudenet_parts=\[([^\]]*)\]", 1), ", "), lambda p: F.contains(p, F.lit(":")))
    parts = F.transform(listed, lambda p: F.struct(F.substring_index(p, ":", 1).alias("class"), F.substring_index(p, ":", -1).try_cast("double").alias("score")))
    return F.struct(F.regexp_extract(line, r"falcon=([0-9.]+)", 1).try_cast("double").alias("coarse"), parts.alias("parts"), F.regexp_extract(line, r"nudenet_parts=\[[^\]]*\] (.+)$", 1).alias("path"))
