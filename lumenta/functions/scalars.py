"""Scalar functions F01-F42 as Column -> Column; all run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def any_of(c: Column, words) -> Column:
    """c contains one of words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def lookup(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def filled(c: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(F.trim(c), F.lit(""))


def _stamp(y, mo, d, h, mi, s) -> Column:
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, s)


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


#: The loose layout of a date in metadata, and time stamps in file names.
LOOSE_DATE = r"([0-9]{4})[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})(?:[^0-9]+([0-9]{1,2})[^0-9]+([0-9]{1,2})(?:[^0-9]+([0-9]{1,2}))?)?"
NAME_STAMPS = (r"(?:mmexport|wx_camera|wx)_?([0-9]{10,13})", r"(?<![0-9])([0-9]{10}|[0-9]{13})(?![0-9])")


def exif_datetime(c: Column) -> Column:
    """the five fixed layouts, then a loose one with a year from 1970 to 2099."""
    c = F.trim(F.regexp_replace(c, r"\x00+$", ""))
    dead = (c == "") | c.startswith("0000")
    fixed = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in ("y:M:d H:m:s", "y-M-d H:m:s", "y/M/d H:m:s", "y:M:d", "y-M-d")]
    p = LOOSE_DATE
    y, mo, d, h, mi, s = (_group(c, p, k) for k in range(1, 7))
    loose = F.when(y.between(1970, 2099), _stamp(y, mo, d, _or_zero(h), _or_zero(mi), _or_zero(s)))
    return F.when(~dead, F.coalesce(*fixed, loose))


def iso_datetime(c: Column) -> Column:
    """ISO layouts; with a zone, to the session's wall clock."""
    c = F.trim(c)
    zoned = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd HH:mm:ssXX")]
    plain = [F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    return F.when(~c.startswith("0000"), F.coalesce(*zoned, *plain))


#: The layouts of dates in file names, in order of trust; the group holds the
#: date and time, whose digits have fixed places.
NAME_DATES = (
    r"(?:IMG|VID|C360|Screenshot|PANO|MVIMG)_([0-9]{8}_[0-9]{6})",
    r"^([0-9]{8}_[0-9]{6})",
    r"^([0-9]{4}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}(?:_[0-9]{2})?)",
    r"([0-9]{4}-[0-9]{2}-[0-9]{2}[\s_T][0-9]{2}[:\-.]?[0-9]{2}[:\-.]?[0-9]{2})",
    r"(?:IMG|VID|C360|Screenshot|PANO|DSC|DSCN|DSCF|SAM)_([0-9]{8})(?![0-9])",
    r"(?<![0-9])([0-9]{4}[-_][0-9]{2}[-_][0-9]{2})(?![0-9])",
    r"(?<![0-9])([0-9]{8})(?![0-9])",
)
OLDEST_SECOND, OLDEST_YEAR = 738892800, 1993


def _plausible(seconds: Column, now: Column) -> Column:
    """F06"""
    return F.when(seconds.between(OLDEST_SECOND, F.unix_timestamp(now) + 86400), F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def name_datetime(name: Column, now: Column | None = None) -> Column:
    """A date in a file name, then a Unix time with a known prefix, then a bare one."""
    now = F.current_timestamp() if now is None else now

    def stamp(digits: Column) -> Column:
        y, *rest = (F.substring(digits, at, n).cast("int") for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2)))
        return F.when(y.between(OLDEST_YEAR, F.year(now)), _stamp(y, *rest))

    def search(stem: Column) -> Column:
        found = []
        for p in NAME_DATES:
            digits = F.regexp_replace(F.nullif(F.regexp_extract(stem, p, 1), F.lit("")), "[^0-9]", "")
            found.append(let(F.rpad(digits, 14, "0"), stamp))
        for p in NAME_STAMPS:
            digits = F.nullif(F.regexp_extract(stem, p, 1), F.lit(""))
            value = digits.cast("long")
            found.append(_plausible(F.when(F.length(digits) == 13, F.floor(value / 1000)).otherwise(value), now))
        # every layout has eight digits, with single characters between them at most
        return F.when(stem.rlike(r"[0-9]{4}[^0-9]?[0-9]{2}[^0-9]?[0-9]{2}"), F.coalesce(*found))

    return let(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), search)


def plausible_mtime(mtime: Column, now: Column) -> Column:
    """F07"""
    return F.when((F.year(mtime) >= OLDEST_YEAR) & (mtime <= now + F.expr("INTERVAL 1 DAY")), mtime)


def effective_date(exif: Column, has_exif: Column, mtime: Column, name: Column, now: Column) -> Column:
    """the EXIF date, a plausible file time, the name's date."""
    return F.coalesce(F.when(has_exif, exif), plausible_mtime(mtime, now), name_datetime(name, now))


def quarter_label(date: Column) -> Column:
    """F09"""
    q = F.quarter(date)
    months = [F.concat_ws("-", *[(q * 3 - k).cast("string") for k in (2, 1, 0)])][0]
    return F.concat(F.lit("Q"), q.cast("string"), F.lit("-M"), months)


def date_folder(date: Column) -> Column:
    """F10"""
    return F.coalesce(F.concat(F.year(date).cast("string"), F.lit("-"), quarter_label(date)), F.lit(dims.UNKNOWN_DATE))


def folder_name(c: Column) -> Column:
    """a name that every file system takes."""
    c = F.regexp_replace(F.trim(c), r'[\x00-\x1f<>:"/\\|?*]', "_")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[. ]+|[. ]+$", "")
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(dims.UNKNOWN_MODEL))


def first_codes() -> dict[str, str]:
    """lower-case marketing name to its first model code."""
    codes: dict[str, str] = {}
    for code, name in dims.XIAOMI_NAMES.items():
        codes.setdefault(name.lower(), code.upper())
    return codes


def fast_hash(text: Column) -> Column:
    """size, head and tail of a content."""
    tail = F.when(F.length(text) > 32768, F.right(text, F.lit(16384)))
    return F.md5(F.concat_ws("|", F.length(text).cast("string"), F.substring(text, 1, 16384), tail))


def fraction(c: Column) -> Column:
    """F16: EXIF rationals for people."""
    n, d = (F.nullif(F.regexp_extract(c, r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*$", k), F.lit("")).cast("double") for k in (1, 2))

    def shown(x: Column) -> Column:
        whole = F.when(x < 1, F.concat(F.lit("1/"), F.bround(1 / x).cast("long").cast("string"))).when(x == F.floor(x), x.cast("long").cast("string"))
        return whole.otherwise(F.when(x.isNotNull(), F.format_string("%.1f", x)))

    value = let(F.struct(n.alias("n"), d.alias("d")), lambda r: F.when((r["d"] != 0) & (r["n"] != 0), r["n"] / r["d"]))
    return F.coalesce(let(value, shown), c)


def human_size(size: Column, spaced: bool = False) -> Column:
    """F17; spaced is F18."""
    size = size.cast("double")
    gap, first = (" ", "%.1f") if spaced else ("", "%.0f")
    out = F.format_string(f"%.1f{gap}TB", F.bround(size / 1024.0**4, 1))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        value = size / 1024.0**k
        form = first if k == 0 else "%.1f"
        out = F.when(F.abs(value) < 1024, F.format_string(f"{form}{gap}{unit}", F.bround(value, 0 if form == "%.0f" else 1))).otherwise(out)
    return out


def exposure(iso: Column, aperture: Column, shutter: Column, focal: Column) -> Column:
    """missing parts are left out."""
    parts = [F.concat(F.lit("ISO"), filled(iso)), F.concat(F.lit("f/"), fraction(filled(aperture))), F.concat(fraction(filled(shutter)), F.lit("s")), F.concat(fraction(filled(focal)), F.lit("mm"))]
    return F.concat_ws(" ", *parts)


def gps_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """F20, of one coordinate."""
    return F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1) * (d + m / 60 + s / 3600)


@cache
def wide_characters() -> str:
    """A regex class of the characters that take two places, by the rule of Unicode's East Asian
    width."""
    ranges: list[list[int]] = []
    for point in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000 and unicodedata.east_asian_width(chr(point)) in "FW":
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def display_width(c: Column) -> Column:
    """East Asian wide characters take two places."""
    return F.length(c) + F.regexp_count(c, F.lit(wide_characters()))


def padded(c: Column, width: Column) -> Column:
    """spaces to a display width."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(width - display_width(c), F.lit(0)).cast("int")))


def screenshot(name: Column) -> Column:
    """F24"""
    return any_of(F.lower(name), dims.SCREENSHOT_KEYWORDS)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^./\\]*)$", 1))


def media_type(name: Column) -> Column:
    """A05"""
    e = extension(name)
    return F.when(e.isin(*dims.VIDEO_EXTENSIONS), "video").when(e.isin(*dims.IMAGE_EXTENSIONS), "photo")


def raw_image(name: Column) -> Column:
    """F25"""
    return extension(name).isin(*dims.RAW_EXTENSIONS)


def drone_flag(make: Column, app: Column) -> Column:
    """F26"""
    return F.contains(F.lower(F.coalesce(make, F.lit(""))), F.lit("dji")) | F.startswith(F.lower(F.coalesce(app, F.lit(""))), F.lit("dji"))


def softmax(values: Column) -> Column:
    """F27, stable."""
    top = F.array_max(values)
    shifted = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def fuse(a: Column, b: Column) -> Column:
    """two document scores."""
    high = F.greatest(a, b)
    return F.when(a < 0.15, 0.15 * high).when(high >= 0.8, high).when((a >= 0.4) & (b >= 0.4), high).otherwise(0.3 * high)


def detection_score(detections: Column, classes, floor: float = 0.5) -> Column:
    """the largest score among the classes that count."""
    own = F.filter(detections, lambda x: x["class"].isin(*classes) & (x["score"] >= floor))
    return F.coalesce(F.array_max(F.transform(own, lambda x: x["score"])), F.lit(0.0))


def frame_times(seconds: Column, n: int = 3) -> Column:
    """up to n evenly spaced times inside a clip; an unknown length counts as 30 s."""
    seconds = F.coalesce(F.when(seconds > 0, seconds), F.lit(30.0))
    step = F.greatest(seconds / (n + 1), F.lit(1.0))
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * step), lambda t: t < seconds)


def duration(c: Column) -> Column:
    """F32"""
    p = r"Duration:\s*([0-9]+):([0-9]+):([0-9]+(?:\.[0-9]+)?)"
    h, m, s = (F.nullif(F.regexp_extract(c, p, k), F.lit("")).cast("double") for k in (1, 2, 3))
    return h * 3600 + m * 60 + s


def normalised(v: Column) -> Column:
    """F33"""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def note(source: Column, media: Column, make: Column, device: Column, has_date: Column, taken: Column, mtime: Column) -> Column:
    """F35, first that holds; an unknown device with a maker has no note, whatever its date."""
    return (
        F.when(filled(source).isNotNull(), source)
        .when((device == "unknown") & filled(make).isNotNull(), "")
        .when((device == "unknown") & (media == "video"), dims.NOTES["video"])
        .when(device == "unknown", dims.NOTES["device"])
        .when(has_date | taken.isNotNull(), "")
        .otherwise(F.when(mtime.isNotNull(), dims.NOTES["mtime"]).otherwise(dims.NOTES["date"]))
    )


def same_time(m1: Column, c1: Column, m2: Column, c2: Column) -> Column:
    """one of two times agrees with one of two others, in seconds, to a hundredth."""
    return reduce(lambda a, b: a | b, [F.coalesce((x > 0) & (y > 0) & (F.abs(x - y) < 0.01), F.lit(False)) for x in (m1, c1) for y in (m2, c2)])


def named_device(name: Column) -> Column:
    """make of a file by the opening of its name."""
    low = F.lower(name)
    return F.when(F.startswith(low, F.lit("c360_")) | F.startswith(low, F.lit("http_imgload")), "Xiaomi")


def short_name(name: Column) -> Column:
    """a name of more than 50 characters with its middle left out; the extension stays."""
    ext = F.regexp_extract(name, r"(?s).(\.[^./\\]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(F.length(name) > 50, F.concat(F.substring(stem, F.lit(1), 46 - F.length(ext)), F.lit("..."), ext)).otherwise(name)


def on_other_drive(path: Column, destinations) -> Column:
    """A path that lies on no drive of the destinations; paths without a drive letter do."""
    letters = sorted({d[0].upper() for d in destinations if len(d) >= 2 and d[1] == ":"})
    letter = F.when(F.substring(path, 2, 1) == ":", F.upper(F.substring(path, 1, 1)))
    return ~F.coalesce(letter.isin(*letters), F.lit(False)) if letters else F.lit(True)


def natural_name(name: Column) -> Column:
    """without the suffix that conflict resolution adds."""
    return F.regexp_replace(name, r"(?i)_po([0-9]+)(\.[^.]+)$", "$2")


# ------------------------------------------------------------- classification


def device_type(make: Column, model: Column) -> Column:
    """P01"""
    make, model = F.lower(F.trim(F.coalesce(make, F.lit("")))), F.lower(F.trim(F.coalesce(model, F.lit(""))))
    sony = F.when(any_of(model, dims.SONY_PHONE_KEYWORDS), "phone").when(any_of(model, dims.SONY_CAMERA_KEYWORDS), "camera").otherwise("unknown")
    return (
        F.when(make == "", "unknown")
        .when(make.isin(*dims.AMBIGUOUS_BRANDS), sony)
        .when(any_of(make, dims.CAMERA_BRANDS), "camera")
        .when(any_of(make, dims.PHONE_BRANDS), "phone")
        .otherwise("unknown")
    )


def target_device(make: Column, model: Column) -> Column:
    """P02"""
    make, model = F.lower(F.trim(F.coalesce(make, F.lit("")))), F.lower(F.trim(F.coalesce(model, F.lit(""))))
    both = F.concat(make, F.lit(" "), model)
    return F.when((make == "") | model.isin(*dims.EXCLUDED_TARGETS), False).otherwise(any_of(make, dims.TARGET_BRANDS) | any_of(both, dims.TARGET_MODELS))


def small_image(media: Column, size: Column, width: Column, height: Column) -> Column:
    """P05"""
    tiny = ((size > 0) & (size < dims.MIN_FILE_BYTES)) | (width.between(1, dims.MIN_DIMENSION - 1) & height.between(1, dims.MIN_DIMENSION - 1))
    return (media == "photo") & tiny


def first_folder(path: Column, root: str) -> Column:
    """The folder under root that a path lies in; null outside.  Case is ignored."""
    inside = F.startswith(F.lower(path), F.lit(root.lower() + "/"))
    return F.when(inside, F.lower(F.substring_index(F.substring(path, F.lit(len(root) + 2), F.length(path)), "/", 1)))


def classified(path: Column, root: str) -> Column:
    """P06"""
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(first_folder(path, root), F.lit(p)) for p in dims.CLASSIFIED_PREFIXES]), F.lit(False))


def frozen(path: Column, root: str) -> Column:
    """P07"""
    return F.coalesce(reduce(lambda a, b: a | b, [F.startswith(first_folder(path, root), F.lit(p)) for p in dims.FROZEN_PREFIXES]), F.lit(False))


def device_suffix(label: Column, path: Column, suffixes: dict[str, str], output: str | None = None) -> Column:
    """F12, the last two steps: "label (suffix)" by the first of the source folders that holds
    the path; else, below output, the label of the device folder the file already stands in,
    if that is this label with a suffix."""
    named = F.when(F.lit(False), label)
    for folder, suffix in suffixes.items():
        named = named.when(F.startswith(path, F.lit(f"{folder}/")), F.concat(label, F.lit(f" ({suffix})")))
    if output is None:
        return named.otherwise(label)
    parts = F.split(F.substring(path, F.lit(len(output) + 2), F.length(path)), "/")
    folder = F.get(parts, F.lit(1))
    own = F.trim(F.regexp_extract(folder, r"(?U)^(.+?)\s*\(\w+\)$", 1))
    inherits = F.startswith(path, F.lit(f"{output}/")) & (F.size(parts) >= 3) & F.lower(F.get(parts, F.lit(0))).rlike("^all_[1-5]_")
    return named.when(inherits & (own != "") & (F.lower(own) == F.lower(label)), folder).otherwise(label)
