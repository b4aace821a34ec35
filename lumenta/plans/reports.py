"""Reports as tables of lines.

A report is (folder, part, key, line): part 0 is the head of a folder's file, 1 its body, 2 its
foot, and key orders the lines of a part.  Any number of lines can be written: sinks.write_lines
deals them to tasks by ranges of that order, so that no task holds a whole report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalars as S
from ..operators import catalog as C

#: The columns of the file list and of the CSV report, and the words of the logs.
FILELIST = ("Filename", "Date", "Size", "Device", "Params", "Lens", "GPS", "Source")
FILELIST_NAMES = ("文件名", "拍摄时间", "大小", "设备", "参数", "镜头", "GPS", "原始路径")
CSV = ("序号", "原始路径", "目标路径", "设备类型", "媒体类型", "设备品牌", "设备型号", "拍摄日期", "文件大小(字节)", "有EXIF日期", "状态", "哈希", "重复原始文件", "错误信息")
SECTIONS = ("概览", "来源文件夹", "设备统计", "重复文件", "详细溯源")
CARDS = ("发现总数", "照片", "视频", "相机", "手机", "未识别", "成功复制", "重复跳过", "非目标跳过", "无设备信息", "小图过滤", "错误")
RULE = "#" + "-" * 80
DONE, TRIED = ("已删除", "已删除"), ("可删除(dry-run)", "可删除")


def folder_of(path: str) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _framed(body: DataFrame, frame: DataFrame) -> DataFrame:
    """body (folder, key, line) between the lines of frame (folder, head, foot)."""

    def lines(c: str, part: int) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(part).alias("part"), F.lpad(i.cast("string"), 6, "0").alias("key"), x.alias("line")))

    edge = F.concat(lines("head", 0), lines("foot", 2))
    edges = frame.select("folder", F.explode(edge).alias("e")).select("folder", "e.part", "e.key", "e.line")
    return body.select("folder", F.lit(1).alias("part"), "key", "line").unionByName(edges)


def filelist_lines(records: DataFrame, remark: str = "") -> DataFrame:
    """K04, K05 (with a remark), T03, G23: the list of each destination folder, in columns as
    wide as their widest cell.  records has source, destination, status, make, model, date_taken, file_size,
    iso, aperture, shutter, focal_length, lens and gps; records that are not copied are left out."""
    own = records.filter(F.col("status").isin("ok", "dry_run") & (F.col("destination") != ""))
    device = F.when(S.filled(F.col("make")).isNotNull(), F.trim(F.concat_ws(" ", "make", "model"))).otherwise("")
    cells = (
        base_of("destination"), _text("date_taken"), S.human_size(F.col("file_size")), device,
        S.exposure(F.col("iso"), F.col("aperture"), F.col("shutter"), F.col("focal_length")), _text("lens"), _text("gps"), F.col("source"),
    )
    rows = own.select(folder_of("destination").alias("folder"), *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    widths = [F.greatest(F.max(S.display_width(F.col(f"c{k}"))), F.lit(len(n))).alias(f"w{k}") for k, n in enumerate(FILELIST)]
    wide = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), *widths)
    last = len(FILELIST) - 1

    def joined(values) -> Column:
        return F.concat_ws(" | ", *[S.padded(v, F.col(f"w{k}")) if k < last else v for k, v in enumerate(values)])

    body = rows.join(wide, "folder").select("folder", F.concat_ws("\x00", "c0", f"c{last}").alias("key"), joined([F.col(f"c{k}") for k in range(last + 1)]).alias("line"))
    names = " | ".join(f"{a}({b})" for a, b in zip(FILELIST_NAMES, FILELIST, strict=True))
    head = F.array(
        F.concat(F.lit("# 文件列表 — 共 "), F.col("n").cast("string"), F.lit(f" 个文件{remark}")), F.concat(F.lit("# 目标目录: "), "folder"), F.lit(f"# 列: {names}"), F.lit("#"),
        joined([F.lit(n) for n in FILELIST]), F.concat_ws("-+-", *[F.repeat(F.lit("-"), F.col(f"w{k}").cast("int")) for k in range(last + 1)]),
    )
    return _framed(body, wide.select("folder", head.alias("head"), F.array().cast("array<string>").alias("foot")))


def csv_rows(records: DataFrame) -> DataFrame:
    """The 14 columns of the report, numbered by source and destination."""
    shown = C.numbered(records, [F.col("source"), _text("destination")], "_n")
    kind = F.coalesce(S.lookup(F.col("device_type"), dims.DEVICE_LABELS), F.col("device_type"))
    status = F.coalesce(S.lookup(F.col("status"), dims.STATUS_LABELS), F.col("status"))
    values = (
        F.col("_n"), F.col("source"), F.col("destination"), kind, F.when(F.col("media_type") == "video", "视频").otherwise("照片"), F.col("make"), F.col("model"), F.col("date_taken"),
        F.col("file_size"), F.when(F.col("has_exif_date"), "是").otherwise("否"), status, F.col("file_hash"), F.col("dup_of"), F.col("error_msg"),
    )
    return shown.select(*[v.alias(n) for v, n in zip(values, CSV, strict=True)])


def csv_lines(records: DataFrame) -> DataFrame:
    """csv_rows as lines, with the byte order mark that spreadsheets want; missing values
    are empty, and a cell is quoted where it must be."""
    rows = csv_rows(records)

    def cell(c: str) -> Column:
        text = _text(c)
        return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    body = rows.select(F.lit("").alias("folder"), F.lpad(F.col(CSV[0]).cast("string"), 20, "0").alias("key"), F.concat_ws(",", *[cell(c) for c in CSV]).alias("line"))
    spark = records.sparkSession
    return _framed(body, spark.range(1).select(F.lit("").alias("folder"), F.array(F.lit("﻿" + ",".join(CSV))).alias("head"), F.array().cast("array<string>").alias("foot")))


# ------------------------------------------------------------------------ HTML


def _html(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _cells(*values: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), _html(v), F.lit("</td>")) for v in values], F.lit("</tr>"))


def run_summary(records: DataFrame, explicit_root: str = "", document_root: str = "") -> DataFrame:
    """One row of counts; explicit and document count copied files by where they go."""
    kind, media, status = F.col("device_type"), F.col("media_type"), F.col("status")
    copied = status.isin("ok", "dry_run")

    def below(root: str) -> Column:
        return F.startswith(F.lower("destination"), F.lit(root.lower() + "/")) if root else F.lit(False)

    score = F.col("explicit_score").isNotNull() if "explicit_score" in records.columns else F.lit(False)
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(media == "photo").alias("photos"), F.count_if(media == "video").alias("videos"),
        F.count_if(kind == "camera").alias("camera"), F.count_if(kind == "phone").alias("phone"), F.count_if(kind == "unknown").alias("unknown"),
        F.count_if(copied).alias("copied"), F.count_if(status.isin("skipped_dup", "skipped_exists")).alias("duplicates"), F.count_if(status == "skipped_not_target").alias("not_target"),
        F.count_if(status == "skipped_no_device").alias("no_device"), F.count_if(status == "skipped_filtered").alias("filtered"), F.count_if(status == "error").alias("errors"),
        F.count_if(copied & (below(explicit_root) | score)).alias("explicit"), F.count_if(copied & below(document_root)).alias("documents"),
    )


def folder_summary(records: DataFrame) -> DataFrame:
    """Counts of each source folder."""
    kind, status = F.col("device_type"), F.col("status")
    return records.groupBy(folder_of("source").alias("path")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind == "camera").alias("camera"), F.count_if(kind == "phone").alias("phone"), F.count_if(~kind.isin("camera", "phone")).alias("unknown"),
        F.count_if(status.isin("ok", "dry_run")).alias("copied"), F.count_if(status == "skipped_dup").alias("dup"),
        F.count_if(status.isin("skipped_not_target", "skipped_no_device")).alias("not_target"), F.count_if(status == "skipped_filtered").alias("filtered"),
    )


def device_summary(records: DataFrame) -> DataFrame:
    """Counts of each device."""
    video = F.col("media_type") == "video"
    found = records.groupBy("make", "model", "device_type").agg(F.count(F.lit(1)).alias("count"), F.count_if(~video).alias("photos"), F.count_if(video).alias("videos"))
    return found.withColumn("is_target", (F.col("make") != "") & S.any_of(F.lower("make"), dims.TARGET_BRANDS))


_STYLE = "body{font-family:sans-serif;margin:1em}table{border-collapse:collapse;font-size:12px}td,th{border:1px solid #ddd;padding:4px}.card{display:inline-block;padding:10px;margin:4px;background:#eef}"
_SCRIPT = """var shown=[...document.querySelectorAll('#detail tbody tr')],wanted=[...document.querySelectorAll('#detail input')];
wanted.forEach(function(w){w.oninput=function(){shown.forEach(function(r){r.hidden=!wanted.every(function(x,k){return r.cells[k+1].textContent.toLowerCase().includes(x.value.trim().toLowerCase())})})}});"""


def html_lines(records: DataFrame, title: str) -> DataFrame:
    """A page of five sections: summary cards, source folders and devices by
    their number of files, duplicates beside what was kept, and every record.  Inputs over the
    columns of the last table hide the rows that lack their text.  The records stand in the
    page as data, too, one JSON array a line."""
    summary = run_summary(records)
    card = [F.concat(F.lit('<div class="card"><b>'), F.col(c).cast("string"), F.lit(f"</b><br>{n}</div>")) for c, n in zip(summary.columns, CARDS, strict=False)]
    cards = summary.select(F.concat(*card).alias("line"))
    folders = C.numbered(folder_summary(records), [-F.col("total"), F.col("path")], "n")
    devices = C.numbered(device_summary(records), [-F.col("count"), F.col("make"), F.col("model"), F.col("device_type")], "n")
    dups = C.numbered(records.filter("status = 'skipped_dup'").select("source", "dup_of", "file_hash", "file_size"), [F.col("source"), F.col("dup_of")], "n")
    detail = C.numbered(records, [F.col("source"), _text("destination")], "n")
    kind = F.coalesce(S.lookup(F.col("device_type"), dims.DEVICE_LABELS), F.lit(dims.DEVICE_LABELS["unknown"]))
    status = F.coalesce(S.lookup(F.col("status"), dims.STATUS_LABELS), F.col("status"))
    make_model = F.concat_ws(" / ", S.filled(F.col("make")), S.filled(F.col("model")))
    full = (
        F.col("source"), F.coalesce(S.filled(F.col("destination")), F.lit("-")), F.col("device_type"), F.when(F.col("media_type") == "video", "视频").otherwise("照片"),
        make_model, F.coalesce(S.filled(F.col("date_taken")), F.lit("-")), S.human_size(F.col("file_size"), spaced=True), status, F.coalesce(F.col("error_msg"), F.lit("")),
    )
    heads = (
        (), ("#", "来源文件夹", "总数", "相机", "手机", "未识别", "已复制", "重复", "非目标", "过滤"), ("品牌", "型号", "类型", "数量", "照片", "视频", "目标"),
        ("#", "重复文件（已跳过）", "原始文件（已保留）", "哈希", "大小"), ("#", "原始路径", "目标路径", "类型", "媒体", "品牌/型号", "日期", "大小", "状态", "备注"),
    )
    short = F.when(S.filled(F.col("file_hash")).isNotNull(), F.concat(F.substring("file_hash", 1, 16), F.lit("..."))).otherwise("-")
    bodies = (
        cards.select(F.lit(0).alias("n"), "line"),
        folders.select("n", _cells(*[F.col(c) for c in ("n", "path", "total", "camera", "phone", "unknown", "copied", "dup", "not_target", "filtered")]).alias("line")),
        devices.select("n", _cells(F.coalesce(S.filled(F.col("make")), F.lit("未知")), F.coalesce(S.filled(F.col("model")), F.lit("未知")), kind, F.col("count"), F.col("photos"), F.col("videos"), F.when(F.col("is_target"), "✓").otherwise("—")).alias("line")),
        dups.select("n", _cells(F.col("n"), F.col("source"), F.col("dup_of"), short, S.human_size(F.col("file_size"), spaced=True)).alias("line")),
        detail.select("n", _cells(F.col("n"), *full).alias("line")),
    )

    def key(section: int, part: int, n: Column) -> Column:
        return F.concat(F.lit(f"{section}{part}"), F.lpad(n.cast("string"), 20, "0"))

    spark = records.sparkSession
    lines = []
    for k, (body, columns, name) in enumerate(zip(bodies, heads, SECTIONS, strict=True)):
        lines.append(body.select(key(k, 1, F.col("n")).alias("key"), "line"))
        top = "".join(f"<th>{c}</th>" for c in columns)
        inputs = "<tr><td></td>" + "<td><input></td>" * (len(columns) - 1) + "</tr>" if k == 4 else ""
        opened = f'<section id="s{k}"><h2>{name}</h2>' + (f'<table{" id=detail" if k == 4 else ""}><thead><tr>{top}</tr>{inputs}</thead><tbody>' if columns else "")
        closed = ("</tbody></table>" if columns else "") + "</section>"
        lines.append(spark.range(1).select(F.explode(F.array(*[F.struct(key(k, p, F.lit(0)).alias("key"), F.lit(t).alias("line")) for p, t in ((0, opened), (2, closed))])).alias("e")).select("e.*"))
    # a closing tag inside a value would end the script
    data = F.concat(F.lit("DATA.push("), F.replace(F.to_json(F.array(F.col("n").cast("string"), *[F.coalesce(x.cast("string"), F.lit("")) for x in full])), F.lit("</"), F.lit("<\\/")), F.lit(");"))
    lines.append(detail.select(key(5, 1, F.col("n")).alias("key"), data.alias("line")))
    body = reduce(DataFrame.unionByName, lines).select(F.lit("").alias("folder"), "key", "line")
    page = [f"<!DOCTYPE html><html lang='zh-CN'><meta charset='utf-8'><title>{title}</title><style>{_STYLE}</style>", f"<h1>{title}</h1>", "<script>var DATA=[];</script>"]
    frame = spark.range(1).select(F.lit("").alias("folder"), F.array(*[F.lit(x) for x in page]).alias("head"), F.array(F.lit(_SCRIPT), F.lit("</script></html>")).alias("foot"))
    opening = spark.range(1).select(F.lit("").alias("folder"), key(5, 0, F.lit(0)).alias("key"), F.lit("<script>").alias("line"))
    return _framed(body.unionByName(opening), frame)


# ------------------------------------------------------------------------ logs


def cleanup_lines(checked: DataFrame, at: str, execute: bool = False, by_hash: bool = False) -> DataFrame:
    """The log of each source folder.  checked has source, dest, outcome, s_size and d_size,
    as verify_pairs gives them with sizes; by_hash is the mode that lists matches only."""
    mode = "执行删除" if execute else "试运行(dry-run)"
    word, total = DONE if execute else TRIED
    outcome, size = F.col("outcome"), F.coalesce(S.human_size(F.col("s_size")), F.lit("-"))
    told = (
        F.when(outcome == "verified", word)
        .when(outcome == "src_missing", "源文件不存在")
        .when(outcome == "dest_missing", "目标文件不存在")
        .when(outcome == "size_mismatch", F.concat(F.lit("大小不匹配("), size, F.lit(" vs "), S.human_size(F.col("d_size")), F.lit(")")))
        .otherwise("哈希不匹配")
    )
    seen = F.when(outcome.isin("src_missing", "dest_missing"), "-").otherwise(size)
    rows = (checked.filter(outcome == "verified") if by_hash else checked).withColumn("folder", folder_of("source"))
    body = rows.select("folder", F.concat_ws("\x00", "source", "dest").alias("key"), F.concat_ws(" | ", told, "source", seen, "dest").alias("line"))
    per = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.count_if(outcome == "verified").alias("ok"), F.coalesce(F.sum(F.when(outcome == "verified", F.col("s_size"))), F.lit(0)).alias("bytes"))
    kind, count, columns = ("哈希比对", "匹配数", "目标文件(哈希匹配)") if by_hash else ("溯源记录", "记录数", "目标文件")
    head = F.array(
        F.lit(f"# 源文件清理日志 ({kind}) - {mode}"), F.lit(f"# 生成时间: {at}"), F.concat(F.lit("# 源目录: "), "folder"), F.concat(F.lit(f"# {count}: "), F.col("n").cast("string")),
        F.lit("#"), F.lit(f"# 格式: 状态 | 源文件 | 大小 | {columns}"), F.lit(RULE),
    )
    foot = F.array(F.lit(RULE), F.concat(F.lit(f"# 小计: {total} "), F.col("ok").cast("string"), F.lit(" 个文件, 释放 "), S.human_size(F.col("bytes"))))
    return _framed(body, per.select("folder", head.alias("head"), foot.alias("foot")))


def restore_lines(matches: DataFrame, backup: str, organised: str, at: str, existing: int = 0, execute: bool = False) -> DataFrame:
    """The log of a restore run, from the rows (path, hash, size, found) of restore_matches."""
    found = F.col("found").isNotNull()
    word = "已恢复" if execute else "可恢复(dry-run)"
    told = F.when(found, word).otherwise(F.concat(F.lit("无来源(hash="), F.substring("hash", 1, 12), F.lit(")")))
    body = matches.select(F.lit(backup).alias("folder"), F.col("path").alias("key"), F.concat_ws(" | ", told, "path", S.human_size(F.col("size")), F.coalesce("found", F.lit("-"))).alias("line"))
    per = matches.agg(F.count_if(found).alias("ok"), F.count_if(~found).alias("lost"))
    head = [f"# 恢复日志 - {'执行恢复' if execute else '试运行(dry-run)'}", f"# 生成时间: {at}", f"# 备份目录: {backup}", f"# 来源目录: {organised}", "# 格式: 状态 | 恢复到 | 大小 | 复制自", RULE]
    total = F.concat(F.lit(f"# 小计: {'已恢复' if execute else '可恢复'} "), F.col("ok").cast("string"), F.lit(f", 已存在 {existing}, 无来源 "), F.col("lost").cast("string"), F.lit(", 错误 0"))
    return _framed(body, per.select(F.lit(backup).alias("folder"), F.array(*[F.lit(x) for x in head]).alias("head"), F.array(F.lit(RULE), total).alias("foot")))


def score_list_lines(scores: DataFrame, threshold: float) -> DataFrame:
    """(score, path) at or over the threshold, the highest first."""
    own = scores.filter(F.col("score") >= threshold)
    body = C.numbered(own, [-F.col("score"), F.col("path")], "n")
    body = body.select(F.lit("").alias("folder"), F.lpad(F.col("n").cast("string"), 20, "0").alias("key"), F.format_string("%.4f | %s", "score", "path").alias("line"))
    head = F.array(F.lit(f"# NSFW 文件列表 (阈值 >= {threshold:.2f})"), F.concat(F.lit("# 共 "), F.col("n").cast("string"), F.lit(" 个文件")), F.lit("# 格式: 分数 | 文件路径"), F.lit(""))
    return _framed(body, own.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("folder"), head.alias("head"), F.array().cast("array<string>").alias("foot")))


def detection_lines(found: DataFrame) -> DataFrame:
    """(coarse, parts, path), parts an array of (class, score), as lines that A20 reads."""
    parts = F.array_join(F.transform("parts", lambda p: F.format_string("%s:%.2f", p["class"], p["score"])), ", ")
    line = F.concat(F.lit("[ NSFW] falcon="), F.format_string("%.4f", "coarse"), F.lit(" nudenet_parts=["), parts, F.lit("] "), F.col("path"))
    return found.select(F.lit("").alias("folder"), F.lit(1).alias("part"), F.col("path").alias("key"), line.alias("line"))


def people_lines(members: DataFrame) -> DataFrame:
    """One JSON line a file of each person, from (person, path), with the person's counts:
    a person's files never gather in one value."""
    own = members.filter("person is not null")
    per = own.groupBy("person").agg(F.count(F.lit(1)).alias("face_count"), F.count_distinct("path").alias("photo_count"))
    rows = own.select("person", "path").distinct().join(per, "person")
    return rows.select(F.lit("").alias("folder"), F.lit(1).alias("part"), F.concat_ws("\x00", "person", "path").alias("key"), F.to_json(F.struct("person", "face_count", "photo_count", "path")).alias("line"))
