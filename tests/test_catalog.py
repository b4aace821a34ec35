"""Catalog queries against their SQL twins, scalar tables, sources and clustering."""

import bisect
import collections
import csv
import datetime as dt
import html.parser
import io
import json
import math
import re
import struct
import unicodedata

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenta import harness
from lumenta.functions import images
from lumenta.functions import scalars as S
from lumenta.operators import catalog, people, planning
from lumenta.plans import reports, sinks
from lumenta.sources import containers, filelists, media
from lumenta.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


@pytest.mark.parametrize("name", sorted(harness.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = harness.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((str(tuple(norm(x) for x in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()))
    rel = duck.execute(harness.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str(tuple(norm(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


def value(spark, make, *args):
    names = [f"c{k}" for k in range(len(args))]
    row = spark.range(1).select(*[F.lit(a).alias(n) for a, n in zip(args, names, strict=True)])
    return row.select(make(*[F.col(n) for n in names])).first()[0]


D = dt.datetime


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024:01:15 10:30:00", D(2024, 1, 15, 10, 30)), ("2024-1-5 1:2:3", D(2024, 1, 5, 1, 2, 3)), ("2024/01/15 10:30:00", D(2024, 1, 15, 10, 30)),
        ("2024:01:15", D(2024, 1, 15)), ("2024年01月15日 10时30分", D(2024, 1, 15, 10, 30)), ("0000:00:00 00:00:00", None), ("2024:02:30 00:00:00", None),
        ("2024:01:15 10:30:00\x00", D(2024, 1, 15, 10, 30)), ("", None),
    ],
)
def test_exif_datetime(spark, text, want):
    assert value(spark, S.exif_datetime, text) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("IMG_20120906_101406.jpg", D(2012, 9, 6, 10, 14, 6)), ("20240102_030405.jpg", D(2024, 1, 2, 3, 4, 5)), ("2012_09_03_20_40.jpg", D(2012, 9, 3, 20, 40)),
        ("C360_2012-09-03-20-40-49.jpg", D(2012, 9, 3)), ("2024-01-15 10.30.00.png", D(2024, 1, 15, 10, 30)), ("DSC_20190501.jpg", D(2019, 5, 1)),
        ("mmexport1700000000000.jpg", D(2023, 11, 14, 22, 13, 20)), ("1700000000.jpg", D(2023, 11, 14, 22, 13, 20)), ("IMG_99991399.jpg", None), ("x.jpg", None),
    ],
)
def test_name_datetime(spark, name, want):
    assert value(spark, lambda c: S.name_datetime(c, F.lit("2026-01-01").cast("timestamp")), name) == want


@pytest.mark.parametrize(("text", "want"), [("8/5", "1.6"), ("1/200", "1/200"), ("1424131/5000000", "1/4"), ("50/1", "50"), ("1/0", "1/0"), ("0/1", "0/1"), ("abc", "abc"), ("", "")])
def test_fraction(spark, text, want):
    assert value(spark, S.fraction, text) == want


def test_names_and_devices(spark):
    assert value(spark, S.folder_name, ' a:b  c?. ') == "a_b c_"
    assert value(spark, S.folder_name, "  ") == "未知型号"
    assert value(spark, S.natural_name, "a_PO3.jpg") == "a.jpg"
    assert value(spark, S.device_type, "SONY", "Xperia Z") == "phone"
    assert value(spark, S.device_type, "Sony Ericsson", "W595c") == "phone"
    assert value(spark, S.target_device, "Apple", "iPhone 8") is False
    assert value(spark, S.target_device, "Canon", "EOS 700D") is True
    assert value(spark, S.target_device, "Canon", "EOS 1") is False


def test_resolved_names_are_unique(spark):
    plan = spark.createDataFrame([(k, d) for k, d in enumerate(["/o/a.jpg", "/o/A.jpg", "/o/a.jpg", "/o/a_po1.jpg", "/o/b.jpg"])], "ord int, dest string")
    out = [r.final for r in catalog.resolve_names(plan).orderBy("ord").collect()]
    assert len({x.lower() for x in out}) == 5 and out[0] == "/o/a.jpg" and out[3] == "/o/a_po1.jpg"


def test_conflict_chains(spark):
    """Against a loop that tries one number after the other."""

    def loop(wants, taken):
        names, seen = {x.lower() for x in [*wants, *taken]}, set()
        gone = {x.lower() for x in taken}
        for w in wants:
            new, n = w, 0
            while (n or w.lower() in seen | gone) and (not n or new.lower() in names):
                n += 1
                new = re.sub(r"(\.[^./]*)?$", lambda m: f"_po{n}{m[1] or ''}", w, count=1)
            seen.add(w.lower())
            names.add(new.lower())
            yield new

    cases = [
        (["/o/a.jpg", "/o/a.jpg", "/o/a_po1.jpg", "/o/a_po2.jpg"], []),
        (["/o/a.jpg", "/o/a.jpg"], ["/o/A_po1.JPG"]),
        (["/o/a.jpg"] * 6 + ["/o/A_po2.jpg", "/o/a_po2.jpg", "/o/a_po5.jpg"], ["/o/a.jpg", "/o/a_po3.jpg", "/o/a_po4.jpg", "/o/a_po2_po1.jpg", "/o/a_po07.jpg"]),
        (["/o.d/a", "/o.d/a", "/o.d/a_po1", "/o.d/a.b", "/o.d/a.b", "/o.d/a.b_po1"], ["/o.d/a_po2"]),
    ]
    for wants, taken in cases:
        plan = spark.createDataFrame(list(enumerate(wants)), "ord int, dest string")
        on_disk = spark.createDataFrame([(t,) for t in taken], "dest string") if taken else None
        out = [r.final for r in catalog.resolve_names(plan, on_disk).orderBy("ord").collect()]
        assert out == list(loop(wants, taken))
        assert len({x.lower() for x in [*out, *taken]}) == len(out) + len({x.lower() for x in taken})


def test_numbered(spark):
    """Ranges number like one window, whatever the ties of the first columns are."""
    rng = np.random.default_rng(4)
    rows = [(int(x), k, None if k % 7 == 0 else f"s{k % 5}") for k, x in enumerate(rng.integers(0, 6, 500))]
    df = spark.createDataFrame(rows, "x int, k int, s string").repartition(5)
    want = {r.k: r.n for r in catalog.numbered(df, [-F.col("x"), F.col("s"), F.col("k")]).collect()}
    assert sorted(want.values()) == list(range(1, 501))
    for size in (13, 100, 499):
        got = catalog.numbered(df, [-F.col("x"), F.col("s"), F.col("k")], "n", size)
        assert got.columns == [*df.columns, "n"] and {r.k: r.n for r in got.collect()} == want
    assert catalog.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_deduplicate_against_index(spark):
    files = spark.createDataFrame([(1, "/a", "h", False), (2, "/b", "h", True), (3, "/c", "g", False), (4, "/d", None, False), (5, "/e", None, False), (6, "/f", "i", False)], "ord int, path string, hash string, x boolean")
    index = spark.createDataFrame([("g", "/old/c"), ("i", "/f")], "hash string, existing string")
    got = {r.path: (r.status, r.dup_of) for r in catalog.deduplicate(files, index).collect()}
    assert got == {"/a": ("ok", None), "/b": ("skipped_dup", "/a"), "/c": ("skipped_dup", "/old/c"), "/d": ("ok", None), "/e": ("skipped_dup", "/d"), "/f": ("ok", None)}
    own = {r.path: r.status for r in catalog.deduplicate(files, index, special=F.col("x")).collect()}
    assert own["/b"] == "ok" and own["/c"] == "skipped_dup"


def test_companions(spark):
    a = spark.createDataFrame([("/s/DJI_1.MP4", "/o/x/DJI_1.MP4", 1, "DJI", "FC"), ("/s/DJI_1.MOV", "/o/y/DJI_1.MOV", 2, None, None), ("/t/DJI_2.MP4", "/t/DJI_2.MP4", 3, "", "")], "source string, destination string, ord int, make string, model string")
    files = spark.createDataFrame([(p, 1) for p in ("/s/DJI_1.SRT", "/s/DJI_1.jpg", "/s/dji_1.lrf", "/s/DJI_1", "/s/DJI_11.SRT", "/t/DJI_2.SRT", "/u/DJI_1.SRT", "/s/DJI_1.a.SRT")], "path string, size int")
    got = sorted(tuple(r) for r in catalog.companions(a, files).select("source", "destination", "make").collect())
    assert got == [("/s/DJI_1", "/o/x/DJI_1", "DJI"), ("/s/DJI_1.SRT", "/o/x/DJI_1.SRT", "DJI")]


def record_rows(spark):
    rows = [
        (1, "/s/a.jpg", "/o/x/a.jpg", "camera", "photo", "Canon", "EOS", "2024-01-01 10:00:00", True, 2048, "ok", "", "h" * 20, None), (2, "/s/b.mp4", "", "phone", "video", "", "", None, False, 10, "skipped_dup", "", "h" * 20, "/s/a.jpg"),
        (3, "/t/</script>.jpg", "/o/x/c.jpg", "unknown", "photo", "", "", None, False, 5, "error", 'bad "name", it is', "", None), (4, "/t/d.jpg", "/o/y/镜头.jpg", "phone", "photo", "Apple", "", "2024", True, 5, "dry_run", "", "g", None),
    ]
    names = "ord int, source string, destination string, device_type string, media_type string, make string, model string, date_taken string, has_exif_date boolean, file_size long, status string, error_msg string, file_hash string, dup_of string"
    df = spark.createDataFrame(rows, names)
    return df.withColumns({c: F.lit("") for c in ("iso", "aperture", "shutter", "focal_length", "lens", "gps")})


def test_report_files(spark, tmp_path):
    """What is written is read again: CSV by its reader, the page by a parser, lists by their lines."""
    df = record_rows(spark)
    sinks.write_page(reports.csv_lines(df), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    rows = list(csv.reader(io.StringIO(text.removeprefix("\ufeff"))))
    assert rows[0] == list(reports.CSV) and [r[0] for r in rows[1:]] == ["1", "2", "3", "4"] and rows[3][-1] == 'bad "name", it is' and rows[2][12] == "/s/a.jpg"
    sinks.write_page(reports.html_lines(df, "a report"), str(tmp_path / "html"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "html").glob("part-*")))
    seen = collections.Counter()

    class Reader(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            seen[tag] += 1

    Reader().feed(page)
    assert (seen["section"], seen["table"], seen["script"], seen["input"]) == (5, 4, 2, 9) and seen["tr"] == 5 + 3 + 4 + 1 + 4
    data = [json.loads(x) for x in re.findall(r"^DATA\.push\((.*)\);$", page, re.M)]
    assert [d[1] for d in data] == ["/s/a.jpg", "/s/b.mp4", "/t/</script>.jpg", "/t/d.jpg"]
    sinks.write_lines(reports.filelist_lines(df), str(tmp_path / "lists"))
    folders = sorted(p for p in (tmp_path / "lists").iterdir() if p.is_dir())
    assert len(folders) == 2
    lines = "".join(p.read_text() for p in sorted(folders[1].glob("part-*"))).splitlines()
    assert lines[:4] == ["# 文件列表 — 共 1 个文件", "# 目标目录: /o/y", lines[2], "#"] and len(lines) == 7
    assert {sum(2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in x.split(" | ")[0]) for x in (lines[4], lines[6])} == {8}
    assert spark.createDataFrame([(lines[6],)], "x string").select(filelists.pair(F.col("x"))).first()[0] == ("镜头.jpg", "/t/d.jpg")
    empty = df.limit(0)
    assert reports.filelist_lines(empty).count() == 0 and reports.csv_lines(empty).count() == 1 and reports.html_lines(empty, "t").count() > 10


def test_wide_characters(spark):
    texts = ["plain", "镜头", "ｗ", "é", "日本語 x", "", "😀a", "ﾊﾝ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.display_width(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [sum(2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in t) for t in texts]


def test_model_inputs():
    """Constant pictures stay, a size of its own changes nothing, shrinking averages."""
    rng = np.random.default_rng(7)
    flat = np.full((37, 91, 3), (10, 20, 30), np.uint8)
    assert (images.resized(flat, 224) == (10, 20, 30)).all()
    own = rng.integers(0, 256, (224, 224, 3), dtype=np.uint8)
    assert (images.resized(own, 224) == own).all()
    assert abs(images.resized(rng.integers(0, 256, (640, 640, 3), dtype=np.uint8), 4).astype(float) - 127.5).max() < 6
    x = images.tensor(flat, *images.COARSE)
    assert x.shape == (3, 224, 224) and np.allclose(x[:, 0, 0], (np.array([10, 20, 30]) / 255 - 0.5) / 0.5, atol=1e-6)
    a, b = images.ensemble_inputs(flat)
    assert a.shape == (3, 224, 224) and b.shape == (320, 320, 3) and np.allclose(b, np.array([10, 20, 30]) / 255, atol=1e-6)
    assert (images.pixels(flat.tobytes(), 91) == flat).all()


def test_repair_plan(spark):
    files = [("/a/x.jpg", 1, "p"), ("/a/x_po1.jpg", 1, "p"), ("/a/X_PO2.jpg", 2, "p"), ("/a/y_po1.jpg", 3, "q"), ("/a/y_po2.jpg", 3, "q"), ("/a/y_po3.jpg", 4, "q"), ("/a/po.jpg", 5, "r")]
    got = {r.path: r.action for r in planning.repair_plan(spark.createDataFrame(files, "path string, size int, hash string")).collect()}
    assert got == {"/a/x_po1.jpg": "delete", "/a/X_PO2.jpg": "skip", "/a/y_po1.jpg": "rename", "/a/y_po2.jpg": "delete", "/a/y_po3.jpg": "skip"}


def test_scan(spark, tmp_path):
    for p in ("_DSC1.JPG", "x/.a.jpg", "x/b.txt", ".git/c.jpg", "Windows/d.jpg", "x/y/e.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    names = sorted(r.name for r in media.scan(spark, str(tmp_path), str(tmp_path / "x"), "/missing").collect())
    assert names == [".a.jpg", "_DSC1.JPG", "e.mp4"]
    assert media.scan(spark, str(tmp_path), no_exclude=True).count() == 5
    for folders in (1, 2, 3, 1000):
        assert sorted(r.name for r in media.scan(spark, str(tmp_path), folders=folders).collect()) == names


def test_scan_store(spark, tmp_path):
    """A root with a scheme is listed by its own file system, and gives what the folder gives."""
    for p in ("_DSC1.JPG", "x/.a.jpg", "x/b.txt", ".git/c.jpg", "Windows/d.jpg", "x/y/e 1%.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    store = f"file://{tmp_path}"
    for more in ({}, {"every_file": True}, {"no_exclude": True}):
        want = sorted((r.path, r.dir, r.name, r.ext, r.size) for r in media.scan(spark, str(tmp_path), **more).collect())
        got = media.scan(spark, store + "/", f"{store}/x", f"{store}/missing", **more).collect()
        assert sorted((r.path.removeprefix("file://"), r.dir.removeprefix("file://"), r.name, r.ext, r.size) for r in got) == want
        assert media.scan(spark, store, str(tmp_path / "x"), **more).count() > len(got)
    assert all(abs(r.mtime.timestamp() - (tmp_path / "_DSC1.JPG").stat().st_mtime) < 60 for r in got)
    with pytest.raises(ValueError, match="facts"):
        media.scan(spark, store, facts=True)


def test_folder_scan_of_tables_in_parts(spark, tmp_path):
    """A table may be a folder of files, and in a store."""
    for k, t in enumerate(TABLES):
        table = tmp_path / f"{t}.parquet"
        if k % 3 == 0:
            table.write_bytes(b"PAR1")
            continue
        for part in ("part-0.parquet", "part-1.parquet", "_SUCCESS", "lang=en/part-2.snappy.parquet")[: k % 3 * 2]:
            (table / part).parent.mkdir(parents=True, exist_ok=True)
            (table / part).write_bytes(b"" if part == "_SUCCESS" else b"PAR1")
    (tmp_path / "old" / "region.parquet").mkdir(parents=True)
    (tmp_path / "old" / "region.parquet" / "nation.parquet").write_bytes(b"PAR1")
    want = sorted(duckdb.sql(harness.ORACLE_SQL["folder_scan"]).fetchall())
    for root in (str(tmp_path), f"{tmp_path}//", f"file://{tmp_path}", f"file://{tmp_path}/"):
        assert sorted(tuple(r) for r in harness.QUERIES["folder_scan"](spark, root).collect()) == want


def test_scan_facts(spark, tmp_path):
    """Hash and tags of a file are those of its bytes, though only parts of it are read."""
    user = box(b"udta", box(b"\xa9mak", struct.pack(">HH", 5, 0) + b"Maker"))
    mvhd = box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", 2082844800 + 1_700_000_000))
    movie = box(b"ftyp", b"qt  ") + box(b"mdat", bytes(range(256)) * 400) + box(b"moov", mvhd + user)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x010F, 2, 6, 40) + b"\0" * 4
    photo = b"\xff\xd8\xff\xe1\0\x50Exif\0\0" + tiff.ljust(40, b"\0") + b"Canon\0" + b"x" * 50_000
    for name, data in (("a.mp4", movie), ("b.jpg", photo), ("c.jpg", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.hash, r.tags) for r in media.scan(spark, str(tmp_path), facts=True).collect()}
    assert got["a.mp4"] == (containers.content_hash(movie), {"creation_time": "2023-11-14 22:13:20", "make": "Maker"})
    assert got["b.jpg"] == (containers.content_hash(photo), {"make": "Canon"}) and got["c.jpg"][1] == {}


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def test_containers():
    mvhd = box(b"mvhd", b"\0\0\0\0" + struct.pack(">I", 2082844800 + 1_700_000_000))
    data = box(b"ftyp", b"x") + box(b"moov", mvhd + box(b"udta", box(b"\xa9mak", struct.pack(">HH", 3, 0) + b"DJI")))
    for body, want in ((struct.pack(">HH", 5, 0) + b"abcde", "abcde"), (struct.pack(">HH", 9, 0) + b"abcdefg", "abcde"), (struct.pack(">HHI", 0, 0, 0) + b"later", "later"), (b"ab", ""), (b"", "")):
        assert containers.parse_boxes(box(b"udta", box(b"\xa9mod", body))) == ({"model": want} if want else {})
    assert containers.parse_boxes(data) == {"creation_time": "2023-11-14 22:13:20", "make": "DJI"}
    assert containers.parse_boxes(data + b"\0\0\0\3abcd") == containers.parse_boxes(data)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 6, 40) + struct.pack("<HHII", 0x8827, 3, 1, 200) + b"\0\0\0\0"
    assert containers.parse_exif(tiff.ljust(40, b"\0") + b"Canon\0") == {"make": "Canon", "iso": "200"}
    assert containers.parse_exif(b"no") == {}
    v = np.array([1.5, -2], np.float32)
    assert (containers.text_vector(containers.vector_text(v)) == v).all()


@pytest.mark.parametrize("stored", ["file", "idat"])
def test_heif(stored):
    tiff = (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x010F, 2, 6, 40)).ljust(40, b"\0") + b"Canon\0"
    item = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    infe = b"".join(box(b"infe", b"\2\0\0\0" + struct.pack(">HH", k, 0) + kind + b"\0") for k, kind in ((1, b"hvc1"), (2, b"Exif")))

    def file(at):
        locations = b"".join(struct.pack(">HHHHII", k, stored == "idat", 0, 1, at, n) for k, n in ((1, 3), (2, len(item))))
        inner = box(b"iinf", b"\0\0\0\0\0\2" + infe) + box(b"iloc", b"\1\0\0\0\x44\0\0\2" + locations)
        return box(b"ftyp", b"heic") + box(b"meta", b"\0\0\0\0" + inner + (box(b"idat", item) if stored == "idat" else b""))

    data = file(0 if stored == "idat" else len(file(0)) + 8)
    data += box(b"mdat", item) if stored == "file" else b""
    assert containers.parse_exif(data) == {"make": "Canon"}
    for cut in range(len(data)):
        containers.parse_exif(data[:cut])  # a broken file gives what it can
    assert containers.parse_exif(box(b"ftyp", b"heic")) == {}


def test_filelists(spark, tmp_path):
    row = lambda *cells: " | ".join([*cells[:1], *["x"] * 6, *cells[1:]])
    texts = {"_a/filelist.txt": ["# comment", "", "Filename | x", "-----", row(" a.jpg", "/s/a.jpg  "), "b.jpg | short", row("c.jpg", "/keep/c.jpg")], "b/.c/filelist.txt": [row("d.jpg", "/s/d.jpg")], "b/other.txt": [row("e", "/s/e")]}
    for p, lines in texts.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("\n".join(lines))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "filelist.txt").write_bytes(b"\xff\xfe | x")
    found = filelists.collect_pairs(spark, str(tmp_path), "/missing", protected=F.col("source").startswith("/keep"))
    assert sorted(map(tuple, found.collect())) == [(f"{tmp_path}/_a/a.jpg", "/s/a.jpg"), (f"{tmp_path}/b/.c/d.jpg", "/s/d.jpg")]


def test_notes(spark):
    when = D(2024, 1, 1)
    rows = [
        ("folder vote", "photo", "Canon", "camera", True, when, when, "folder vote"), ("", "video", "", "unknown", False, None, when, "无法识别视频设备信息"),
        ("", "photo", None, "unknown", True, when, when, "无EXIF设备信息"), ("", "photo", "Acme", "unknown", False, None, None, ""),
        ("", "photo", "Canon", "camera", False, None, when, "无EXIF日期，使用文件修改时间"), ("", "photo", "Canon", "camera", False, None, None, "无任何日期信息"),
        ("", "photo", "Canon", "camera", False, when, None, ""), (None, "video", "DJI", "camera", True, when, None, ""),
    ]
    df = spark.createDataFrame(rows, "s string, media string, make string, device string, has boolean, taken timestamp, mtime timestamp, want string")
    got = df.select("want", S.note(*[F.col(c) for c in df.columns[:-1]]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_clusters(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(8)[:3]
    x = np.concatenate([c + rng.normal(0, 0.02, (12, 8)) for c in centres] + [rng.normal(0, 1, (3, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = people.hdbscan(x, 4)
    assert [set(labels[k * 12 : k * 12 + 12]) for k in range(3)] == [{0}, {1}, {2}]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    assert people.cluster_people(df, min_size=4).filter("person is not null").select("person").distinct().count() == 3


def test_clusters_in_blocks(spark):
    """Dealt to blocks, the same clusters come out."""
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(0, 0.05, (30, 6)) for c in np.eye(6)[:4]] + [rng.normal(0, 1, (20, 6))])
    df = spark.createDataFrame([(int(i) * 3, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    want = {r.id: r.person for r in people.cluster_people(df, min_size=5).collect()}
    assert len(set(want.values())) >= 4
    for block in (23, 70):
        assert {r.id: r.person for r in people.cluster_people(df, min_size=5, block=block).collect()} == want
    assert people.cluster_people(df.limit(0)).count() == 0 and people.cluster_people(df.limit(1)).first().person is None


def plain_clusters(x, min_size):
    """Density clusters straight from their definition, one threshold after the other."""
    gaps = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(gaps, axis=1)[:, min_size - 1]
    reach = np.maximum(gaps, np.maximum(core[:, None], core))

    def parts(members, below):
        left, found = set(members), []
        while left:
            stack = [left.pop()]
            found.append(set(stack))
            while stack:
                near = {k for k in left if reach[stack[-1], k] < below}
                stack.pop()
                stack += near
                found[-1] |= near
                left -= near
        return found

    def walk(members, birth):  # the mass chosen, and the clusters
        whole, mass = members, 0.0
        while True:
            ids = sorted(members)
            steps = np.unique(reach[np.ix_(ids, ids)][np.triu_indices(len(ids), 1)])
            d = steps[bisect.bisect_left(steps, True, key=lambda s: len(parts(ids, s)) == 1) - 1]  # noqa: B023
            level = min(1 / d if d > 0 else np.inf, 1e12)
            large = [p for p in parts(ids, d) if len(p) >= min_size]
            mass += (len(ids) - (len(large[0]) if len(large) == 1 else 0)) * (level - birth)
            if len(large) != 1:
                break
            members = large[0]
        below = [walk(p, level) for p in large]
        total = sum(m for m, _ in below)
        if below and (total > mass or whole == set(range(len(x)))):
            return total, [c for _, found in below for c in found]
        return mass, [whole]

    _, found = walk(set(range(len(x))), 0.0)
    return {frozenset(c) for c in found if len(c) < len(x)}


def test_clusters_with_ties(spark):
    """Mutual reachability is full of ties: neither the order of ids nor the blocks decide."""
    rng = np.random.default_rng(8)
    x = people._unit(pd.Series(list(np.concatenate([c + rng.normal(0, 0.3, (14, 5)) for c in np.eye(5)[:3]]))))
    x = np.concatenate([x, x[:3], x[:1], x[20:22], x[20:22], x[20:22] + 1e-9])
    for size in (3, 4):
        want = plain_clusters(x, size)
        for order in (np.arange(len(x)), rng.permutation(len(x))):
            labels = people.hdbscan(x[order], size)
            assert {frozenset(order[labels == k].tolist()) for k in set(labels) - {-1}} == want
            df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[order])], "id long, embedding array<double>")
            for block in (1000, 17, 30):
                got = people.cluster_people(df, min_size=size, block=block).groupBy("person").agg(F.collect_set("id").alias("ids")).filter("person is not null").collect()
                assert {frozenset(order[r.ids].tolist()) for r in got} == want
    x = np.concatenate([x, x[:1] * np.nan])
    labels = people.hdbscan(x, 4)
    assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels) - {-1}} == want


def test_clusters_take_few_distances_one_by_one(monkeypatch):
    """Products of matrices do the bulk; differences are taken for what is chosen, or very close."""
    x = people._unit(pd.Series(list(np.random.default_rng(4).normal(0, 1, (900, 16)))))
    monkeypatch.setattr(people, "PIECE", 250, raising=False)
    taken, plain = [], people._distances
    monkeypatch.setattr(people, "_distances", lambda a, b: taken.append(max(len(a), len(b))) or plain(a, b))
    people.hdbscan(x, 4)
    assert sum(taken) < len(x) ** 2 / 10


def test_face_pipeline(spark):
    """Only files without a cached record are looked at; the clustering is taken again as long as
    the files are the same; links of one name get numbers."""
    a, b = ([1.0, 0.0, 0.02], [0.0, 1.0, 0.02])

    def face(v, score=0.9, side=50):
        return {"bbox": [0, 0, side, side], "embedding": containers.vector_text(np.array(v)), "score": score}

    seen = {"/o/x/1.jpg": [face(a)], "/o/y/1.jpg": [face(a), face(a)], "/o/x/2.jpg": [face(b)], "/o/x/3.jpg": [face(b), face(a, 0.2), face(a, side=20)], "/o/x/4.jpg": []}
    rows = [(k, p, f"h{k}", "ok") for k, p in enumerate(seen)] + [(9, "/o/x/v.mp4", "h9", "ok"), (10, "/o/x/5.jpg", "h10", "error"), (11, "/o/nsfw/6.jpg", "h11", "ok")]
    recs = spark.createDataFrame(rows, "ord int, destination string, file_hash string, status string")
    cached = spark.createDataFrame([("h4", [], True), ("gone", [], True)], people.FACES)
    extract = lambda: lambda path: seen[path]
    only = people.face_pipeline(recs, extract, cached, "/all", "/O/nsfw", cache_only=True)
    assert list(only) == ["faces"] and {r.hash: r.no_face for r in only["faces"].collect()} == {"h0": False, "h1": False, "h2": False, "h3": False, "h4": True}
    run = people.face_pipeline(recs, extract, cached, "/all", "/O/nsfw")
    found = collections.defaultdict(set)
    for r in run["members"].collect():
        found[r.person].add(r.hash)
    assert sorted(map(sorted, found.values())) == [["h0", "h1"], ["h2", "h3"]]
    links = sorted((r.person, r.path, r.link) for r in run["album"].collect())
    assert [x[1] for x in links if x[1].endswith("1.jpg")] == ["/o/x/1.jpg", "/o/y/1.jpg"] and [x[2].rpartition("/")[2] for x in links if x[1].endswith("1.jpg")] == ["1.jpg", "1_f1.jpg"]
    assert run["outliers"].count() == 0
    again, now = people.members(people.good_faces(run["faces"]), 2, cached, run["print"])
    assert again is cached and now == run["print"]
    assert people.members(people.good_faces(run["faces"]), 3, cached, run["print"])[0] is not cached


def test_cascade(spark):
    df = spark.createDataFrame([(k / 10,) for k in range(10)], "x double")
    out = {r.x: r.score for r in people.cascade(df, "x", lambda: lambda s: s, lambda: lambda s: s * 0 + 7).collect()}
    assert out[0.2] == 0 and out[0.3] == 7 and len(out) == 10


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' t, 'a' h, 5L size union all select timestamp'2024-01-01 00:20:00', 'a', 7L").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("t timestamp, h string, size long").parquet(str(tmp_path / "in"))
    for name, df, mode, want in (("one", ingest.first_copies(src, "t", "h"), "append", 1), ("two", ingest.arrivals(src, "t"), "complete", 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == want


def test_device_suffix(spark):
    rows = [("Mi 14", "/a/x/f", "Mi 14 (wz)"), ("Mi 14", "/a/xy/f", "Mi 14"), ("Mi 14", "/o/All_2_p/mi 14 (b)/f", "mi 14 (b)"), ("Mi 14", "/o/All_2_p/mi 14 (b)", "Mi 14"), ("Mi 14", "/o/All_9_p/mi 14 (b)/f", "Mi 14"), ("Mi 14", "/o/all_1_p/mi 15 (b)/f", "Mi 14"), ("Mi 14", None, "Mi 14")]
    df = spark.createDataFrame(rows, "label string, path string, want string")
    got = df.select("want", S.device_suffix(F.col("label"), F.col("path"), {"/a/x": "wz"}, "/o").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
