"""The file lists that stand in the folders of an organised tree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media

NAME = "filelist.txt"
FIELDS = 8
LINES_AT_ONCE = 10_000


def pair(line: Column) -> Column:
    """(name, source) of a line, its first and last field; null for comments, rules,
    headers and lines with too few fields."""
    line = F.trim(line)
    parts = F.transform(F.split(line, r" \| "), F.trim)
    own = ~line.rlike(r"^(?:$|#|-|Filename)") & (F.size(parts) >= FIELDS)
    return F.when(own, F.struct(F.get(parts, F.lit(0)).alias("name"), F.element_at(parts, -1).alias("source")))


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for folder, path in zip(batch["dir"], batch["path"], strict=True):
            held: list[str] = []
            try:
                with open(path, encoding="utf-8") as f:
                    for line in f:
                        held.append(line.strip())
                        if len(held) >= LINES_AT_ONCE:
                            yield pd.DataFrame({"dir": folder, "line": held})
                            held = []
            except (OSError, UnicodeDecodeError):
                pass  # gone or unreadable; what was read so far counts
            if held:
                yield pd.DataFrame({"dir": folder, "line": held})


def collect_pairs(spark: SparkSession, *roots: str, protected: Column | None = None) -> DataFrame:
    """(dest, source) of every list under the roots, missing roots none.  protected is a
    condition on source; such rows, and those without a source, are left out.  The folders are
    walked like those of media.scan, since Spark's own index skips names with _ in front."""
    lists = media.scan(spark, *roots, no_exclude=True, every_file=True).filter(F.col("name") == NAME)
    found = lists.select("dir", "path").mapInPandas(_lines, "dir string, line string").select("dir", pair(F.col("line")).alias("p"))
    found = found.filter("p.source <> ''").select(F.concat_ws("/", "dir", "p.name").alias("dest"), "p.source")
    return found if protected is None else found.filter(~protected)
