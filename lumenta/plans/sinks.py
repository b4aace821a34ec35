"""Sinks for reports: tables of lines as text files, and the index of people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (folder, part, key, line) as text under folder=..., in order.  Ranges of the order
    go to tasks of their own, so a folder of any number of lines is written by many; its part files read in
    the order of their names are the report."""
    dealt = lines.repartitionByRange("folder", "part", "key").sortWithinPartitions("folder", "part", "key")
    dealt.select("folder", "line").write.partitionBy("folder").text(path)


def write_page(lines: DataFrame, path: str) -> None:
    """A report of one folder as text, without a folder level."""
    lines.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("line").write.text(path)


def people_index(members: DataFrame) -> DataFrame:
    """One JSON value a person, from (person, path), for people whose files fit into one;
    reports.people_lines has no such bound."""
    people = members.filter("person is not null").groupBy("person").agg(F.count(F.lit(1)).alias("face_count"), F.array_sort(F.collect_set("path")).alias("files"))
    return people.select(F.to_json(F.struct("person", "face_count", F.size("files").alias("photo_count"), "files")).alias("value"))
