"""Review text files: ``<root>/[<city>/]<hotel>.<ext>``, tab-separated lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.functions.clean import title_case
from reviewlytics.sources.hidden_files import hidden_lines

# Archive suffixes that are no review files; line breaks beyond the newline a
# text source splits at; white space that is trimmed from a field.
SKIPPED_SUFFIX = r"(?i)\.(rar|zip|gz)$"
LINE_BREAK = r"[\r\n\x0b\x0c\x1c\x1d\x1e\x85  ]"
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _decoded_path() -> Column:
    """The path of a row's file; it arrives percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


# What writers leave beside the data; no review files.
_MARKS = re.compile(r"_SUCCESS|_temporary|_committed_.*|_started_.*|\..*\.crc")


def _file_system(spark: SparkSession, root: str):
    """The root as a qualified path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def _hidden(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """URI, path below the root and bytes of what ``hidden_files`` names."""
    fs, top = _file_system(spark, root)
    found, folders = [], []
    for status in fs.listStatus(top):
        (folders if status.isDirectory() else found).append(status)
    for folder in folders:
        if not _MARKS.fullmatch(folder.getPath().getName()):
            found += [s for s in fs.listStatus(folder.getPath()) if not s.isDirectory()]
    inside = len(top.toUri().getPath().rstrip("/")) + 1
    listed = []
    for status in found:
        path = status.getPath()
        below = path.toUri().getPath()[inside:]
        hidden = any(part[0] in "_." for part in below.split("/"))
        if hidden and not _MARKS.fullmatch(path.getName()):
            listed.append((path.toUri().toASCIIString(), below, status.getLen()))
    return sorted(listed, key=lambda f: f[1])


def hidden_files(spark: SparkSession, root: str) -> list[str]:
    """Files of the layout whose names begin with ``_`` or ``.``: text sources do not list them."""
    return [below for _, below, _ in _hidden(spark, root)]


def _below_root(path: Column, root: str) -> Column:
    """``root``: the path part of the qualified root. Cut off by its length, whatever its text."""
    plain = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substr(plain, F.lit(len(root.rstrip("/")) + 2))


def review_lines(
    spark: SparkSession, root: str, skip_hidden: bool = False, read_hidden: bool = False
) -> DataFrame:
    """(file, value): every line of the files in ``root`` and one directory level below it.

    A large file is split over tasks like any text source. ``file`` is the path below the root.
    Files that Spark cannot list (see ``hidden_files``) stop the read with their names, unless
    ``skip_hidden`` says that they may be left out or ``read_hidden`` that tasks open them
    themselves (see ``sources.hidden_files``).
    """
    _, top = _file_system(spark, root)
    hidden = [] if skip_hidden or read_hidden else hidden_files(spark, root)
    if hidden:
        raise ValueError(f"{len(hidden)} files cannot be listed, rename them: {', '.join(hidden[:20])}")
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    located = lines.select(_below_root(_decoded_path(), top.toUri().getPath()).alias("file"), "value")
    if read_hidden:
        located = located.unionByName(hidden_lines(spark, _hidden(spark, root)))
    depth = F.size(F.split("file", "/"))
    return located.filter((depth <= 2) & ~F.col("file").rlike(SKIPPED_SUFFIX))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def parse_reviews(lines: DataFrame, keep: list[str] = ["file"]) -> DataFrame:
    """``keep`` + date, subject, review from tab-separated lines.

    Lines with fewer than three fields, or without subject and review, are no reviews; fields
    after the third are ignored.
    """
    part = F.split("line", "\t")
    fields = [strip(F.get(part, F.lit(i))).alias(n) for i, n in enumerate(("date", "subject", "review"))]
    return (
        lines.select(*keep, F.explode(F.split("value", LINE_BREAK)).alias("line"))
        .filter((F.size(part) >= 3) & (strip(F.col("line")) != ""))
        .select(*keep, *fields)
        .filter("subject <> '' OR review <> ''")
    )


def _clean_name(name: Column) -> Column:
    return title_case(F.translate(name, "_-", "  "))


def file_to_hotel(file: Column) -> Column:
    """Hotel name from the file's stem."""
    name = F.substring_index(file, "/", -1)
    return _clean_name(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def file_to_city(file: Column) -> Column:
    """City from the directory below the root; empty at root level."""
    return F.when(F.contains(file, F.lit("/")), _clean_name(F.substring_index(file, "/", 1))).otherwise("")


def read_reviews(
    spark: SparkSession, root: str, skip_hidden: bool = False, read_hidden: bool = False
) -> DataFrame:
    """(file, hotel, city, date, subject, review) of all review files under ``root``."""
    parsed = parse_reviews(review_lines(spark, root, skip_hidden, read_hidden))
    return parsed.select(
        "file", file_to_hotel(F.col("file")).alias("hotel"),
        file_to_city(F.col("file")).alias("city"), "date", "subject", "review",
    )
