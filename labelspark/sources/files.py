"""Scans of claims files, label files, archives and sidecar notes."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import text as T
from labelspark.sources import records


class ClaimsFormatError(ValueError):
    """The claims file lacks a required column or a header."""


def read_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """Claims CSV: header matched by trimmed lower-case name, cells trimmed, BOM dropped.

    ``path`` may be a folder whose files order their columns differently: each is read by its own
    header. Quoted cells may hold line breaks, and a large file is read by many tasks all the same
    (see :mod:`records`). Rows without a filename are dropped, filenames lower-cased, absent optional
    columns are empty. ``row_number`` rises with the place of a row in its file. Only the distinct
    headers are seen on the driver.
    """
    found, heads = records.read_records(spark, path)
    shapes = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    if not shapes:
        raise ClaimsFormatError("The CSV file appears to be empty.")
    known = found.join(heads, "file")
    return reduce(DataFrame.unionByName, [normalize_claims(_cells(known.where(F.col("head") == head), head)) for head in shapes])


def _cells(rows: DataFrame, head: str) -> DataFrame:
    """Records of files with one header as its columns, and their row_number."""
    if head.count('"') % 2:
        raise ClaimsFormatError("The header row of a CSV file can't hold line breaks.")
    names = next(csv.reader([head]))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select("row_number", F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"'}).alias("cells"))
    return parsed.select(*[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)], "row_number")


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an exported table as text, in files of one header; blank cells are empty, not null."""
    found, heads = records.read_records(spark, path)
    shapes = [r["head"] for r in heads.select("head").distinct().limit(2).collect()]
    if len(shapes) != 1:
        raise ClaimsFormatError("An exported table has files of one header.")
    cells = _cells(found, shapes[0]).drop("row_number")
    return cells.select(*[F.coalesce(c, F.lit("")).alias(c) for c in cells.columns])


def normalize_claims(raw: DataFrame) -> DataFrame:
    """Cells of the claims columns by trimmed lower-case name, and ``row_number`` (the last column)."""
    names: dict[str, str] = {}
    for column in raw.columns[:-1]:
        names[column.replace("﻿", "").strip().lower()] = column
    missing = sorted(set(V.REQUIRED_CLAIM_COLUMNS) - set(names))
    if missing:
        raise ClaimsFormatError(
            "CSV is missing column(s): " + ", ".join(missing)
            + ". Expected a header row: filename, brand, alcohol_content."
        )

    def cell(name: str) -> Column:
        if name not in names:
            return F.lit("")
        quoted = names[name].replace("`", "``")
        return T.strip(F.coalesce(F.col(f"`{quoted}`"), F.lit("")))

    wanted = V.REQUIRED_CLAIM_COLUMNS + V.OPTIONAL_CLAIM_COLUMNS
    rows = raw.select(*[cell(name).alias(name) for name in wanted], "row_number")
    return rows.withColumn("filename", F.lower("filename")).filter("filename <> ''")


def basename(path: Column) -> Column:
    """Last path part; back-slashes count as separators."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def has_extension(name: Column, extensions: list[str]) -> Column:
    low = F.lower(name)
    match = F.lit(False)
    for extension in extensions:
        match = match | low.endswith(extension)
    return match


def is_image_member(member: Column) -> Column:
    """A real image entry: no folder, no resource fork, no dot-file."""
    base = basename(member)
    return (
        ~member.endswith("/")
        & ~member.startswith("__MACOSX/")
        & (base != "")
        & ~base.startswith(".")
        & has_extension(base, V.IMAGE_EXTENSIONS)
    )


def scan_label_files(
    spark: SparkSession, path: str, extensions: list[str] | None = None, content: bool = False
) -> DataFrame:
    """Recursive listing of label files: path, filename, length (content only on request)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = has_extension(basename(F.col("path")), extensions or V.IMAGE_EXTENSIONS)
    columns = ["path", basename(F.col("path")).alias("filename"), "length"]
    return files.filter(keep).select(*columns, *(["content"] if content else []))


MEMBER_SCHEMA = "archive string, member string, size long, valid boolean"
CONTENT_SCHEMA = "archive string, member string, filename string, size long, content binary"


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Central-directory rows of each archive; one row with a null member if unreadable."""
    for batch in batches:
        rows = []
        for archive, content in zip(batch.column("archive"), batch.column("content")):
            name = archive.as_py()
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as zf:
                    found = [(name, i.filename, i.file_size, True) for i in zf.infolist()]
                rows += found or [(name, None, 0, True)]
            except zipfile.BadZipFile:
                rows.append((name, None, 0, False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(
                zip(*rows) if rows else [[]] * 4,
                [pa.string(), pa.string(), pa.int64(), pa.bool_()],
            )],
            ["archive", "member", "size", "valid"],
        )


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("archive"), batch.column("content")):
            name = archive.as_py()
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as zf:
                for info in zf.infolist():
                    if info.is_dir():
                        continue
                    data = zf.read(info)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([info.filename]), pa.array([""]),
                         pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())],
                        ["archive", "member", "filename", "size", "content"],
                    )


def archive_members(archives: DataFrame) -> DataFrame:
    """Member listing of (archive, content) rows; reads directories only, no member bytes."""
    return archives.select("archive", "content").mapInArrow(_list_members, MEMBER_SCHEMA)


def archive_guards(
    members: DataFrame,
    max_files: int | None = None,
    max_member_bytes: int | None = None,
    max_total_bytes: int | None = None,
) -> DataFrame:
    """Per archive: image count, largest and total declared size, and a reject reason or ''.

    Limits are off unless given (:mod:`fixed_values` has those of interactive uploads).
    """
    image = F.coalesce(is_image_member(F.col("member")), F.lit(False))
    size = F.when(image, F.col("size")).otherwise(F.lit(0))
    stats = members.groupBy("archive").agg(
        F.bool_and("valid").alias("valid"),
        F.count_if(image).alias("images"),
        F.max(size).alias("largest"),
        F.sum(size).alias("total"),
    )
    def beyond(column: str, limit: int | None) -> Column:
        return F.lit(False) if limit is None else F.col(column) > limit

    return stats.withColumn(
        "reject_reason",
        F.when(~F.col("valid"), "That doesn't look like a valid .zip file.")
        .when(F.col("images") == 0, "No image files were found in the zip.")
        .when(
            beyond("images", max_files),
            F.concat(
                F.lit("The zip has "), F.col("images").cast("string"),
                F.lit(f" images — the batch limit is {max_files}. "
                      "Please split it into smaller zips."),
            ),
        )
        .when(
            beyond("largest", max_member_bytes),
            "A file in the zip is too large — 10 MB max per image.",
        )
        .when(
            beyond("total", max_total_bytes),
            "The zip's contents are too large to process (over the size limit).",
        )
        .otherwise(""),
    )


def extract_images(archives: DataFrame, guards: DataFrame) -> DataFrame:
    """Image bytes of the archives that passed the guards."""
    good = archives.join(
        guards.filter("reject_reason = ''").select("archive"), "archive", "left_semi"
    )
    rows = good.select("archive", "content").mapInArrow(_read_members, CONTENT_SCHEMA)
    return rows.filter(is_image_member(F.col("member"))).withColumn(
        "filename", basename(F.col("member"))
    )


def parse_sidecars(notes: DataFrame) -> DataFrame:
    """(stem, value) whole-file notes -> brand, alcohol_content and the three true verdicts.

    First line that is neither blank nor a comment: ``brand|abv[|brand,abv,warning]``.
    """
    lines = F.filter(
        F.split("value", T.LINE_BREAK),
        lambda x: (T.strip(x) != "") & ~F.ltrim(x).startswith("#"),
    )
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    parts = F.transform(F.split(line, r"\|"), T.strip)

    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    def verdict(i: int) -> Column:
        token = F.lower(T.strip(F.coalesce(F.get(F.split(part(2), ","), F.lit(i)), F.lit(""))))
        return (
            F.when(token.isin(V.YES_TOKENS), True).when(token.isin(V.NO_TOKENS), False)
            .otherwise(True)
        )

    return notes.select(
        "stem",
        part(0).alias("brand"),
        F.when(part(1) == "", "5.0").otherwise(part(1)).alias("alcohol_content"),
        verdict(0).alias("exp_brand"),
        verdict(1).alias("exp_alcohol"),
        verdict(2).alias("exp_warning"),
    )


def eval_cases(images: DataFrame, sidecars: DataFrame, kind: str) -> DataFrame:
    """Every listed image as a case, with its optional note (left join on the stem)."""
    listed = images.filter(
        has_extension(F.col("filename"), V.CASE_IMAGE_EXTENSIONS)
    ).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    joined = listed.join(parse_sidecars(sidecars), "stem", "left")
    return joined.select(
        F.col("stem").alias("name"),
        F.col("filename").alias("image"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("alcohol_content", F.lit("5.0")).alias("alcohol_content"),
        F.lit(kind).alias("kind"),
        *[F.coalesce(c, F.lit(True)).alias(c)
          for c in ("exp_brand", "exp_alcohol", "exp_warning")],
    )


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file text notes keyed by file stem."""
    files = spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.txt"
    ).text(path, wholetext=True)
    name = basename(F.col("_metadata.file_path"))
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "value")
