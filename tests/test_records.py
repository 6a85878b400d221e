"""Claims files cut into many splits against Python's csv module."""

import csv
import io
import random

import pytest

from labelspark.sources import files


def written(rows, head, breaks="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=breaks).writerows([head, *rows])
    return out.getvalue()


def claims(seed, n):
    rng = random.Random(seed)
    cells = ["plain", "", 'said "no"', "two\nlines", "\n\n", 'a,"b",c', '"', "x" * 40, " padded ", '""\n""']
    return [[f"File_{i}.png", rng.choice(cells), rng.choice(cells), rng.choice(cells)] for i in range(n)]


@pytest.mark.parametrize("size", [23, 64, 1_000, 10_000_000])
def test_records_of_a_file_cut_anywhere(spark, tmp_path, size):
    head = ["filename", "brand", "alcohol_content", "net_contents"]
    rows = claims(size, 120)
    (tmp_path / "claims.csv").write_text(written(rows, head))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = files.read_claims_csv(spark, str(tmp_path / "claims.csv")).orderBy("row_number").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.filename, r.brand, r.alcohol_content, r.net_contents) for r in found] == [
        (f.lower(), *(c.strip() for c in cells)) for f, *cells in rows]
    assert len({r.row_number for r in found}) == len(rows)


def test_headers_differ_and_files_may_be_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ FileName ,Brand,\"ALCOHOL_CONTENT\"\r\nA.png,x,5%\r\n\r\n\r\nB.png,\"y\r\nz\",\r\n")
    (tmp_path / "b.csv").write_text("\n\nbrand,alcohol_content,filename,other\nq,7,C.png,1\n,,,\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("filename,brand,alcohol_content\n")
    found = {r.filename: (r.brand, r.alcohol_content, r.net_contents) for r in files.read_claims_csv(spark, str(tmp_path)).collect()}
    assert found == {"a.png": ("x", "5%", ""), "b.png": ("y\nz", "", ""), "c.png": ("q", "7", "")}
    with pytest.raises(files.ClaimsFormatError):
        files.read_claims_csv(spark, str(tmp_path / "c.csv"))
