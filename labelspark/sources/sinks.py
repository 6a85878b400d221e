"""Writers: results CSV, audit CSV, transcript documents.

Each is one Spark write, committed as a whole. Rows are rebalanced first, so the number of files follows
the bytes and not the tasks that made them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelspark.operators import audit, batch, transcripts


def write_results_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    batch.results_export(rows).hint("rebalance").write.mode(mode).option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def write_audit_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export in id order; the range sort keeps the write parallel."""
    ordered = rows.orderBy("id")
    audit.export_frame(ordered).write.mode(mode).option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def write_transcripts(cases: DataFrame, steps: DataFrame, path: str,
                      mode: str = "errorifexists") -> None:
    """One JSON document a line, read back by :func:`transcripts.read_transcript_lines`."""
    documents = transcripts.transcript_documents(cases, steps)
    documents.select("document").hint("rebalance").write.mode(mode).text(path)
