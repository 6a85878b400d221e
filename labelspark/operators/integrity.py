"""Referential checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def missing_references(rows: DataFrame, keys: list[str], target: DataFrame,
                       target_keys: list[str] | None = None) -> DataFrame:
    """Rows whose key has no counterpart in ``target`` (left anti)."""
    known = target.select(
        *[target[t].alias(k) for k, t in zip(keys, target_keys or keys)]
    ).distinct()
    return rows.join(known, keys, "left_anti")
