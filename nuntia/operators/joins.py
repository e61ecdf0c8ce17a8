"""Joins of findings with what is known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_verdicts(candidates: DataFrame, verdicts: DataFrame, keys: list[str], verdict: str = "is_tech_job", default: bool = True) -> DataFrame:
    """Candidates with their verdict, the default where there is none."""
    return candidates.join(verdicts.select(*keys, verdict), keys, "left").withColumn(verdict, F.coalesce(F.col(verdict), F.lit(default)))


def kept_by(findings: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose key is among the kept ones."""
    return findings.join(kept.select(*keys), keys, "left_semi")


def not_seen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key hasn't been seen."""
    return rows.join(seen.select(*keys), keys, "left_anti")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, duplicates kept."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
