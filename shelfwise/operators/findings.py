"""The one row shape that all detectors emit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities and their order.
CRITICAL, MIDDLE, INFO = "krytyczna", "srednia", "info"
COLUMNS = ("id", "attr", "rule_id", "layer", "severity", "confidence", "old_value", "new_value", "evidence", "grp")
GAP_RULES = "L2-LUKA-%"


def _text(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def emit(rows: DataFrame, rule: Column | str, layer: str, severity: Column | str, confidence: Column | float, *, attr: Column | str = "attr", old: Column | str | None = None, new: Column | None = None, evidence: Column | str = "", group: Column | None = None) -> DataFrame:
    """One finding for each row. The group is rule|attr|old unless given."""
    rule, attr = _text(rule), F.col(attr) if isinstance(attr, str) else attr
    old = (F.col(old) if isinstance(old, str) else _text(old)).cast("string")
    default = F.concat_ws("|", rule, attr, F.coalesce(old, F.lit("")))
    return rows.select("id", attr.alias("attr"), rule.alias("rule_id"), F.lit(layer).alias("layer"), _text(severity).alias("severity"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), old.alias("old_value"), _text(new).cast("string").alias("new_value"), _text(evidence).alias("evidence"), (default if group is None else group).alias("grp"))


def severity_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == CRITICAL, 0).when(c == MIDDLE, 1).otherwise(2)


def union(streams: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, streams)


def without(found: DataFrame, rules: DataFrame | None = None, attrs: DataFrame | None = None) -> DataFrame:
    """Findings of rules (rule_id) and attributes (attr) that are not switched off."""
    if rules is not None:
        found = found.join(F.broadcast(rules.select("rule_id").distinct()), "rule_id", "left_anti")
    if attrs is not None:
        found = found.join(F.broadcast(attrs.select("attr").distinct()), "attr", "left_anti")
    return found.select(*COLUMNS)
