"""Progress, producers, rules, missing data and filter coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.decisions import APPLIED, FALSE_ALARM, POSTPONED, current

LEAST_DECIDED = 5


def daily(log: DataFrame, made: DataFrame, requests: DataFrame, states: DataFrame, days: int) -> DataFrame:
    """The newest days of four streams: decisions, batches, requests, verifications (with checked)."""
    s = F.col("status")
    day = lambda c: F.to_date(c).alias("day")
    parts = [
        current(log).groupBy(day("ts")).agg(F.count_if(s == APPLIED).alias("applied"), F.count_if(s == FALSE_ALARM).alias("false_alarms"), F.count_if(s == POSTPONED).alias("postponed")),
        made.groupBy(day("created")).agg(F.count("*").alias("batches")),
        requests.groupBy(day("created")).agg(F.count("*").alias("requests")),
        states.groupBy(day("checked")).agg(F.count_if(F.col("state") == "weszlo").alias("won"), F.count("*").alias("verified")),
    ]
    out = reduce(lambda a, b: a.join(b, "day", "full"), parts).where("day is not null").na.fill(0)
    return out.withColumn("effectiveness", F.round(100 * F.col("won") / F.nullif("verified", F.lit(0)), 1)).orderBy(F.desc("day")).limit(days)


def overall(findings: DataFrame, log: DataFrame, states: DataFrame) -> DataFrame:
    f = findings.agg(F.count("*").alias("findings"), F.countDistinct("id").alias("products"))
    d = current(log).agg(F.count("*").alias("decided"), F.count_if(F.col("status") == APPLIED).alias("applied"), F.count_if(F.col("batch_id").isNotNull()).alias("exported"))
    v = states.agg(F.count_if(F.col("state") == "weszlo").alias("won"), F.count("*").alias("verified"))
    rows = f.unionByName(d, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def producers(products: DataFrame, findings: DataFrame, log: DataFrame) -> DataFrame:
    """Metrics of each producer. precision: errors among judged; coverage: decided among findings."""
    owner = products.select("id", "producer")
    p = products.groupBy("producer").agg(F.countDistinct("id").alias("products"))
    f = findings.join(owner, "id").groupBy("producer").agg(F.count("*").alias("findings"))
    s = F.col("status")
    d = current(log).join(owner, "id").groupBy("producer").agg(F.count("*").alias("decided"), F.count_if(s == APPLIED).alias("errors"), F.count_if(s == FALSE_ALARM).alias("false_alarms"))
    out = p.join(f, "producer", "left").join(d, "producer", "left").na.fill(0, ["findings", "decided", "errors", "false_alarms"])
    ratio = lambda a, b, n=3: F.round(a / F.nullif(b, F.lit(0)), n)
    return out.select("*", ratio(F.col("errors"), F.col("errors") + F.col("false_alarms")).alias("precision"), ratio(F.col("decided"), F.col("findings")).alias("coverage"), ratio(F.col("errors"), F.col("products")).alias("errors_per_product"), ratio(F.col("findings"), F.col("products")).alias("findings_per_product"))


def half_of_errors(metrics: DataFrame) -> DataFrame:
    """How many producers make half of the confirmed errors; the window runs over a row for each producer."""
    order = Window.orderBy(F.desc("errors"), "producer")
    before = F.coalesce(F.sum("errors").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("errors").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return metrics.where("errors > 0").select(before.alias("before"), total.alias("total")).agg(F.count_if(F.col("before") * 2 < F.col("total")).alias("producers"), F.max("total").alias("errors"))


def by_producer(findings: DataFrame, products: DataFrame, log: DataFrame, column: str) -> DataFrame:
    """Findings, errors and false alarms of each producer and rule, or attribute."""
    own = findings.join(products.select("id", "producer"), "id").join(current(log).select("id", "attr", "hash", "status"), ["id", "attr", "hash"], "left")
    s = F.col("status")
    return own.groupBy("producer", column).agg(F.count("*").alias("findings"), F.count_if(s == APPLIED).alias("errors"), F.count_if(s == FALSE_ALARM).alias("false_alarms"))


def rule_catalogue(rules: DataFrame, findings: DataFrame, log: DataFrame) -> DataFrame:
    """rules (rule_id) with findings, applied, false alarms; effectiveness only from LEAST_DECIDED decisions."""
    own = findings.join(current(log).select("id", "attr", "hash", "status"), ["id", "attr", "hash"], "left")
    n = own.groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == APPLIED).alias("applied"), F.count_if(F.col("status") == FALSE_ALARM).alias("false_alarms"))
    out = rules.join(n, "rule_id", "left").na.fill(0, ["findings", "applied", "false_alarms"])
    judged = F.col("applied") + F.col("false_alarms")
    return out.withColumn("effectiveness", F.when(judged >= LEAST_DECIDED, F.round(F.col("applied") / judged, 3)))


def report(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"), F.countDistinct("id").alias("products"))


def missing_data(products: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """products with completeness and n_attrs, of the three incomplete classes, the emptiest first."""
    return products.where("completeness <> 'ok'").orderBy("n_attrs", "producer", "id").offset(offset).limit(limit)


def missing_counters(products: DataFrame) -> DataFrame:
    rows = products.where("completeness <> 'ok'")
    part = lambda c: rows.groupBy(F.lit(c).alias("kind"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return part("completeness").unionByName(part("producer")).unionByName(part("category"))


def history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created"), F.desc("run_id")).limit(limit)


def filter_coverage(products: DataFrame, filters: DataFrame, values: DataFrame, gaps: DataFrame) -> DataFrame:
    """Of each (scope, attr): products, with a value, open proposals, gaps. products (id, scope); filters (scope, attr)."""
    cells = products.select("id", "scope").join(F.broadcast(filters), "scope")
    have = values.where(F.trim("value") != "").select("id", "attr").distinct().withColumn("have", F.lit(1))
    said = gaps.groupBy("id", "attr").agg(F.max(F.col("new_value").isNotNull().cast("int")).alias("proposed"))
    out = cells.join(have, ["id", "attr"], "left").join(said, ["id", "attr"], "left").groupBy("scope", "attr").agg(F.count("*").alias("products"), F.count("have").alias("with_value"), F.count_if(F.col("have").isNull() & (F.col("proposed") == 1)).alias("proposals"), F.count_if(F.col("have").isNull() & (F.coalesce("proposed", F.lit(0)) == 0)).alias("without"))
    return out.withColumn("coverage", F.round(F.col("with_value") / F.col("products"), 3))


def lacking(products: DataFrame, values: DataFrame, gaps: DataFrame, scope: str, attr: str) -> DataFrame:
    """Products of a scope that lack a filter's value, with the proposal if there is one."""
    own = products.where(F.col("scope") == scope).join(values.where((F.col("attr") == attr) & (F.trim("value") != "")).select("id"), "id", "left_anti")
    said = gaps.where(F.col("attr") == attr).groupBy("id").agg(F.max("new_value").alias("proposal"))
    return own.join(said, "id", "left").select("id", "name", "producer", "proposal")


def lacking_by_producer(products: DataFrame, values: DataFrame, gaps: DataFrame, scope: str, attr: str) -> DataFrame:
    gap = lacking(products, values, gaps, scope, attr).groupBy("producer").agg(F.count("*").alias("missing"), F.count("proposal").alias("with_proposal"))
    total = products.where(F.col("scope") == scope).groupBy("producer").agg(F.count("*").alias("total"))
    return gap.join(total, "producer").orderBy(F.desc("missing"), "producer")
