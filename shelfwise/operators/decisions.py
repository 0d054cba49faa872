"""Decisions as an append-only log, export batches, and their verification against the next snapshot.

log: (seq, id, attr, old_value, status, new_value, ts, batch_id). status 'cofnieta' takes a decision back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators.review import AUTO_CONFIDENCE, UNDONE, facets, latest

APPLIED, FALSE_ALARM, POSTPONED, TO_IMPORT = "zastosowana", "falszywy_alarm", "odlozona", "do_importu"
KEY = ("id", "attr", "hash")


def current(log: DataFrame) -> DataFrame:
    """The decision that holds for each (id, attr, hash of the old value)."""
    return latest(log.withColumn("hash", text.value_hash(F.col("old_value"))), KEY, ("ts", "seq")).where(F.col("status") != UNDONE)


def decide_group(rows: DataFrame, group: str, status: str) -> DataFrame:
    """A decision row for each open member of a group; none if its old or proposed values differ."""
    members = rows.where((F.col("grp") == group) & F.col("status").isNull())
    kinds = members.groupBy("grp").agg(F.countDistinct(F.coalesce("old_value", F.lit(""))).alias("olds"), F.countDistinct(F.coalesce("new_value", F.lit(""))).alias("news"))
    return members.join(kinds, "grp").where("olds <= 1 and news <= 1").select("id", "attr", "old_value", F.lit(status).alias("status"), "new_value")


def decide_product(rows: DataFrame, product: str, status: str) -> DataFrame:
    """A decision row for each ready open finding of a product."""
    ready = (F.col("confidence") >= AUTO_CONFIDENCE) & F.col("new_value").isNotNull() & F.col("status").isNull()
    return rows.where((F.col("id") == product) & ready).select("id", "attr", "old_value", F.lit(status).alias("status"), "new_value")


def decide_values(rows: DataFrame, group: str, values: DataFrame, multi: DataFrame) -> DataFrame:
    """values (id, new_value) for members of a group: blanks stay open, foreign ids and lists in single-valued attributes are left out."""
    members = rows.where((F.col("grp") == group) & F.col("status").isNull()).dropDuplicates(["id", "attr"])
    given = values.where(F.trim(F.coalesce("new_value", F.lit(""))) != "").dropDuplicates(["id"])
    both = members.drop("new_value").join(given, "id")
    bad = both.where(F.col("new_value").contains(",")).select("id", "attr").join(F.broadcast(multi.select("attr")), "attr", "left_anti")
    return both.join(bad, ["id", "attr"], "left_anti").select("id", "attr", "old_value", F.lit(APPLIED).alias("status"), "new_value")


def undo(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows to append that take decisions (id, attr, old_value) back, unless they were exported."""
    want = keys.select("id", "attr", text.value_hash(F.col("old_value")).alias("hash")).distinct()
    return current(log).where("batch_id is null").join(want, list(KEY), "left_semi").select("id", "attr", "old_value", F.lit(UNDONE).alias("status"), "new_value")


def dictionary_values(cells: DataFrame, panel: DataFrame, columns: DataFrame) -> DataFrame:
    """(id, attr, value) as panel text 'id|label', or the reason why not. panel: (attr, label, pid); columns: (attr) of the template."""
    known = F.broadcast(columns.select("attr").distinct().withColumn("column", F.lit(True)))
    listed = F.broadcast(panel.select("attr").distinct().withColumn("listed", F.lit(True)))
    ids = panel.groupBy("attr", text.norm(F.col("label")).alias("n")).agg(F.countDistinct("pid").alias("kinds"), F.min("pid").alias("pid"), F.min("label").alias("label"))
    parts = cells.select("id", "attr", "value", F.posexplode(text.members(F.col("value"))).alias("pos", "part")).withColumn("n", text.norm(F.col("part"))).join(ids, ["attr", "n"], "left")
    fault = F.when(F.col("kinds").isNull(), "unknown").when(F.col("kinds") > 1, "ambiguous")
    made = parts.groupBy("id", "attr", "value").agg(F.min_by(fault, F.when(fault.isNotNull(), F.col("pos"))).alias("fault"), F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("|", "pid", "label").alias("text")))).alias("texts"))
    out = cells.join(made, ["id", "attr", "value"], "left").join(known, "attr", "left").join(listed, "attr", "left")
    reason = F.when(F.col("column").isNull(), "no column").when(F.col("listed").isNull(), None).otherwise(F.col("fault"))
    joined = F.array_join(F.transform("texts", lambda x: x["text"]), ", ")
    return out.select("id", "attr", "value", F.when(reason.isNull(), F.when(F.col("listed").isNull(), F.col("value")).otherwise(joined)).alias("text"), reason.alias("reason"))


def waiting(log: DataFrame) -> DataFrame:
    return current(log).where((F.col("status") == APPLIED) & F.col("new_value").isNotNull() & F.col("batch_id").isNull())


def scopes(log: DataFrame, requests: DataFrame, products: DataFrame) -> DataFrame:
    """Categories and producers with waiting work: distinct products of decisions and requests."""
    ids = waiting(log).select("id").union(requests.where("batch_id is null").select("id")).distinct()
    own = products.join(ids, "id", "left_semi")
    part = lambda c: own.groupBy(F.lit(c).alias("kind"), F.col(c).alias("value")).agg(F.countDistinct("id").alias("products"))
    return part("category").unionByName(part("producer"))


def plan(log: DataFrame, products: DataFrame, checked: DataFrame, limit: int, category: str | None = None, producer: str | None = None, disabled: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(planned, skipped) waiting changes. checked: (id, attr, value, text, reason) of dictionary_values(). The first `limit` products by their first decision, with all their changes. disabled: (attr) taken out of circulation, skipped for that reason."""
    due = waiting(log).join(products.select("id", "category", "producer"), "id")
    due = due.where(F.col("category") == category) if category else due
    due = due.where(F.col("producer") == producer) if producer else due
    due = due.join(checked.select("id", "attr", F.col("value").alias("new_value"), "text", "reason").dropDuplicates(["id", "attr", "new_value"]), ["id", "attr", "new_value"], "left")
    if disabled is not None:
        off = disabled.select("attr").distinct().withColumn("__off", F.lit(True))
        due = due.join(off, "attr", "left").withColumn("reason", F.when(F.col("__off"), "disabled").otherwise(F.col("reason"))).drop("__off")
    good = due.where("reason is null and text is not null")
    first = good.groupBy("id").agg(F.min(F.struct("ts", "seq")).alias("first")).orderBy("first", "id").limit(limit)
    before = current(log).where("batch_id is not null").groupBy("id").agg(F.max("batch_id").alias("last_batch"))
    planned = good.join(first.select("id"), "id", "left_semi").join(before, "id", "left")
    return planned, due.where("reason is not null or text is null")


def add_requests(planned: DataFrame, requests: DataFrame, cells: DataFrame, room: int) -> DataFrame:
    """Requested products that aren't planned, with all exportable attributes, as room allows; planned changes count first."""
    left = requests.where("batch_id is null").join(planned.select("id").distinct(), "id", "left_anti").select("id").distinct().orderBy("id").limit(room)
    full = cells.where("reason is null and text is not null").join(requests.where("batch_id is null").select("id").distinct(), "id", "left_semi")
    own = full.join(left.unionByName(planned.select("id").distinct()).distinct(), "id", "left_semi").join(planned.select("id", "attr"), ["id", "attr"], "left_anti")
    return planned.select("id", "attr", "text", F.lit("change").alias("why")).unionByName(own.select("id", "attr", "text", F.lit("request").alias("why")))


def skipped_summary(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("attr", "new_value", F.coalesce("reason", F.lit("unchecked")).alias("reason")).agg(F.count("*").alias("n"), F.min("id").alias("example"))


def wide(planned: DataFrame, header: list[str], text_column: str = "text") -> DataFrame:
    """A row for each product, a column for each attribute of the header, in its order."""
    out = planned.groupBy("id").pivot("attr", header).agg(F.min(text_column))
    return out.select("id", *header)


def corrections(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrections, rollback) of applied decisions: old and new values, and the other way round."""
    done = current(log).where((F.col("status") == APPLIED) & F.col("new_value").isNotNull())
    forward = done.select("id", "attr", F.col("old_value").alias("from_value"), F.col("new_value").alias("to_value"))
    return forward, forward.select("id", "attr", F.col("to_value").alias("from_value"), F.col("from_value").alias("to_value"))


def batches(log: DataFrame, made: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """made (batch_id, created) with the number of their decisions; withdrawn ones give theirs back."""
    n = current(log).where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("decisions"))
    gone = F.broadcast(withdrawn.select("batch_id").distinct().withColumn("gone", F.lit(True)))
    out = made.join(n, "batch_id", "left").join(gone, "batch_id", "left")
    return out.select("batch_id", "created", F.when(F.col("gone"), 0).otherwise(F.coalesce("decisions", F.lit(0))).cast("long").alias("decisions"), F.coalesce("gone", F.lit(False)).alias("withdrawn"))


def verify(log: DataFrame, made: DataFrame, withdrawn: DataFrame, products: DataFrame, raw: DataFrame, taken_at) -> DataFrame:
    """State of each exported decision in a snapshot taken at taken_at; batches made later are left out."""
    sent = current(log).where((F.col("status") == APPLIED) & F.col("batch_id").isNotNull())
    sent = sent.join(F.broadcast(made.where(F.col("created") <= taken_at).select("batch_id")), "batch_id").join(F.broadcast(withdrawn.select("batch_id")), "batch_id", "left_anti")
    now = sent.join(products.select("id").distinct().withColumn("there", F.lit(True)), "id", "left").join(raw.select("id", "attr", F.col("value").alias("found")), ["id", "attr"], "left")
    state = (
        F.when(F.col("there").isNull(), "brak_produktu").when(F.col("found").isNull(), "brak_atrybutu").when(text.same_value(F.col("found"), F.col("new_value")), "weszlo")
        .when(text.value_hash(F.col("found")) == F.col("hash"), "bez_zmian").otherwise("inna_wartosc")
    )
    return now.select("batch_id", "id", "attr", "hash", F.col("new_value").alias("expected"), "found", state.alias("state"))


STATES = ("weszlo", "bez_zmian", "inna_wartosc", "brak_atrybutu", "brak_produktu")


def verified_by_batch(states: DataFrame) -> DataFrame:
    return states.groupBy("batch_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES), F.count("*").alias("n"))


def verified_summary(states: DataFrame) -> DataFrame:
    won = F.count_if(F.col("state") == "weszlo")
    return states.agg(F.count("*").alias("n"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES), F.round(100 * won / F.nullif(F.count("*"), F.lit(0)), 1).alias("effectiveness"))


def verified_details(states: DataFrame, limit: int = 200) -> DataFrame:
    return states.where("state <> 'weszlo'").orderBy("batch_id", "id", "attr", "hash").limit(limit)


def decided_page(log: DataFrame, products: DataFrame, status: str | None = None, exported: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = current(log).join(products.select("id", "name", "producer", "category"), "id", "left")
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("batch_id").isNotNull() == exported) if exported is not None else rows
    return rows.orderBy(F.desc("ts"), F.desc("seq")).offset(offset).limit(limit)


def decided(log: DataFrame, products: DataFrame, findings: DataFrame, made: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Decisions that hold with their product, the first finding (fid) of their cell, and their batch: rule_id, severity, layer, grp, batch_created, batch_withdrawn. What is missing is null."""
    about = products.groupBy("id").agg(*(F.min(c).alias(c) for c in ("name", "producer", "category", "photo")))
    first = findings.withColumn("hash", text.value_hash(F.col("old_value"))).groupBy(*KEY).agg(F.min_by(F.struct("rule_id", "severity", "layer", "grp"), "fid").alias("of")).select(*KEY, "of.*")
    sent = made.groupBy("batch_id").agg(F.min("created").alias("batch_created")).join(withdrawn.select("batch_id").distinct().withColumn("batch_withdrawn", F.lit(True)), "batch_id", "left")
    rows = current(log).join(about, "id", "left").join(first, list(KEY), "left").join(sent, "batch_id", "left")
    return rows.withColumn("batch_withdrawn", F.coalesce("batch_withdrawn", F.lit(False)))


def decided_predicate(*, status: str | None = None, attr: str | None = None, rule: str | None = None, producer: str | None = None, category: str | None = None, export: str | None = None, search: str | None = None) -> Column:
    """All filters that are given, and-ed. export: 'waiting' (applied, in no batch) or 'sent'; search: a part of the name, or the id."""
    out = F.lit(True)
    for column, value in (("status", status), ("attr", attr), ("rule_id", rule), ("producer", producer), ("category", category)):
        out &= F.coalesce(F.col(column) == value, F.lit(False)) if value else F.lit(True)
    if export == "waiting":
        out &= F.col("batch_id").isNull() & (F.col("status") == APPLIED)
    elif export == "sent":
        out &= F.col("batch_id").isNotNull()
    if search:
        out &= F.coalesce(F.contains(F.lower("name"), F.lit(search.lower())), F.lit(False)) | (F.col("id") == search)
    return out


def decided_list(rows: DataFrame, limit: int = 100, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """(a page, the latest first; the number of all) of decided() under filters."""
    found = rows.where(decided_predicate(**filters))
    return found.orderBy(F.desc("ts"), F.desc("seq")).offset(offset).limit(limit), found.agg(F.count("*").alias("n"))


def decided_facets(rows: DataFrame, filters: dict, top: int = 40) -> DataFrame:
    """(dimension, value, n): attributes, rules, producers (the top ones) and categories, each under all other filters; a chosen value stays, with 0 if need be."""
    dimensions = {"attr": "attr", "rule": "rule_id", "producer": "producer", "category": "category"}
    return facets(rows, filters, dimensions, top, decided_predicate, ("producer",)).where("value is not null and value <> ''")


def decided_counters(log: DataFrame) -> DataFrame:
    s = F.col("status")
    return current(log).agg(F.count("*").alias("n"), F.count_if(s == APPLIED).alias("applied"), F.count_if(s == FALSE_ALARM).alias("false_alarms"), F.count_if(s == POSTPONED).alias("postponed"), F.count_if(F.col("batch_id").isNotNull()).alias("exported"), F.count_if((s == APPLIED) & F.col("batch_id").isNull()).alias("waiting"))


def request_import(rows: DataFrame, ids: DataFrame, exportable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, decisions to append) for products with at least one exportable attribute; gaps without a value stay open."""
    good = ids.select("id").distinct().join(exportable.where("reason is null and text is not null").select("id"), "id", "left_semi")
    closed = rows.where("status is null and rule_id <> 'L1-LUKA-BRAK'").join(good, "id", "left_semi").select("id", "attr", "old_value", F.lit(TO_IMPORT).alias("status"), "new_value").distinct()
    return good, closed
