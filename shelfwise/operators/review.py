"""The review queue: findings with their product and latest decision, filtered, grouped, counted and paged."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import value_hash
from shelfwise.operators.findings import severity_rank

AUTO_CONFIDENCE = 0.85
#: A decision that is taken back.
UNDONE = "cofnieta"
# Attributes that a photo can show.
VISIBLE = (
    "Szerokość", "Wysokość", "Głębokość", "Liczba drzwi", "Liczba szuflad", "Liczba półek", "Liczba szafek", "Liczba drążków", "Materiał", "Oświetlenie", "Rodzaj drzwi",
    "Kształt blatu", "Podparcie", "Tapicerowane", "Zagłówek", "Na nóżkach", "Podłokietniki", "Styl", "Dekoracje", "Rodzaj frontu", "Z pojemnikiem",
)


def latest(log: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def decision_state() -> Column:
    """The status that a decision gives its finding: none if it is taken back."""
    return F.when(F.col("status") != UNDONE, F.col("status"))


def base(findings: DataFrame, products: DataFrame, decisions: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Findings ⋈ products ⟕ the latest decision on (id, attr, hash of the old value) ⟕ the latest verdict on (id, attr). standing.Queue keeps it as a table."""
    own = findings.withColumn("hash", value_hash(F.col("old_value")))
    last = latest(decisions.withColumn("hash", value_hash(F.col("old_value"))), ("id", "attr", "hash"), ("ts", "seq"))
    state = decision_state()
    held = last.select("id", "attr", "hash", state.alias("status"), F.when(state.isNotNull(), F.col("new_value")).alias("decided_value"), F.when(state.isNotNull(), F.col("batch_id").cast("long")).alias("batch_id"), F.col("ts").alias("decided_ts"), F.col("seq").cast("long").alias("decided_seq"))
    out = own.join(products, "id").join(held, ["id", "attr", "hash"], "left")
    if verdicts is not None:
        out = out.join(latest(verdicts, ("id", "attr"), ("seq",)).select("id", "attr", F.col("verdict"), F.col("seq").cast("long").alias("verdict_seq")), ["id", "attr"], "left")
    return out


def routing(visible: tuple[str, ...] = VISIBLE) -> Column:
    """auto: sure and with a proposal; photo: unsure, visible and with a photo; human: the rest."""
    auto = (F.col("confidence") >= AUTO_CONFIDENCE) & F.col("new_value").isNotNull()
    photo = (F.col("confidence") < AUTO_CONFIDENCE) & (F.coalesce("photo", F.lit("")) != "") & F.col("attr").isin(*visible)
    return F.when(auto, "auto").when(photo, "photo").otherwise("human")


def scope(name: str) -> Column:
    """'w55' is a tree node, anything else a category."""
    return F.col("node") == int(name[1:]) if name[:1] == "w" and name[1:].isdigit() else F.col("category") == name


def predicate(*, scope_name: str | None = None, producer: str | None = None, rule: str | None = None, layer: str | None = None, severity: str | None = None, attr: str | None = None, photo: bool | None = None, is_open: bool | None = None, search: str | None = None, route: str | None = None, verdict: str | None = None, visible: tuple[str, ...] = VISIBLE) -> Column:
    """All filters that are given, and-ed. A rule that ends in * is a family; verdict 'none' is no verdict."""
    parts = [F.lit(True)]
    parts += [scope(scope_name)] if scope_name else []
    parts += [F.col("rule_id").startswith(rule[:-1]) if rule.endswith("*") else F.col("rule_id") == rule] if rule else []
    parts += [F.col(c) == v for c, v in (("producer", producer), ("layer", layer), ("severity", severity), ("attr", attr)) if v]
    parts += [(F.coalesce("photo", F.lit("")) != "") == photo] if photo is not None else []
    parts += [F.col("status").isNull() if is_open else F.col("status").isNotNull()] if is_open is not None else []
    parts += [F.col("name").ilike(f"%{search}%") | (F.col("id") == search)] if search else []
    parts += [routing(visible) == route] if route else []
    parts += [F.col("verdict").isNull() if verdict == "none" else F.col("verdict") == verdict] if verdict else []
    out = parts[0]
    for p in parts[1:]:
        out &= p
    return out


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("findings"), F.countDistinct("grp").alias("groups"))


def group_page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A row for each group: size, kinds of proposals and old values, and the finding with the smallest id. Most severe and largest first."""
    v = lambda c: F.countDistinct(F.coalesce(c, F.lit("")))
    first = F.min_by(F.struct("id", "attr", "rule_id", "old_value", "new_value"), F.struct(severity_rank("severity"), F.col("id"), F.col("fid")))
    out = rows.groupBy("grp").agg(F.count("*").alias("n"), v("new_value").alias("proposals"), v("old_value").alias("olds"), F.min(severity_rank("severity")).alias("rank"), first.alias("first"))
    out = out.withColumn("uniform", (F.col("proposals") <= 1) & (F.col("olds") <= 1))
    return out.orderBy("rank", F.desc("n"), "grp").offset(offset).limit(limit).select("grp", "n", "proposals", "olds", "rank", "uniform", "first.*")


def flat_page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy(severity_rank("severity"), F.desc("confidence"), "id", "fid").offset(offset).limit(limit)


def group_members(rows: DataFrame, group: str, limit: int = 200) -> DataFrame:
    return rows.where(F.col("grp") == group).orderBy("producer", "name", "id", "fid").limit(limit)


def by_product(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of products with their number of findings, of ready ones, and the findings in order."""
    ready = (F.col("confidence") >= AUTO_CONFIDENCE) & F.col("new_value").isNotNull()
    page = rows.groupBy("id").agg(F.min(severity_rank("severity")).alias("rank"), F.count("*").alias("n"), F.count_if(ready).alias("ready")).orderBy("rank", F.desc("n"), "id").offset(offset).limit(limit)
    own = rows.join(F.broadcast(page.select("id")), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(severity_rank("severity").alias("rank"), "attr", "fid"))).alias("findings"))
    return page.join(own, "id").select("id", "rank", "n", "ready", F.transform("findings", lambda x: x["fid"]).alias("fids"))


def facets(rows: DataFrame, filters: dict, dimensions: dict[str, str], top: int = 40, of=predicate, limited: tuple[str, ...] | None = None) -> DataFrame:
    """Counts of each dimension's values under all other filters, the top ones (of all dimensions, or of the limited ones); a chosen value stays, with 0 if need be. `of` makes the condition of filters."""
    under = {key: of(**{k: v for k, v in filters.items() if k != key}) for key in dimensions}
    cells = [F.when(under[key], F.struct(F.lit(key).alias("dimension"), F.col(column).cast("string").alias("value"))) for key, column in dimensions.items()]
    counts = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    place = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    chosen = F.coalesce(*(F.when((F.col("dimension") == k) & (F.col("value") == str(v)), F.lit(True)) for k, v in filters.items() if v and k in dimensions), F.lit(False)) if any(filters.get(k) for k in dimensions) else F.lit(False)
    within = (F.col("place") <= top) if limited is None else (F.col("place") <= top) | ~F.col("dimension").isin(*limited)
    shown = counts.withColumn("place", F.row_number().over(place)).where(within | chosen).select("dimension", "value", F.when(within, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"))
    for key in dimensions:
        if filters.get(key):
            zero = rows.sparkSession.range(1).select(F.lit(key).alias("dimension"), F.lit(str(filters[key])).alias("value"), F.lit(0).cast("long").alias("n"))
            shown = shown.unionByName(zero)
    return shown.groupBy("dimension", "value").agg(F.max("n").alias("n"))


def counters(rows: DataFrame, visible: tuple[str, ...] = VISIBLE) -> DataFrame:
    """The queue's counters in one pass."""
    is_open = F.col("status").isNull()
    route = routing(visible)
    return rows.agg(
        F.count("*").alias("findings"), F.count_if(is_open).alias("open"), F.count_if(~is_open).alias("decided"), F.countDistinct(F.when(is_open, F.col("grp"))).alias("open_groups"),
        F.countDistinct(F.when(is_open, F.col("id"))).alias("open_products"), F.count_if(is_open & (route == "auto")).alias("auto"), F.count_if(is_open & (route == "photo")).alias("photo"), F.count_if(is_open & (route == "human")).alias("human"),
        F.count_if(is_open & (F.col("severity") == "krytyczna")).alias("critical"), F.count_if(is_open & (F.col("severity") == "srednia")).alias("middle"), F.count_if(is_open & (F.col("severity") == "info")).alias("info"),
        F.count_if(F.col("status") == "zastosowana").alias("applied"), F.count_if(F.col("status") == "falszywy_alarm").alias("false_alarms"),
    )


def product_card(rows: DataFrame, product: str) -> DataFrame:
    """All findings of one product, the open ones first."""
    return rows.where(F.col("id") == product).orderBy(F.col("status").isNotNull(), severity_rank("severity"), "attr", "fid")
