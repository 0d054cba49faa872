"""Missing values that customers filter on: candidates from several sources, the best for each cell, and what stays open.

products: (id, name, producer, category, subtype, …); cells: (id, attr) a filter applies to; values: (id, attr, value)
effective ones; labels: (attr, label) of the shop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import findings as f

# Order of sources, bounds.
SOURCES = ("subtype", "name", "size", "sleep", "photo", "family")
FAMILY_KNOWN, FAMILY_SHARE, PHOTO_MOST, DISPUTED_MOST = 3, 0.9, 0.80, 0.60
COLUMNS = ("id", "attr", "rule_id", "layer", "severity", "confidence", "old_value", "new_value", "evidence", "source")


def effective(raw: DataFrame, components: DataFrame) -> DataFrame:
    """Non-empty attributes over components."""
    own = raw.where(F.trim("value") != "").select("id", "attr", "value")
    return own.unionByName(components.where(F.trim("value") != "").select("id", "attr", "value").join(own.select("id", "attr"), ["id", "attr"], "left_anti"))


def cells(products: DataFrame, node_filters: DataFrame, category_filters: DataFrame, values: DataFrame, sleep: tuple[str, ...] = ("Szerokość powierzchni spania", "Długość powierzchni spania"), functions: str = "Funkcje") -> DataFrame:
    """(id, attr): filters of the node if there is one, else of the category; not sleeping sizes of products without that function."""
    by_node = products.where("node is not null").select("id", "node").join(F.broadcast(node_filters), "node").select("id", "attr")
    by_category = products.where("node is null").select("id", "category").join(F.broadcast(category_filters), "category").select("id", "attr")
    own = by_node.unionByName(by_category).distinct()
    has = own.where(F.col("attr") == functions).select("id").join(values.where((F.col("attr") == functions) & text.norm(F.col("value")).contains("spania")).select("id"), "id", "left_anti")
    drop = has.select("id", F.explode(F.array(*map(F.lit, sleep))).alias("attr"))
    return own.join(drop, ["id", "attr"], "left_anti")


def _row(rows: DataFrame, rule, severity, confidence, new, source: str, old=None, layer: str = "L2", evidence="") -> DataFrame:
    out = f.emit(rows, rule, layer, severity, confidence, old=old, new=new, evidence=evidence)
    return out.drop("grp").withColumn("source", F.lit(source))


def from_subtype(products: DataFrame, own: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (subtype, attr, value, allowed array): L2-LUKA-PODTYP and L2-LUKA-PODTYP-SPRZECZNE."""
    keyed = rules.withColumn("s", text.norm(F.col("subtype"))).select("s", "attr", F.col("value").alias("due"), "allowed")
    rows = products.select("id", text.norm(F.col("subtype")).alias("s")).join(F.broadcast(keyed), "s").join(own, ["id", "attr"]).join(values, ["id", "attr"], "left")
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    against = ~empty & ~text.same_value(F.col("value"), F.col("due")) & ~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False))
    rows = rows.withColumn("empty", empty).where(empty | against)
    rule = F.when(F.col("empty"), "L2-LUKA-PODTYP").otherwise("L2-LUKA-PODTYP-SPRZECZNE")
    return _row(rows, rule, F.when(F.col("empty"), f.MIDDLE).otherwise(f.CRITICAL), F.when(F.col("empty"), 0.92).otherwise(0.88), F.col("due"), "subtype", old=F.when(~F.col("empty"), F.col("value")))


def from_name(products: DataFrame, own: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (pos, attr, value, include, exclude, categories array): the first that matches the normalised name. Distinct names only."""
    names = products.select("name", "category").distinct().withColumn("n", text.norm(F.col("name")))
    ok = F.expr("n rlike include and (exclude is null or not (n rlike exclude)) and (categories is null or array_contains(categories, category))")
    first = names.join(F.broadcast(rules), ok).groupBy("name", "category", "attr").agg(F.min_by("value", "pos").alias("due"))
    rows = products.select("id", "name", "category").join(first, ["name", "category"]).join(own, ["id", "attr"]).join(values.select("id", "attr"), ["id", "attr"], "left_anti")
    return _row(rows, "L2-LUKA-NAZWA", f.MIDDLE, 0.80, F.col("due"), "name")


def from_size(own: DataFrame, values: DataFrame, size_attr: str, targets: tuple[str, str]) -> DataFrame:
    """A size like 90x200 fills width and length: L2-LUKA-ROZMIAR; L2-LUKA-ROZMIAR-SPRZECZNE where they say otherwise, or nothing that can be read."""
    size = values.where(F.col("attr") == size_attr).select("id", text.size_pair(F.col("value")).alias("s")).where("s is not null")
    due = size.select("id", F.stack(F.lit(2), F.lit(targets[0]), F.col("s.short"), F.lit(targets[1]), F.col("s.long")).alias("attr", "due"))
    rows = due.join(own, ["id", "attr"]).join(values, ["id", "attr"], "left").withColumn("empty", F.col("value").isNull())
    rows = rows.where(F.col("empty") | F.coalesce(F.abs(text.number(F.col("value")) - F.col("due")) > 0.5, F.lit(True)))
    rule = F.when(F.col("empty"), "L2-LUKA-ROZMIAR").otherwise("L2-LUKA-ROZMIAR-SPRZECZNE")
    return _row(rows, rule, F.when(F.col("empty"), f.MIDDLE).otherwise(f.CRITICAL), F.when(F.col("empty"), 0.95).otherwise(1.0), F.when(F.col("empty"), F.col("due").cast("string")), "size", old="value")


def from_sleep(products: DataFrame, own: DataFrame, values: DataFrame, attr: str = "Funkcje", label: str = "z funkcją spania", old_field: str = "Funkcja spania", mechanism: str = "Mechanizm", named: str = "rozkladan|z funkcja spania", not_named: str | None = None, node_named: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """L2-LUKA-FUNKCJA-SPANIA: the surest evidence of an old field that begins 'z funkcj…', a mechanism, the node's name or the product's.

    products may have node_name. Patterns are of normalised names; a product named by not_named is no evidence. What says
    'bez…' in the old field stays as it is. labels (attr, label): the shop's spelling of the value; unknown to it, nothing
    is proposed.
    """
    pick = lambda a: F.max(F.when(F.col("attr") == a, F.col("value")))
    held = values.where(F.col("attr").isin(attr, old_field, mechanism)).groupBy("id").agg(pick(attr).alias("now"), pick(old_field).alias("old"), pick(mechanism).alias("mechanism"))
    said = products.select("id", "name", (F.col("node_name") if "node_name" in products.columns else F.lit(None).cast("string")).alias("node_name"))
    rows = own.where(F.col("attr") == attr).join(said, "id").join(held, "id", "left")
    n = lambda c: text.norm(F.col(c))
    by_name = n("name").rlike(named) & (~n("name").rlike(not_named) if not_named else F.lit(True))
    by_node = n("node_name").rlike(node_named) if node_named else F.lit(False)
    proofs = F.array_compact(F.array(F.when(n("old").startswith("z funkcj"), F.lit(0.92)), F.when(F.trim(F.coalesce("mechanism", F.lit(""))) != "", F.lit(0.90)), F.when(by_node, F.lit(0.92)), F.when(by_name, F.lit(0.80))))
    has = F.exists(text.members(F.coalesce("now", F.lit(""))), lambda m: text.norm(m) == text.norm(F.lit(label)))
    rows = rows.withColumn("sure", F.array_max(proofs)).where("sure is not null").where(~n("old").startswith("bez") & ~has)
    new = F.lit(label)
    if labels is not None:
        spelled = labels.where(F.col("attr") == attr).where(text.norm(F.col("label")) == text.norm(F.lit(label))).groupBy("attr").agg(F.min("label").alias("spelled"))
        rows, new = rows.join(spelled, "attr"), F.col("spelled")
    return _row(rows, "L2-LUKA-FUNKCJA-SPANIA", f.MIDDLE, F.col("sure"), F.when(n("now") == "", new).otherwise(F.concat_ws(", ", "now", new)), "sleep", old="now")


def from_family(products: DataFrame, own: DataFrame, values: DataFrame, labels: DataFrame, family: list, equipment: tuple[str, ...] = ()) -> DataFrame:
    """L2-LUKA-RODZINA: a value that the family nearly agrees on, for its members without one. Two aggregations and a join back."""
    keyed = products.select("id", F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in family))).alias("family"))
    rows = own.join(values, ["id", "attr"], "left").join(keyed, "id")
    counts = rows.where("value is not null").groupBy("family", "attr", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("family", "attr").agg(F.sum("n").alias("known"), F.max("n").alias("agree"), F.max_by("value", F.struct("n", "value")).alias("due")).where((F.col("known") >= FAMILY_KNOWN) & (F.col("agree") >= FAMILY_SHARE * F.col("known")))
    spelled = labels.select("attr", text.norm(F.col("label")).alias("n_label"), "label").groupBy("attr", "n_label").agg(F.min("label").alias("label"))
    good = top.withColumn("n_label", text.norm(F.col("due"))).join(spelled, ["attr", "n_label"])
    out = rows.where("value is null").join(good, ["family", "attr"])
    sure = text.family_probability(F.col("agree"), F.col("known"), F.col("attr").isin(*equipment) if equipment else F.lit(False))
    return _row(out, "L2-LUKA-RODZINA", f.MIDDLE, sure, F.col("label"), "family")


def from_photos(own: DataFrame, values: DataFrame, reads: DataFrame, labels: DataFrame) -> DataFrame:
    """reads (id, attr, read, confidence): L2-LUKA-ZDJECIE, only in the shop's spelling."""
    spelled = labels.select("attr", text.norm(F.col("label")).alias("n"), "label").groupBy("attr", "n").agg(F.min("label").alias("label"))
    rows = reads.withColumn("n", text.norm(F.col("read"))).join(spelled, ["attr", "n"]).join(own, ["id", "attr"]).join(values.select("id", "attr"), ["id", "attr"], "left_anti")
    return _row(rows, "L2-LUKA-ZDJECIE", f.MIDDLE, F.least(F.col("confidence"), F.lit(PHOTO_MOST)), F.col("label"), "photo", layer="L3")


def candidates(products: DataFrame, own: DataFrame, values: DataFrame, labels: DataFrame, *, subtypes: DataFrame | None = None, names: DataFrame | None = None, reads: DataFrame | None = None, size: tuple[str, tuple[str, str]] = ("Rozmiar", ("Szerokość powierzchni spania", "Długość powierzchni spania")), family: list | None = None) -> DataFrame:
    """What all six sources propose. Rules of subtypes and names, and reads of photos, only where there are any; products without a collection have no family by it, and those with a producer_code have one by that."""
    family = family or [F.col("producer"), F.col("category"), text.norm(F.col("collection"))]
    found = [from_size(own, values, *size), from_sleep(products, own, values), from_family(products.where(F.trim("collection") != ""), own, values, labels, family)]
    if "producer_code" in products.columns:  # variants of one model
        code = text.norm(F.col("producer_code"))
        found.append(from_family(products.where(code != ""), own, values, labels, [F.col("producer"), F.col("category"), F.lit("model"), code]))
    if subtypes is not None:
        found.append(from_subtype(products, own, values, subtypes))
    if names is not None:
        found.append(from_name(products, own, values, names))
    if reads is not None:
        found.append(from_photos(own, values, reads, labels))
    return f.union(found)


def grouped(found: DataFrame, products: DataFrame) -> DataFrame:
    """Gaps with the group of one decision: by subtype, value, family or, where nothing is proposed, by scope (node, else category) and producer."""
    said = products.select("id", "subtype", "producer", F.col("category").alias("kind"), text.norm(F.col("collection")).alias("line"), F.coalesce(F.concat(F.lit("w"), F.col("node").cast("string")), F.col("category")).alias("scope"))
    proof = F.when(F.col("confidence") >= 0.92, "pole").when(F.col("confidence") >= 0.90, "typ").otherwise("nazwa")
    of = {
        "L2-LUKA-PODTYP": ("subtype", "attr"),
        "L2-LUKA-PODTYP-SPRZECZNE": ("subtype", "attr", "old_value"),
        "L2-LUKA-NAZWA": ("attr", "new_value"),
        "L2-LUKA-ROZMIAR": ("attr", "new_value"),
        "L2-LUKA-ROZMIAR-SPRZECZNE": ("attr",),
        "L2-LUKA-FUNKCJA-SPANIA": (proof, "scope"),
        "L2-LUKA-RODZINA": ("attr", "new_value", "producer", "kind", "line"),
        "L2-LUKA-ZDJECIE": ("kind", "attr", "new_value", "producer"),
        "L1-LUKA-BRAK": ("scope", "attr", "producer"),
    }
    group = F.coalesce(*(F.when(F.col("rule_id") == rule, F.concat_ws("|", "rule_id", *parts)) for rule, parts in of.items()))
    return found.join(said, "id", "left").withColumn("grp", group).select(*f.COLUMNS)


def best(candidates: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """One candidate for each cell: the surest, then the first source."""
    if disabled is not None:
        candidates = candidates.join(F.broadcast(disabled), "rule_id", "left_anti")
    place = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    w = Window.partitionBy("id", "attr").orderBy(F.desc("confidence"), place, "new_value")
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").select(*COLUMNS)


def remaining(own: DataFrame, values: DataFrame, candidates: DataFrame, optional: DataFrame) -> DataFrame:
    """L1-LUKA-BRAK: cells without value or candidate, but for optional attributes."""
    left = own.join(values.select("id", "attr"), ["id", "attr"], "left_anti").join(candidates.select("id", "attr"), ["id", "attr"], "left_anti").join(F.broadcast(optional), "attr", "left_anti")
    return _row(left, "L1-LUKA-BRAK", f.INFO, 1.0, None, "none", layer="L1")


def reconcile(existing: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing, gaps) with one open finding for each empty cell.

    The side without a proposal yields; equal proposals: the surer stays; different ones: the surer stays, no surer than
    DISPUTED_MOST, and its group says so; with none, the gap stays.
    """
    keys = ["id", "attr"]
    empty = F.trim(F.coalesce("old_value", F.lit(""))) == ""
    theirs = existing.where(empty).groupBy(*keys).agg(F.max_by("new_value", F.struct(F.col("new_value").isNotNull(), "confidence")).alias("e_new"), F.max(F.when(F.col("new_value").isNotNull(), F.col("confidence"))).alias("e_sure"))
    ours = gaps.where(empty).groupBy(*keys).agg(F.max_by("new_value", F.struct(F.col("new_value").isNotNull(), "confidence")).alias("g_new"), F.max(F.when(F.col("new_value").isNotNull(), F.col("confidence"))).alias("g_sure"))
    both = theirs.join(ours, keys)
    stay = F.when(F.col("e_new").isNull(), "gap").when(F.col("g_new").isNull(), "existing").when(F.col("g_sure") >= F.col("e_sure"), "gap").otherwise("existing")
    clash = F.col("e_new").isNotNull() & F.col("g_new").isNotNull() & (text.norm(F.col("e_new")) != text.norm(F.col("g_new")))
    plan = both.select(*keys, stay.alias("stay"), F.coalesce(clash, F.lit(False)).alias("clash"), "e_new", "g_new")

    def kept(rows: DataFrame, side: str, other: str) -> DataFrame:
        out = rows.join(plan, keys, "left").where(~empty | F.col("stay").isNull() | (F.col("stay") == side))
        disputed = empty & F.coalesce("clash", F.lit(False))
        grp = F.when(disputed, F.concat_ws("|", "grp", F.lit("SPOR"), other)).otherwise(F.col("grp"))
        return out.withColumn("confidence", F.when(disputed, F.least("confidence", F.lit(DISPUTED_MOST))).otherwise(F.col("confidence"))).withColumn("grp", grp).select(*f.COLUMNS)

    return kept(existing, "existing", "g_new"), kept(gaps, "gap", "e_new")
