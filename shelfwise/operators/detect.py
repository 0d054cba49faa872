"""Detectors over products, long attributes and rule tables.

products: (id, name, producer, collection, category, photo, …); raw and norm attributes: (id, attr, value); nums: (id,
attr, num). Each detector is one projection or join; rule tables are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import findings as f
from shelfwise.operators import quantiles
from shelfwise.sources import tables

# Fixed values.
KEY_ATTRIBUTES = ("Szerokość", "Wysokość", "Głębokość", "Waga", "Materiał")
FAMILY_ATTRIBUTES = ("Materiał", "Stopień montażu", "Liczba drzwi", "Liczba szuflad", "Liczba półek", "Styl", "Podparcie", "Rodzaj drzwi")
SLEEPING = ("lozko", "lozko_dzieciece", "polkotapczan", "materac", "stelaz")
SCALES, SCALE_MARGIN = ((10.0, "×10"), (0.1, "÷10"), (0.01, "÷100"), (100.0, "×100")), 1.5
PART_ATTRIBUTES = {"doors": "Liczba drzwi", "drawers": "Liczba szuflad", "shelves": "Liczba półek", "rods": "Liczba drążków"}
REQUIRED, LEAST_VALUES, FAMILY_SIZE, FAMILY_SHARE = 0.95, 30, 4, 0.8


def analysed(products: DataFrame, norm: DataFrame, least: int = 3) -> DataFrame:
    """Products with data enough to be checked; the empty and sparse ones are for their source to fill."""
    enough = norm.where(F.trim("value") != "").groupBy("id").agg(F.countDistinct("attr").alias("n")).where(F.col("n") >= least)
    return products.join(enough.select("id"), "id", "left_semi")


def not_cut_off(components: DataFrame, cut_off: DataFrame | None) -> DataFrame:
    """Components of products (id) that the shop has not cut off from them already."""
    return components if cut_off is None else components.join(cut_off.select("id"), "id", "left_anti")


def moved_components(components: DataFrame, raw: DataFrame, panel: DataFrame, cut_off: DataFrame | None = None) -> DataFrame:
    """L0-ZE-SKLADOWYCH: an attribute that only the components have and the panel (attr, status) knows as active."""
    own = not_cut_off(components, cut_off).join(raw.select("id", "attr"), ["id", "attr"], "left_anti").join(F.broadcast(panel.where("status = 'ACTIVE'").select("attr").distinct()), "attr", "left_semi")
    return f.emit(own, "L0-ZE-SKLADOWYCH", "L0", f.MIDDLE, 0.90, new=F.col("value"), evidence="only among components", group=F.concat_ws("|", F.lit("L0-ZE-SKLADOWYCH"), "attr", text.norm(F.col("value"))))


def component_conflicts(components: DataFrame, raw: DataFrame, panel: DataFrame, cut_off: DataFrame | None = None) -> DataFrame:
    """L0-KONFLIKT: both places have the attribute and differ."""
    pairs = raw.join(not_cut_off(components, cut_off).select("id", "attr", F.col("value").alias("other")), ["id", "attr"]).where(text.norm(F.col("value")) != text.norm(F.col("other")))
    pairs = pairs.withColumn("d", text.difference(F.col("value"), F.col("other"))).join(F.broadcast(panel.select("attr").distinct().withColumn("known", F.lit(True))), "attr", "left")
    severity = F.when(F.col("known").isNull(), f.INFO).otherwise(F.col("d.severity"))
    group = F.concat(F.lit("L0-KONFLIKT|"), "attr", F.lit("|"), text.norm(F.col("value")), F.lit("=>"), text.norm(F.col("other")))
    return f.emit(pairs, "L0-KONFLIKT", "L0", severity, F.col("d.confidence"), old="value", new=F.col("other"), evidence=F.col("d.kind"), group=group)


def l0_summary(found: DataFrame) -> DataFrame:
    conflict = F.col("rule_id") == "L0-KONFLIKT"
    return found.where("layer = 'L0'").agg(F.count_if(~conflict).alias("to_move"), F.count_if(conflict).alias("conflicts"), F.count_if(conflict & (F.col("severity") == f.CRITICAL)).alias("critical"), F.countDistinct("grp").alias("groups"))


def side_by_side(components: DataFrame, raw: DataFrame) -> DataFrame:
    """Both places of every attribute, the differing first."""
    both = components.select("id", "attr", F.col("value").alias("component")).join(raw.select("id", "attr", F.col("value").alias("own")), ["id", "attr"], "full")
    state = F.when(F.col("own").isNull(), "only_components").when(F.col("component").isNull(), "only_attributes").when(text.norm(F.col("own")) == text.norm(F.col("component")), "equal").otherwise("differs")
    return both.withColumn("state", state).withColumn("place", F.when(F.col("state") == "differs", 0).when(F.col("state") == "only_components", 1).when(F.col("state") == "only_attributes", 2).otherwise(3))


def missing_photo(products: DataFrame) -> DataFrame:
    return f.emit(products.where(F.trim(F.coalesce("photo", F.lit(""))) == ""), "L1-BRAK-ZDJECIA", "L1", f.CRITICAL, 0.99, attr=F.lit("zdjecie"), evidence="no photo", group=F.lit("L1-BRAK-ZDJECIA"))


def junk_keys(raw: DataFrame, junk: DataFrame) -> DataFrame:
    return f.emit(raw.join(F.broadcast(junk), "attr"), "L1-KLUCZ-SMIEC", "L1", f.CRITICAL, 0.90, old="value", evidence=F.col("reason"))


def coverage(products: DataFrame, raw: DataFrame) -> DataFrame:
    """(category, attr, share, required): how many of a category's products have the attribute."""
    size = products.groupBy("category").agg(F.count("*").alias("of"))
    have = raw.where(F.trim("value") != "").select("id", "attr").distinct().join(products.select("id", "category"), "id").groupBy("category", "attr").agg(F.count("*").alias("n"))
    return have.join(size, "category").select("category", "attr", F.bround(F.col("n") / F.col("of"), 3).alias("share"), (F.col("n") / F.col("of") >= 0.90).alias("required"))


def furniture(products: DataFrame, other: DataFrame | None) -> DataFrame:
    """Products but for those of categories (category) that are no furniture, which rules learned of categories don't judge."""
    return products if other is None else products.join(other.select("category"), "category", "left_anti")


def missing_required(products: DataFrame, raw: DataFrame, covered: DataFrame, least: float = REQUIRED, non_furniture: DataFrame | None = None) -> DataFrame:
    need = furniture(products, non_furniture).select("id", "category").join(covered.where(F.col("share") >= least).select("category", "attr", "share"), "category")
    lacking = need.join(raw.where(F.trim("value") != "").select("id", "attr"), ["id", "attr"], "left_anti")
    return f.emit(lacking, "L1-BRAK-WYMAGANEGO", "L1", F.when(F.col("attr").isin(*KEY_ATTRIBUTES), f.CRITICAL).otherwise(f.MIDDLE), 0.85, evidence="its category has it", group=F.concat_ws("|", F.lit("L1-BRAK-WYMAGANEGO"), "category", "attr"))


def contradictions(values: DataFrame, conditions: DataFrame, forbidden: DataFrame) -> DataFrame:
    """conditions (rule_id, attr, value) that must all hold; forbidden (rule_id, attr) that then must not exist."""
    size = conditions.groupBy("rule_id").agg(F.count("*").alias("need"))
    hits = values.join(F.broadcast(conditions), ["attr", "value"]).groupBy("id", "rule_id").agg(F.count("*").alias("n")).join(F.broadcast(size), "rule_id").where("n = need").select("id", "rule_id")
    against = hits.join(F.broadcast(forbidden), "rule_id").join(values, ["id", "attr"])
    return f.emit(against, F.col("rule_id"), "L2", f.CRITICAL, 0.80, old="value", evidence="contradicts another attribute", group=F.concat_ws("|", "rule_id", "attr", "value"))


def name_contradictions(products: DataFrame, values: DataFrame, conditions: DataFrame, fragments: DataFrame) -> DataFrame:
    """The same against fragments (rule_id, fragment) of the normalised name."""
    size = conditions.groupBy("rule_id").agg(F.count("*").alias("need"))
    hits = values.join(F.broadcast(conditions), ["attr", "value"]).groupBy("id", "rule_id").agg(F.count("*").alias("n"), F.min("attr").alias("attr"), F.min("value").alias("value")).join(F.broadcast(size), "rule_id").where("n = need")
    named = hits.join(products.select("id", text.norm(F.col("name")).alias("n_name")), "id").join(F.broadcast(fragments), "rule_id").where(F.col("n_name").contains(text.norm(F.col("fragment"))))
    rule = F.concat("rule_id", F.lit("-NAZWA"))
    return f.emit(named, rule, "L2", f.CRITICAL, 0.75, old="value", evidence=F.col("fragment"), group=F.concat_ws("|", rule, "attr"))


def relations(nums: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (rule_id, low, high, strict): low must be at most, or under, high."""
    low = nums.select("id", F.col("attr").alias("low"), F.col("num").alias("x")).join(F.broadcast(rules), "low")
    both = low.join(nums.select("id", F.col("attr").alias("high"), F.col("num").alias("y")), ["id", "high"]).where("x > y or (strict and x = y)")
    return f.emit(both, F.col("rule_id"), "L2", f.CRITICAL, 0.85, attr=F.col("low"), old=text.number_text(F.col("x")), evidence=F.concat_ws(" ", "low", F.lit("over"), "high"), group=F.col("rule_id"))


def learn_ranges(values: DataFrame, least: int = LEAST_VALUES) -> DataFrame:
    """values (category, attr, num) → robust bounds of each (category, attr) with enough values; however large a group is, no task holds it."""
    keys = ["category", "attr"]
    large = quantiles.large_groups(values, keys, "num")
    first = quantiles.of_groups(values, keys, "num", [0.01, 0.5, 0.99], large).where(F.col("n") >= least)
    first = first if large is None else tables.written(first, "first")
    apart = values.join(first.select(*keys, F.col("p")[1].alias("median")), keys).select(*keys, F.abs(F.col("num") - F.col("median")).alias("apart"))
    spread = quantiles.of_groups(apart, keys, "apart", [0.5], large).select(*keys, F.col("p")[0].alias("mad"))
    out = first.join(spread, keys).select(*keys, "n", F.col("p")[1].alias("median"), "mad", F.col("p")[0].alias("p1"), F.col("p")[2].alias("p99"))
    low, high = F.least("p1", F.col("median") - 6 * F.col("mad")), F.greatest("p99", F.col("median") + 6 * F.col("mad"))
    return out.select(*keys, "n", F.bround("median", 2).alias("median"), F.bround("mad", 2).alias("mad"), F.bround("p1", 2).alias("p1"), F.bround("p99", 2).alias("p99"), F.bround(F.greatest(F.lit(0.0), F.when(F.col("mad") > 0, low).otherwise(F.col("p1"))), 1).alias("low"), F.bround(F.when(F.col("mad") > 0, high).otherwise(F.col("p99")), 1).alias("high"))


def with_range(rows: DataFrame, ranges: DataFrame, parents: DataFrame) -> DataFrame:
    """rows (category, attr, …) with the range of the category, else of its parent (category, parent)."""
    own = ranges.select("category", "attr", F.struct("n", "median", "p1", "p99", "low", "high").alias("own"))
    group = ranges.select(F.col("category").alias("parent"), "attr", F.struct("n", "median", "p1", "p99", "low", "high").alias("of_parent"))
    out = rows.join(parents, "category", "left").join(own, ["category", "attr"], "left").join(group, ["parent", "attr"], "left")
    return out.withColumn("range", F.coalesce("own", "of_parent")).drop("own", "of_parent", "parent")


def out_of_range(rows: DataFrame, non_furniture: DataFrame | None = None) -> DataFrame:
    """L2-SKALA where a change of unit lands in the middle, else L2-OUTLIER. rows come from with_range()."""
    v, r = F.col("num"), F.col("range")
    out = furniture(rows, non_furniture).where(r.isNotNull() & ((v < r["low"]) | (v > r["high"])))
    far = (v > r["high"] * SCALE_MARGIN) | (v < r["low"] / SCALE_MARGIN)
    tries = F.filter(F.array(*(F.struct((v * k).alias("v"), F.lit(name).alias("name")) for k, name in SCALES)), lambda s: s["v"].between(r["p1"], r["p99"]))
    out = out.withColumn("fit", F.when(far, F.get(tries, F.lit(0))))
    scaled = F.col("fit").isNotNull()
    group = F.when(scaled, F.concat_ws("|", F.lit("L2-SKALA"), "attr", "fit.name")).otherwise(F.concat_ws("|", F.lit("L2-OUTLIER"), "category", "attr"))
    return f.emit(out, F.when(scaled, "L2-SKALA").otherwise("L2-OUTLIER"), "L2", F.when(scaled, f.CRITICAL).otherwise(f.MIDDLE), F.when(scaled, 0.88).otherwise(0.55), old=text.number_text(v), new=F.when(scaled, text.number_text(F.bround("fit.v", 1))), evidence="out of its category's range", group=group)


def named_parts(products: DataFrame) -> DataFrame:
    """(id, part, attr, count) that names tell, and part has_drawers with count 1."""
    said = products.select("id", text.part_counts(F.col("name")).alias("c"))
    rows = [F.struct(F.lit(p).alias("part"), F.lit(a).alias("attr"), F.col(f"c.{p}").cast("int").alias("count")) for p, a in PART_ATTRIBUTES.items()]
    rows.append(F.struct(F.lit("has_drawers").alias("part"), F.lit(PART_ATTRIBUTES["drawers"]).alias("attr"), F.when(F.col("c.has_drawers"), 1).cast("int").alias("count")))
    return said.select("id", F.inline(F.filter(F.array(*rows), lambda x: x["count"].isNotNull())))


def name_against_counts(products: DataFrame, values: DataFrame, labels: DataFrame) -> DataFrame:
    """L2-NAZWA-ROZJAZD and L2-NAZWA-UZUPELNIA for countable parts. labels: (attr, count, label)."""
    rows = named_parts(products).join(values.select("id", "attr", "value"), ["id", "attr"], "left").join(labels, ["attr", "count"], "left")
    some = F.col("part") == "has_drawers"
    held = text.count_in_label(F.col("value"))
    more = text.norm(F.col("value")).contains("wiecej") & (F.col("count") >= held)
    none = some & (F.col("value") == "bez szuflad")
    gap = ~some & F.col("value").isNull()
    differs = ~some & held.isNotNull() & (held != F.col("count")) & ~more
    rows = rows.withColumn("case", F.when(none, "none").when(gap, "gap").when(differs, "differs")).where("case is not null")
    rule = F.when(F.col("case") == "gap", "L2-NAZWA-UZUPELNIA").otherwise("L2-NAZWA-ROZJAZD")
    sure = F.when(F.col("case") == "none", 0.80).when(F.col("case") == "gap", 0.70).otherwise(0.78)
    return f.emit(rows, rule, "L2", F.when(F.col("case") == "gap", f.MIDDLE).otherwise(f.CRITICAL), sure, old="value", new=F.when(F.col("case") != "none", F.col("label")), evidence="the name says so", group=F.concat_ws("|", rule, "attr", F.when(F.col("case") == "none", "bez")))


def name_against_sizes(products: DataFrame, nums: DataFrame) -> DataFrame:
    """L2-NAZWA-WYMIAR and L2-NAZWA-UZUPELNIA for dimensions and diameters in names."""
    wide = nums.groupBy("id").pivot("attr", ["Szerokość", "Głębokość", "Wysokość", "Średnica", "Szerokość powierzchni spania", "Długość powierzchni spania"]).agg(F.first("num"))
    rows = products.select("id", "category", text.dimensions(F.col("name")).alias("d")).join(wide, "id", "left")
    off = lambda c, by: ~F.coalesce((F.abs(F.col(c) - F.col("d.a")) <= by) | (F.abs(F.col(c) - F.col("d.b")) <= by), F.lit(False))
    bed, sized = F.col("category").isin(*SLEEPING), F.col("d.a").isNotNull()
    width, bed_width = F.col("Szerokość"), F.col("Szerokość powierzchni spania")
    least = F.least("d.a", "d.b")
    case = lambda when, attr, rule, sure, old, new, group: F.when(when, F.struct(F.lit(attr).alias("attr"), F.lit(rule).alias("rule"), F.lit(sure).alias("sure"), old.cast("string").alias("old"), new.cast("string").alias("new"), F.lit(group).alias("group")))
    null = F.lit(None).cast("string")
    cases = [
        case(sized & bed & bed_width.isNotNull() & off("Szerokość powierzchni spania", 2), "Szerokość powierzchni spania", "L2-NAZWA-WYMIAR", 0.65, text.number_text(bed_width), text.number_text(least), "L2-NAZWA-WYMIAR|spanie-szer"),
        case(sized & bed & bed_width.isNull() & F.col("Długość powierzchni spania").isNull(), "Szerokość powierzchni spania", "L2-NAZWA-UZUPELNIA", 0.72, null, text.number_text(least), "L2-NAZWA-UZUPELNIA|spanie"),
        case(sized & ~bed & width.isNotNull() & off("Szerokość", 3) & off("Głębokość", 3) & off("Wysokość", 3), "Szerokość", "L2-NAZWA-WYMIAR", 0.62, text.number_text(width), null, "L2-NAZWA-WYMIAR|wymiar"),
        case(F.col("d.diameter").isNotNull() & F.col("Średnica").isNull(), "Średnica", "L2-NAZWA-UZUPELNIA", 0.80, null, text.number_text(F.col("d.diameter")), "L2-NAZWA-UZUPELNIA|Średnica"),
    ]
    found = rows.select("id", F.explode(F.array_compact(F.array(*cases))).alias("x")).select("id", "x.*")
    return f.emit(found, F.col("rule"), "L2", f.MIDDLE, F.col("sure"), old="old", new=F.col("new"), evidence="the name says so", group=F.col("group"))


def family_outliers(products: DataFrame, values: DataFrame, family: list[Column] | None = None, attrs: tuple[str, ...] = FAMILY_ATTRIBUTES, size: int = FAMILY_SIZE, share: float = FAMILY_SHARE) -> DataFrame:
    """L2-RODZINA: members of a family that differ from its dominant value."""
    base = text.base_name(F.col("name"))
    family = family or [F.col("producer"), F.col("collection"), base]
    keyed = products.where(base != "").select("id", base.alias("base"), F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in family))).alias("family"))
    own = values.where(F.col("attr").isin(*attrs) & (F.trim("value") != "")).join(keyed, "id")
    counts = own.groupBy("family", "attr", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("family", "attr").agg(F.sum("n").alias("of"), F.count("*").alias("kinds"), F.max_by("value", F.struct("n", "value")).alias("common"), F.max("n").alias("most")).where((F.col("of") >= size) & (F.col("kinds") >= 2) & (F.col("most") >= share * F.col("of")))
    odd = own.join(top, ["family", "attr"]).where("value <> common")
    return f.emit(odd, "L2-RODZINA", "L2", f.MIDDLE, 0.72, old="value", new=F.col("common"), evidence=F.concat_ws(" of ", F.col("most").cast("string"), F.col("of").cast("string")), group=F.concat_ws("|", F.lit("L2-RODZINA"), "attr", "base"))


def duplicates(products: DataFrame, nums: DataFrame, shown: int = 6) -> DataFrame:
    """L2-DUPLIKAT: products of one producer and name whose numbers are all alike. The group is aggregated, its ids are cut to those shown."""
    numbers = nums.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("attr", "num")))).alias("numbers"))
    keyed = products.join(numbers, "id", "left").select("id", "producer", text.norm(F.col("name")).alias("named"), F.coalesce("numbers", F.lit("[]")).alias("numbers"))
    groups = keyed.groupBy("producer", "named").agg(F.count("*").alias("n"), F.min("numbers").alias("low"), F.max("numbers").alias("high")).where("n >= 2 and low = high")
    place = Window.partitionBy("producer", "named").orderBy("id")
    same = keyed.join(groups, ["producer", "named"]).withColumn("place", F.row_number().over(place))
    first = same.where(F.col("place") <= shown).groupBy("producer", "named").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))
    rows = same.join(first, ["producer", "named"])
    return f.emit(rows, "L2-DUPLIKAT", "L2", f.INFO, 0.50, attr=F.lit("nazwa"), evidence=F.col("ids"), group=F.concat_ws("|", F.lit("L2-DUPLIKAT"), "producer", "named"))


def category_of_name(names: DataFrame, rules: DataFrame, unknown: str = "nieznana") -> DataFrame:
    """names (name) and ordered rules (priority, key, pattern): the first pattern that a name matches. Distinct names only."""
    own = names.select("name").distinct().withColumn("n", text.norm(F.col("name")))
    hit = own.join(F.broadcast(rules), F.expr("n rlike concat('\\\\b', pattern)")).groupBy("name").agg(F.min_by("key", "priority").alias("key"))
    return own.join(hit, "name", "left").select("name", F.coalesce("key", F.lit(unknown)).alias("category"))


def with_category(products: DataFrame, types: DataFrame, rules: DataFrame, unknown: str = "nieznana") -> DataFrame:
    """products (name, type, …) with category and category_source: of the shop's type (type, key), else of the name. Names and types are looked up once each."""
    known = types.select(text.norm(F.col("type")).alias("__t"), F.col("key").alias("__by_type")).groupBy("__t").agg(F.min("__by_type").alias("__by_type"))
    named = category_of_name(products, rules, unknown).select(F.col("name").alias("__name"), F.col("category").alias("__by_name"))
    rows = products.drop("category", "category_source").withColumn("__t", text.norm(F.col("type")))
    rows = rows.join(known, "__t", "left").join(named, F.col("name") == F.col("__name"), "left")
    source = F.when(F.col("__by_type").isNotNull(), "sklep").when(F.col("__t") != "", "sklep_niezmapowany").otherwise("nazwa")
    category = F.coalesce("__by_type", "__by_name", F.lit(unknown))
    return rows.withColumns({"category": category, "category_source": source}).drop("__t", "__by_type", "__name", "__by_name")


def assign_category(products: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """products (id, name, type) → id, category, source."""
    return with_category(products, types, rules).select("id", "category", F.col("category_source").alias("source"))


def assemble(layer0: list[DataFrame], others: list[DataFrame], gaps: DataFrame, disabled_rules: DataFrame, disabled_attrs: DataFrame) -> DataFrame:
    """All findings: switched-off rules and attributes go, but not from layer 0; a gap in a cell that layer 0 covers goes."""
    zero = f.union(layer0).select(*f.COLUMNS)
    rest = f.without(f.union(others), disabled_rules, disabled_attrs)
    open_gaps = f.without(gaps, disabled_rules, disabled_attrs).join(zero.select("id", "attr").distinct(), ["id", "attr"], "left_anti")
    return zero.unionByName(rest).unionByName(open_gaps.select(*f.COLUMNS))


def with_category_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """names (category, shown, furniture): the display name and whether it is furniture; unknown categories show themselves."""
    return rows.join(F.broadcast(names), "category", "left").withColumns({"shown": F.coalesce("shown", "category"), "furniture": F.coalesce("furniture", F.lit(True))})
