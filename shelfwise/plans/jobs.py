"""Jobs that chain the operators: learn ranges, import a snapshot, ask about photos, calibrate, seed filters, recognise feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import analytics, decisions, detect, dictionary, feeds, gaps, maintenance, photos, tree
from shelfwise.operators import findings as fs
from shelfwise.sources import log, readers, tables


def long_attributes(products: DataFrame) -> DataFrame:
    return products.select("id", F.explode("attributes").alias("attr", "value"))


def learn_ranges(products: DataFrame, nums: DataFrame, parents: DataFrame, folder: str) -> DataFrame:
    """Ranges of categories and of their parents (category, parent), written and read back."""
    values = nums.join(products.select("id", "category"), "id").select("category", "attr", "num")
    up = values.join(F.broadcast(parents), "category").select(F.col("parent").alias("category"), "attr", "num")
    detect.learn_ranges(values).unionByName(detect.learn_ranges(up)).write.mode("overwrite").parquet(f"{folder}/ranges")
    return products.sparkSession.read.parquet(f"{folder}/ranges")


def find_all(products: DataFrame, raw: DataFrame, components: DataFrame, long: DataFrame, cells: DataFrame, config: dict[str, DataFrame], folder: str, least: float = detect.REQUIRED, family: list | None = None) -> DataFrame:
    """Layers 0 to 2 and the gaps. long and cells come from dictionary.normalise(); long is a written table.

    Ranges and coverage are learned over all rows; detectors then leave out products with too little data, layer 0 does
    not. Where filters are known, a missing filter is a gap and no L1-BRAK-WYMAGANEGO; switched-off rules go before gaps
    are reconciled, so that they take no cell from others. The findings of each detector are written by a job of its own:
    one plan of all took the driver hundreds of MB.

    config: dictionary, panel, junk, disabled_rules, disabled_attrs; and where there are any: parents (category, parent),
    non_furniture (category), conditions, forbidden, fragments, relations, node_filters, category_filters, subtypes,
    names, reads, optional (attr).
    """
    spark = products.sparkSession
    for name in ("subtype", "collection", "node"):
        products = products if name in products.columns else products.withColumn(name, F.lit(None).cast("string"))
    cut_off = products.where("cut_off").select("id") if "cut_off" in products.columns else None
    zero = [tables.gathered([detect.moved_components(components, raw, config["panel"], cut_off), detect.component_conflicts(components, raw, config["panel"], cut_off)], "layer-0")]
    parents = config.get("parents")
    parents = products.select("category").limit(0).withColumn("parent", F.col("category")) if parents is None else parents
    ranges = learn_ranges(products, long.where("num is not null").select("id", "attr", "num"), parents, folder)
    covered = detect.coverage(products, raw)

    some = tables.written(detect.analysed(products, long.select("id", "attr", F.col("norm").alias("value"))), "analysed")
    ids = some.select("id")
    long = tables.written(long.join(ids, "id", "left_semi"), "analysed-attributes")
    raw = raw.join(ids, "id", "left_semi")
    nums, norm = long.where("num is not null").select("id", "attr", "num"), long.select("id", "attr", F.col("norm").alias("value"))
    furniture = detect.furniture(some, config.get("non_furniture"))
    required = detect.missing_required(furniture, raw, covered, least)
    labels = dictionary.enum_label(detect.named_parts(some), config["dictionary"])
    ranged = detect.with_range(nums.join(furniture.select("id", "category"), "id"), ranges, parents)
    others = [cells.join(ids, "id", "left_semi"), detect.missing_photo(some), detect.junk_keys(raw, config["junk"]), detect.out_of_range(ranged), detect.name_against_counts(some, norm, labels), detect.name_against_sizes(some, nums), detect.family_outliers(some, norm, family), detect.duplicates(some, nums)]
    if config.get("conditions") is not None:
        if config.get("forbidden") is not None:
            others.append(detect.contradictions(norm, config["conditions"], config["forbidden"]))
        if config.get("fragments") is not None:
            others.append(detect.name_contradictions(some, norm, config["conditions"], config["fragments"]))
    if config.get("relations") is not None:
        others.append(detect.relations(nums, config["relations"]))

    filters = [config.get("node_filters"), config.get("category_filters")]
    if filters[0] is None and filters[1] is None:
        existing = tables.gathered([fs.without(x) for x in (*others, required)], "existing")
        return detect.assemble(zero, [existing], existing.where("false"), config["disabled_rules"], config["disabled_attrs"])
    by_node = spark.createDataFrame([], "node string, attr string") if filters[0] is None else filters[0]
    by_category = spark.createDataFrame([], "category string, attr string") if filters[1] is None else filters[1]
    values = tables.written(gaps.effective(norm, detect.not_cut_off(components.join(ids, "id", "left_semi"), cut_off)), "effective")
    own = tables.written(gaps.cells(some, by_node, by_category, values), "filter-cells")
    proposed = gaps.candidates(some, own, values, config["dictionary"].select("attr", "label"), subtypes=config.get("subtypes"), names=config.get("names"), reads=config.get("reads"))
    best = tables.written(gaps.best(proposed, config["disabled_rules"]), "gaps")
    optional = spark.createDataFrame([], "attr string") if config.get("optional") is None else config["optional"]
    missing = tables.gathered([fs.without(gaps.grouped(x, some), config["disabled_rules"]) for x in (best, gaps.remaining(own, values, best, optional))], "missing")
    existing = tables.gathered([fs.without(x, config["disabled_rules"]) for x in (*others, required.join(own, ["id", "attr"], "left_anti"))], "existing")
    existing, missing = gaps.reconcile(existing, missing)
    return detect.assemble(zero, [existing], missing, config["disabled_rules"], config["disabled_attrs"])


def prepared(products: DataFrame, config: dict[str, DataFrame]) -> DataFrame:
    """Scanned products with type and subtype of the side file where they have none, and with category and node.

    config: types (type, key) and name_rules (priority, key, pattern); where there are any: side, and nodes with
    pair_aliases, type_aliases and excluded. An id that the file repeats counts once, by its last row as text orders them.
    The file is read once: what is scanned is written before anything is made of it.
    """
    if config.get("side") is not None:
        products = readers.with_side_file(products, config["side"])
    products = tables.written(products, "scanned")
    repeated = tables.written(products.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not repeated.isEmpty():
        names = [c for c in products.columns if c != "id"]
        one = F.max_by(F.struct(*names), F.struct("name", F.to_json(F.struct(*names)))).alias("one")
        twice = products.join(repeated, "id", "left_semi").groupBy("id").agg(one).select("id", "one.*")
        products = tables.gathered([products.join(repeated, "id", "left_anti"), twice], "single")
    products = detect.with_category(products, config["types"], config["name_rules"])
    if config.get("nodes") is not None:
        products = tree.with_node(products, config["nodes"], config["pair_aliases"], config["type_aliases"], config["excluded"])
    return products


def import_products(scanned: DataFrame, config: dict[str, DataFrame], folder: str, run_id: int) -> DataFrame:
    """A scanned file (readers.catalogue) as a run, from category and node to verification; returns its report.

    A run that is committed is left as it is, so a batch may come again; what a run that broke off left is replaced.
    """
    runs = log.Runs(scanned.sparkSession, folder)
    if not runs.done(run_id):
        products = runs.save(prepared(scanned, config), "products", run_id)
        components = products.select("id", F.explode("components").alias("attr", "value"))
        run_snapshot(products, components, config, folder, run_id, True)
    return analytics.report(runs.table("findings", run_id))


def run_snapshot(products: DataFrame, components: DataFrame, config: dict[str, DataFrame], folder: str, run_id: int, products_saved: bool = False) -> DataFrame:
    """Normalise, detect, assemble, compare with feeds, save, verify and commit; returns the report.

    config: kinds, aliases, and what find_all() takes; and where there are any: votes (id, attr, source, num, method) of matched
    feeds, which add layer 4 and close the gaps that they fill; decisions, batches (batch_id, created), withdrawn (batch_id)
    and taken_at (one row), by which sent corrections are looked up in this snapshot: their states go to the folder too.
    """
    runs = log.Runs(products.sparkSession, folder)
    if runs.done(run_id):
        return analytics.report(runs.table("findings", run_id))
    raw = tables.written(long_attributes(products), "raw")
    long, cells = dictionary.normalise_by_kind(raw, config["kinds"], config["dictionary"], config["aliases"])
    long, cells = tables.written(long, "attributes"), tables.gathered(cells, "cells")
    found = find_all(products, raw, components, long, cells, config, f"{tables.shared_dir(products.sparkSession)}/find-{uuid.uuid4().hex}")
    if config.get("votes") is not None:
        agreed = tables.written(feeds.consensus(config["votes"].join(products.select("id"), "id", "left_semi")), "consensus")
        compared, conflicts = feeds.compare(agreed, long.where("num is not null").select("id", "attr", "num"), raw)
        found = feeds.append(found, compared.select(*found.columns))
        runs.save(conflicts, "conflicts", run_id)
    saved = readers.save_run(None if products_saved else products, found, folder, run_id)
    if config.get("decisions") is not None:
        taken_at = F.lit(config["taken_at"].first()[0])
        runs.save(decisions.verify(config["decisions"], config["batches"], config["withdrawn"], products, raw, taken_at), "verified", run_id)
    runs.commit(run_id, findings=saved.count())
    return analytics.report(saved)


def photo_round(findings: DataFrame, products: DataFrame, verdicts: DataFrame, cache: DataFrame, model: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Whom to ask now: (answered from the cache, to ask)."""
    chosen = photos.candidates(findings, products, verdicts, limit=limit)
    return photos.reuse(chosen.select("id", "attr", F.col("photo").alias("url"), F.col("attr").alias("question"), F.lit("").alias("value")), cache, model)


def calibrate(sheet: DataFrame) -> DataFrame:
    return photos.calibration(sheet)


def seed_filters(measured: DataFrame, categories: DataFrame, folder: str) -> DataFrame:
    maintenance.filter_seed(measured, categories)[0].write.mode("overwrite").parquet(f"{folder}/filters")
    return measured.sparkSession.read.parquet(f"{folder}/filters")


def recognise_feeds(long: DataFrame, index: DataFrame, products: DataFrame, matches: DataFrame, key_rec: DataFrame, nums: DataFrame) -> DataFrame:
    """Tabs worth a source, all in one job."""
    fields = feeds.assign_fields(feeds.numeric_fields(long, matches, key_rec, nums))
    return feeds.recommended(feeds.recognise(long, index, products), fields)
