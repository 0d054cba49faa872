"""Scans of catalogue exports and feeds, and sinks. Everything ends in a DataFrame; feeds in long form (source, rec, field, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.sources import log

# Header spellings, the first present one counts; code columns; names that label a value in XML.
ALIASES = {
    "id": ("id",), "name": ("nazwa", "name"), "producer": ("producent", "manufacturer"), "collection": ("kolekcja",), "photo": ("zdjecie",), "style": ("style",),
    "type": ("typ", "kategoria", "kategorie", "category", "kategoria_glowna"), "subtype": ("podtyp", "subtype"), "photos": ("zdjecia", "zdjęcia", "images"),
    "attributes": ("atrybuty",), "components": ("atrybuty-skladowe", "atrybuty-składowe", "atrybuty skladowe", "atrybuty z zakladki", "atrybuty z zakładki", "atrybuty skladowych"),
    "cut_off": ("omit_components_in_attributes",),
}
CODES = ("kod produktu", "kod producenta", "kod ean", "nasz kod ean", "unikatowy kod produktu", "sku", "ean")
LABELLING = ("name", "nazwa", "key", "klucz", "code", "kod", "id", "attribute")


def resolve(columns: list[str]) -> dict[str, str]:
    """Our names → the columns that stand for them."""
    low = {c.strip().lower().lstrip("﻿"): c for c in columns}
    return {ours: next(low[a] for a in names if a in low) for ours, names in ALIASES.items() if any(a in low for a in names)}


def separator(spark: SparkSession, path: str, size: int = 4096) -> str:
    """';' if the file's first `size` signs have more of them than ','. Of a folder, any of its files is looked at."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(200).collect())[:size]
    return ";" if head.count(";") > head.count(",") else ","


def read_side_file(spark: SparkSession, path: str) -> DataFrame:
    """A side file of types, whichever separator it has."""
    return spark.read.csv(path, sep=separator(spark, path), header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_csv_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A feed as long rows; the separator is looked for in its first 8 KB, signs that are no UTF-8 are replaced."""
    return long_form(spark.read.csv(path, sep=separator(spark, path, 8192), header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"), source)


def catalogue(rows: DataFrame) -> DataFrame:
    """Export rows (all strings) as products: maps of attributes and components, codes, gallery, completeness. Rows without id go."""
    at = resolve(rows.columns)
    c = lambda name: F.trim(F.col(f"`{at[name]}`")) if name in at else F.lit(None).cast("string")
    as_map = lambda x: F.map_from_entries(text.packed(x))
    codes = [(k, v) for k, v in ((x.strip().lower(), x) for x in rows.columns) if k in CODES]
    code_map = F.map_filter(F.create_map(*(z for k, v in codes for z in (F.lit(k), F.trim(F.col(f"`{v}`"))))), lambda k, v: v != "") if codes else F.create_map().cast("map<string,string>")
    out = rows.select(
        c("id").alias("id"), *(c(n).alias(n) for n in ("name", "producer", "collection", "photo", "style", "type", "subtype")), code_map.alias("codes"),
        text.gallery(c("photos")).alias("photos"), as_map(c("attributes")).alias("attributes"), as_map(c("components")).alias("components"), F.coalesce(c("cut_off").isin("1", "true", "True"), F.lit(False)).alias("cut_off"),
    )
    return out.where("id is not null and id <> ''").withColumn("completeness", text.completeness(F.col("attributes")))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return catalogue(spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"))


def with_side_file(products: DataFrame, side: DataFrame) -> DataFrame:
    """Type and subtype from a side file (short_id or id, type, subtype) where the export has none."""
    key = "short_id" if "short_id" in side.columns else "id"
    s = side.select(F.trim(F.col(key)).alias("id"), F.col("type").alias("s_type"), F.col("subtype").alias("s_subtype")).groupBy("id").agg(F.max(F.struct("s_type", "s_subtype")).alias("s")).select("id", "s.*")
    fill = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), b)
    return products.join(s, "id", "left").withColumns({"type": fill("type", F.col("s_type")), "subtype": fill("subtype", F.col("s_subtype"))}).drop("s_type", "s_subtype")


def long_form(rows: DataFrame, source: str) -> DataFrame:
    """Feed rows of strings as long rows; rec in the order of reading."""
    fields = [c for c in rows.columns]
    numbered = rows.withColumn("__rec", F.monotonically_increasing_id())
    cells = F.array(*(F.struct(F.lit(c.strip()).alias("field"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for c in fields))
    return numbered.select(F.lit(source).alias("source"), F.col("__rec").alias("rec"), F.inline(cells))


def with_format(files: DataFrame) -> DataFrame:
    """files (path, content, …) with format: by the first sign that isn't blank, else by the name."""
    head = F.ltrim(F.replace(F.replace(F.replace(F.substring("content", 1, 200).cast("string"), F.lit("\ufeff"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    name = F.lower("path")
    return files.withColumn("format", F.when(head.startswith("<"), "xml").when(head.rlike(r"^[\[{]"), "json").when(name.endswith(".xml"), "xml").when(name.endswith(".json"), "json").otherwise("csv"))


def sniff(files: DataFrame) -> DataFrame:
    """files (path, content) → (path, format)."""
    return with_format(files).select("path", "format")


def json_records(docs: DataFrame) -> DataFrame:
    """docs (source, json): a list at the top, or the longest list of an object's values → long rows."""
    v = F.try_parse_json("json")
    lists = F.transform(F.map_values(F.from_json("json", "map<string,string>")), lambda x: F.from_json(x, "array<map<string,string>>"))
    longest = F.reduce(lists, F.array().cast("array<map<string,string>>"), lambda a, b: F.when(F.size(b) > F.size(a), b).otherwise(a))
    top = F.from_json("json", "array<map<string,string>>")
    records = docs.where(v.isNotNull()).select("source", F.posexplode(F.when(F.ltrim("json").startswith("["), top).otherwise(longest)).alias("rec", "r"))
    return records.select("source", F.col("rec").cast("long").alias("rec"), F.explode("r").alias("field", "value")).select("source", "rec", "field", F.coalesce("value", F.lit("")).alias("value"))


def xml_elements(docs: DataFrame) -> DataFrame:
    """docs (doc, xml) → every element: (doc, elem, parent, depth, tag, text). A document that can't be parsed gives none."""
    schema = pa.schema([("doc", pa.string()), ("elem", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("tag", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = []
            for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    stack = [(ET.fromstring(xml or ""), -1, 0)]
                except (ET.ParseError, ValueError):
                    continue
                n = 0
                while stack:
                    e, parent, depth = stack.pop()
                    rows.append((doc, n, parent, depth, e.tag, (e.text or "").strip()))
                    stack += [(child, n, depth + 1) for child in reversed(e)]
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc").cast("string"), F.col("xml").cast("string")).mapInArrow(run, "doc string, elem long, parent long, depth int, tag string, text string")


def record_tag(elements: DataFrame) -> DataFrame:
    """Of each document: the shallowest tag that one parent repeats; of several the most numerous."""
    repeated = elements.where("depth > 0").groupBy("doc", "parent", "depth", "tag").agg(F.count("*").alias("n")).where("n >= 2").groupBy("doc", "depth", "tag").agg(F.sum("n").alias("n"))
    return repeated.groupBy("doc").agg(F.min_by("tag", F.struct("depth", -F.col("n"), "tag")).alias("tag"))


def flatten(e, prefix: str, out: dict) -> None:
    """What an XML element holds, by paths, into out: names without namespaces."""
    local = lambda tag: tag.rpartition("}")[2]
    seen: dict[str, int] = {}
    for child in e:
        label = next((child.get(a) for a in LABELLING if child.get(a)), None) if len(child) == 0 else None
        name = f"{local(child.tag)}:{label.strip()}" if label else local(child.tag)
        seen[name] = seen.get(name, 0) + 1
        path = (f"{prefix}." if prefix else "") + name + (f"[{seen[name]}]" if seen[name] > 1 else "")
        out.update({f"{path}@{local(k)}": v.strip() for k, v in child.attrib.items() if not (label and k in LABELLING)})
        if len(child):
            flatten(child, path, out)
        else:
            out[path] = (child.text or "").strip()


def xml_records(docs: DataFrame, tag: str) -> DataFrame:
    """docs (source, xml) → long rows of the elements named tag: paths 'a.b', attributes 'a@k', repeats 'a[2]', and 'a:Name' for leaves with a naming attribute.

    A document that can't be parsed gives one row: rec -1, field '!error', and the parser's message.
    """
    schema = pa.schema([("source", pa.string()), ("rec", pa.int64()), ("field", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = []
            for source, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = ET.fromstring(xml or "").iter(tag)
                except (ET.ParseError, ValueError) as e:
                    rows.append((source, -1, "!error", str(e)))
                    continue
                for rec, e in enumerate(found):
                    own = {f"@{k}": v.strip() for k, v in e.attrib.items()}
                    flatten(e, "", own)
                    rows += [(source, rec, k, v) for k, v in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("source").cast("string"), F.col("xml").cast("string")).mapInArrow(run, "source string, rec long, field string, value string")


def sheet_kind(cells: DataFrame, looked_at: int = 200) -> DataFrame:
    """cells (tab, row_no, cells array) → what a tab's first column mostly holds in its first filled rows: xml, json or table."""
    rows = cells.select("tab", "row_no", F.trim(F.get("cells", F.lit(0))).alias("a")).where("a <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("tab").orderBy("row_no"))).where(F.col("k") <= looked_at)
    return rows.groupBy("tab").agg(F.avg(F.col("a").startswith("<").cast("int")).alias("x"), F.avg(F.col("a").startswith("{").cast("int")).alias("j")).select("tab", F.when(F.col("x") > 0.5, "xml").when(F.col("j") > 0.5, "json").otherwise("table").alias("kind"))


def sheet_records(cells: DataFrame) -> DataFrame:
    """Table tabs as long rows: the first row names the fields, short rows are filled up, blank rows left out."""
    head = cells.groupBy("tab").agg(F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("first"))
    rows = cells.join(F.broadcast(head), "tab").where("row_no > first").where(F.exists("cells", lambda x: F.trim(x) != ""))
    pairs = F.transform("head", lambda h, i: F.struct(F.trim(h).alias("field"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")))
    return rows.select(F.col("tab").alias("source"), F.col("row_no").cast("long").alias("rec"), F.inline(F.filter(pairs, lambda p: p["field"] != "")))


def mined(long: DataFrame) -> DataFrame:
    """Feed rows with those that descriptions hold: 'field » name'."""
    more = long.withColumn("m", text.described_fields(F.col("value"))).select("source", "rec", F.col("field").alias("of"), F.inline("m"))
    return long.unionByName(more.select("source", "rec", F.concat_ws(" » ", "of", "field").alias("field"), "value"))


def save_run(products: DataFrame | None, findings: DataFrame, folder: str, run_id: int) -> DataFrame:
    """Products (None: saved already) and findings as a run's partitions, replacing what an earlier attempt at the run left; returns the findings as saved. log.Runs.commit() makes the run count."""
    runs = log.Runs(findings.sparkSession, folder)
    if products is not None:
        runs.save(products, "products", run_id)
    return runs.save(findings.withColumn("old_hash", text.value_hash(F.col("old_value"))), "findings", run_id)


def save_csv(rows: DataFrame, path: str) -> None:
    """';'-separated, with cells that no spreadsheet takes for formulas."""
    rows.select(*(text.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes)).write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"')
