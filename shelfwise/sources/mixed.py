"""Feeds of any format in one scan: files of a folder and tabs of sheets become one long table (source, rec, field, value).

The format is sniffed natively and routes each document; one Arrow function reads documents of all formats and sends records
on while it reads, so a document's rows are never all in memory. XML is pulled twice: once to find the shallowest tag that
a parent repeats, once for its elements. A document that can't be read ends in one row: rec -1, field '!error', and why.

Defined results: empty documents and those without records are errors, as is a JSON document without a list; records
before a fault stay; fields without a name are left out; null values are empty; other columns play no part.
"""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources import readers

ROWS = 1 << 13
_LONG = pa.schema([("source", pa.string()), ("rec", pa.int64()), ("field", pa.string()), ("value", pa.string())])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def record_tag(content: bytes) -> str | None:
    """The shallowest tag that one parent repeats; of several the most numerous. Elements are forgotten as they end; of a document that breaks off, what came before counts."""
    import xml.etree.ElementTree as ET

    found: Counter = Counter()
    inside: list[Counter] = [Counter()]  # by depth, the children of the elements that are open

    def close(depth: int, children: Counter) -> None:
        for tag, n in children.items():
            if n > 1:
                found[depth, tag] += n

    try:
        for event, e in ET.iterparse(io.BytesIO(content), ("start", "end")):
            if event == "start":
                inside[-1][_local(e.tag)] += 1
                inside.append(Counter())
            else:
                close(len(inside) - 1, inside.pop())
                e.clear()
    except ET.ParseError:
        for depth, children in enumerate(inside):
            close(depth, children)
        if not found:
            raise
    return min(found, key=lambda k: (k[0], -found[k], k[1]))[1] if found else None


def _xml(content: bytes) -> Iterator[dict]:
    import xml.etree.ElementTree as ET

    tag, held = record_tag(content), 0
    if tag is None:
        raise ValueError("no element is repeated")
    for event, e in ET.iterparse(io.BytesIO(content), ("start", "end")):
        mine = _local(e.tag) == tag
        if event == "start":
            held += mine
            continue
        if mine:
            out = {f"@{_local(k)}": v.strip() for k, v in e.attrib.items()}
            readers.flatten(e, "", out)
            yield out
            held -= 1
        if not held:
            e.clear()


def _json(content: bytes) -> Iterator[dict]:
    held = json.loads(content.decode("utf-8-sig", "replace"))
    if isinstance(held, dict):
        held = max((v for v in held.values() if isinstance(v, list)), key=len, default=None)
    if not isinstance(held, list):
        raise ValueError("there is no list of records")
    for r in held:
        if isinstance(r, dict):
            yield {k: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()}


def _csv(content: bytes) -> Iterator[dict]:
    text = content.decode("utf-8-sig", "replace")
    head = text[:8192]
    for r in csv.DictReader(io.StringIO(text), delimiter=";" if head.count(";") > head.count(",") else ","):
        yield {k.strip(): (v or "").strip() for k, v in r.items() if k and isinstance(v, str | None)}


READERS = {"xml": _xml, "json": _json, "csv": _csv}


def _rows(source: str, kind: str, content: bytes) -> Iterator[tuple]:
    rec = -1
    try:
        for rec, record in enumerate(READERS[kind](content or b"")):
            yield from ((source, rec, k, v) for k, v in record.items() if k)
        if rec < 0:
            raise ValueError("there are no records")
    except (SyntaxError, ValueError, csv.Error, RecursionError) as e:  # ParseError is a SyntaxError
        yield source, -1, "!error", str(e)


def records(documents: DataFrame) -> DataFrame:
    """documents (source, format, content) → (source, rec, field, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for source, kind, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for row in _rows(source, kind, content):
                    held.append(row)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _LONG.types, strict=True)], schema=_LONG)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _LONG.types, strict=True)], schema=_LONG)

    return documents.select("source", "format", "content").mapInArrow(run, "source string, rec long, field string, value string")


def files(spark: SparkSession, folder: str, source: str = r"([^/]+?)(?:\.[A-Za-z]+)?$") -> DataFrame:
    """Documents of all files below a folder; `source` takes the source's name out of the path."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return readers.with_format(held).select(F.regexp_extract("path", source, 1).alias("source"), "format", "content")


def tabs(cells: DataFrame) -> DataFrame:
    """Documents of XML and JSON tabs, whose first column holds a piece of it in each row. cells: (tab, row_no, cells array). Table tabs are for readers.sheet_records()."""
    kinds = readers.sheet_kind(cells).where("kind in ('xml', 'json')")
    first = cells.select("tab", "row_no", F.trim(F.get("cells", F.lit(0))).alias("piece")).where("piece <> ''").join(kinds, "tab")
    whole = first.groupBy("tab", "kind").agg(F.array_sort(F.collect_list(F.struct("row_no", "piece"))).alias("rows"))
    pieces = F.transform("rows", lambda r: r["piece"])
    as_xml = F.concat(F.lit("<tab>"), F.regexp_replace(F.array_join(pieces, "\n"), r"<\?xml[^>]*\?>", ""), F.lit("</tab>"))
    as_json = F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]"))
    return whole.select(F.col("tab").alias("source"), F.col("kind").alias("format"), F.encode(F.when(F.col("kind") == "xml", as_xml).otherwise(as_json), "UTF-8").alias("content"))


def scan(documents: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Everything in one long table, with what descriptions hold: documents of files(), and all tabs of sheets."""
    long = records(documents if cells is None else documents.unionByName(tabs(cells)))
    if cells is not None:
        table = readers.sheet_kind(cells).where("kind = 'table'").select("tab")
        long = long.unionByName(readers.sheet_records(cells.join(table, "tab", "left_semi")))
    fault = F.col("field") == "!error"
    return readers.mined(long.where(~fault)).unionByName(long.where(fault))
