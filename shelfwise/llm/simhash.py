"""SimHash near-dedup: segment-popcount embedding and a grid range-join.

A fingerprint is split into segments; the bits set in each are its place in a grid. Flipping a bit moves one count by
one, so two fingerprints that differ in d bits are at a Manhattan distance of at most d: all links lie within that
distance. Each distinct fingerprint is stored in its own cell and asks all cells that near (by symmetry only those in
the positive half), an equi-join on the cell whose condition verifies the Hamming distance exactly. Copies share a
fingerprint and are one row of that join, so a group of copies makes no pairs.

More segments make cells smaller and probes more; their number follows from the estimated rows of the join.

Defined results: a text with no word has fingerprint zero, linked like any other; null text is empty; very long texts are
read whole; rows with a null doc_id take no part; rows that repeat a doc_id get one row each; in a tie the smallest
doc_id stands for a group; an empty table gives an empty result; other columns play no part in fingerprints(). keep_one()
decides by row: of rows that repeat a doc_id each goes or stays by its own text, and one stays where several of one group
have the id that stands for it (the smallest fingerprint, then the smallest text).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import common
from shelfwise.llm.components import components

WORDS, SEED, MAX_BITS = 3, 42, 2
#: Segments that the embedding may have: 8 ask 73 cells, 16 ask 257. Any number finds all links.
SEGMENTS = (8, 16)
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Of UTF-8 text, as an unsigned integer."""
    found = (text or b"").lower().split()  # for bytes: A-Z, and exactly [\x20\x09-\x0D]
    if not found:
        return 0
    joined = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t) for t in common.raw(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.view(np.int64))], schema=schema)

    return common.own_ids(docs).mapInArrow(run, "doc_id long, bits long")


def _cell(bits: Column, segments: int) -> Column:
    """Segment counts side by side in one long, 64 / segments bits each: room for a count and for steps beyond it."""
    width = 64 // segments
    return sum((F.bit_count(F.shiftrightunsigned(bits, width * k).bitwiseAND(F.lit((1 << width) - 1))).cast("long") * F.lit(_digit(k, segments)) for k in range(segments)), F.lit(0).cast("long"))


def _digit(k: int, segments: int) -> int:
    return 16**k if segments <= 8 else 8**k


def _steps(segments: int, distance: int) -> list[int]:
    """Moves in the grid by at most distance, as differences of cells; of each move and its reverse, the positive one."""
    found = {0}
    for n in range(1, distance + 1):
        for axes in itertools.combinations_with_replacement(range(segments), n):
            for signs in itertools.product((1, -1), repeat=n):
                move = sum(s * _digit(k, segments) for s, k in zip(signs, axes, strict=True))
                if move > 0:
                    found.add(move)
    return sorted(found)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS[0]) -> DataFrame:
    """(a, b) fingerprints of distinct (bits) rows that differ in max_bits at most, each pair once."""
    placed = distinct.withColumn("cell", _cell(F.col("bits"), segments))
    asks = placed.select(F.col("bits").alias("a"), F.col("cell").alias("from"), F.explode(F.array(*[F.lit(s) for s in _steps(segments, max_bits)])).alias("step"))
    asks = asks.select("a", (F.col("from") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("home"))
    there = placed.select(F.col("bits").alias("b"), "cell")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return asks.join(there.hint("merge"), (asks.cell == there.cell) & near & (~F.col("home") | (F.col("a") < F.col("b")))).select("a", "b")


def segments_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The number that makes the fewest rows: probes, and the pairs that random fingerprints would make in the cells probed.

    The cells in use are about 2 to the entropy of a place in the grid; a segment of w random bits has about
    log2(sqrt(pi * e * w / 2)) bits of it.
    """

    def rows(segments: int) -> float:
        probes = len(_steps(segments, max_bits))
        cells = 2 ** (segments * math.log2(math.sqrt(math.pi * math.e * (64 / segments) / 2)))
        return n * probes * (1 + n / cells / 8)  # comparing a pair is less work than sending a probe

    return min(SEGMENTS, key=rows)


def _groups(prints: DataFrame, max_bits: int) -> tuple[DataFrame, int]:
    """(bits, n, root_bits, component_id, n_links) of each distinct fingerprint, and how many rows all have. root_bits tells groups apart where a doc_id is repeated."""
    distinct = common.written(prints.groupBy("bits").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    different, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = common.written(links(distinct.select("bits"), max_bits, segments_for(different, max_bits)), "near")
    ends = found.select(F.col("a").alias("bits")).unionAll(found.select(F.col("b").alias("bits"))).groupBy("bits").agg(F.count("*").alias("n_links"))
    roots = components(found).withColumnsRenamed({"id": "bits", "root": "root_bits"})
    classes = distinct.join(roots, "bits", "left").join(ends, "bits", "left").withColumn("root_bits", F.coalesce("root_bits", "bits"))
    least = classes.groupBy("root_bits").agg(F.min("id").alias("component_id"))
    return common.written(classes.join(least, "root_bits").select("bits", "n", "root_bits", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "groups"), total


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), n_links (to other fingerprints)."""
    prints = common.written(fingerprints(docs), "fingerprints")
    groups, total = _groups(prints, max_bits)
    return common.hot_join(prints, groups.drop("root_bits"), ["bits"], "n", total).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def with_bits(docs: DataFrame, to: str) -> DataFrame:
    """docs with their fingerprint as a further column."""
    out = docs.withColumn(to, F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t) for t in common.raw(b.column("text"))], np.uint64).view(np.int64)
            yield b.set_column(b.schema.get_field_index(to), pa.field(to, pa.int64(), False), pa.array(bits))

    return out.mapInArrow(run, out.schema)


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without those that have a smaller doc_id in their group. Rows without doc_id stay."""
    prints = common.written(fingerprints(docs), "fingerprints")
    groups, total = _groups(prints, max_bits)
    name, bits, root, group, rank = (common.fresh(docs, n) for n in ("__gone", "__bits", "__root", "__group", "__rank"))
    doc_id = docs["doc_id"].cast("long")
    twice = common.written(prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name)), "twice")
    judged = common.hot_join(prints, groups.select("bits", "n", "component_id"), ["bits"], "n", total)
    gone = judged.where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    if twice.isEmpty():
        return docs.join(common.written(gone, "gone"), doc_id == F.col(name), "left_anti")
    alone = docs.join(common.written(gone.unionAll(twice), "gone"), doc_id == F.col(name), "left_anti")
    again = with_bits(docs.join(twice, doc_id == F.col(name), "left_semi"), bits)
    again = again.join(groups.select(F.col("bits").alias(bits), F.col("component_id").alias(root), F.col("root_bits").alias(group)), bits).where(F.col("doc_id").cast("long") == F.col(root))
    order = Window.partitionBy(group).orderBy(bits, "text")
    return alone.unionByName(again.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns))
