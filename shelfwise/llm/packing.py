"""Best-fit packing: bounded-space online best-fit of token pieces into sequences.

A packer keeps a fixed number of open bins in a bitset keyed by free space: bit s is set while a bin with s free tokens
is open. The best fit for a piece is the lowest set bit at or above its length. When a new bin would exceed the bound,
the fullest open bin (the lowest set bit) closes first, whatever may still come.

Documents are dealt to packers by a hash of doc_id, as many packers as the tokens call for, each with about SHARE
tokens. A packer takes its pieces as they arrive, in the order of a hash of doc_id, and holds back WINDOW of them: of
those, longer ones are placed first. So it needs the memory of its open bins and one window, however much comes.

Defined results: null text is empty and still a piece with the end id; very long texts are cut into many pieces; rows
with a null doc_id take no part; rows that repeat a doc_id are packed each, in any order; pieces of one length are taken
in order of arrival; an empty table gives an empty result; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common, tokens

CAPACITY, END_ID = 2048, 0
#: Open bins of a packer, pieces that it holds back to order them, and tokens that it is to get.
OPEN_BINS, WINDOW, SHARE = 256, 1024, 1 << 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online, bounded space. add() gives the bin and the place in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.bins = 0, defaultdict(list)  # bins: ids of the open ones by free space
        self.open = self.made = self.closed = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, at = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: as few as can be; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """A row for each piece; with ids, their bytes too (little-endian unsigned 32 bits)."""
    common.small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder("byte", path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), common.words_of(b.column(1)), strict=True):
                data = encode(text) + end
                for k, (start, length) in enumerate(cuts(len(data) // 4, capacity)):
                    own = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), own)[: len(schema)])
            yield common.batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    return common.own_ids(docs).mapInArrow(run, PIECES + ", ids binary" * ids)


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, share: int = SHARE, window: int = WINDOW) -> DataFrame:
    """Pieces with sequence_id, offset, and n_closed: bins that the packer had closed by its bound. found is read twice: give a written table."""
    total = found.agg(F.sum("length")).first()[0] or 0
    packers = max(1, round(total / share))
    new = ("sequence_id", "offset", "n_closed")
    schema = pa.schema([(f.name, t) for f, t in zip(found.schema, _arrow(found), strict=True)] + [(n, pa.int64()) for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = fit = None
        held: list[pa.RecordBatch] = []

        def placed(rows: pa.Table) -> pa.RecordBatch:
            lengths = rows.column("length").to_pylist()
            out: list[tuple] = [()] * len(lengths)
            for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
                at, offset = fit.add(lengths[k])
                out[k] = (packer << 40 | at, offset, fit.closed)
            columns = rows.drop_columns(["__packer"]).combine_chunks().to_batches()[0].columns
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], schema=schema)

        for b in batches:
            numbers = b.column("__packer").to_numpy()
            for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if not len(part):
                    continue
                if numbers[part[0]] != packer:
                    if held:
                        yield placed(pa.Table.from_batches(held))
                    packer, fit, held = int(numbers[part[0]]), BestFit(capacity, open_bins), []
                held.append(b.slice(part[0], len(part)))
                while sum(h.num_rows for h in held) >= window:
                    rows = pa.Table.from_batches(held)
                    yield placed(rows.slice(0, window))
                    held = rows.slice(window).to_batches()
        if held:
            yield placed(pa.Table.from_batches(held))

    out = ", ".join(f"{n} {t}" for n, t in found.dtypes) + "".join(f", {n} long" for n in new)
    dealt = found.withColumn("__packer", F.pmod(F.xxhash64("doc_id"), F.lit(packers)).cast("long"))
    dealt = dealt.repartitionById(packers, F.col("__packer").cast("int"))
    return dealt.sortWithinPartitions("__packer", F.xxhash64("doc_id", F.lit(1)), "doc_id", "piece").mapInArrow(run, out)


def _arrow(df: DataFrame) -> list[pa.DataType]:
    return [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t] for _, t in df.dtypes]


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, share: int = SHARE) -> DataFrame:
    found = common.written(pieces(docs, path or tokens.vocabulary("byte_bpe_50k.json"), capacity), "pieces")
    return pack(found, capacity, open_bins, share)
