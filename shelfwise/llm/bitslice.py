"""Exact top-k by integer inner product over a bit-sliced index.

Rows are dealt to blocks. A block keeps, for each component, the leading bits of its values as bitmaps over the rows
(the quantised slices), and the values themselves. A query's components are taken apart into signed powers of two, so
its inner product is a sum of slices and complements, each at a power; carry-save adders on bitmaps make the slices of
the sum. The k-th largest sum is found from the most significant slice downward. What quantising left out is bounded,
and the rows that it could lift over that boundary are resolved exactly from their values.

An exact search of stated queries compares each with each row; what is sent for it is an index block for each QUERIES
queries, and those queries for each block, both a small part of the comparing.

Defined results: see vectors.usable() (zero vectors take part); of repeated vec_ids each row is a candidate, and a
query's own vec_id none; a repeated query is searched once, by the last of its vectors in order; equal scores go to the
smaller vec_id; too few rows give shorter lists; an empty table gives an empty result; whole numbers and scores beyond a
long's range become its nearest bound, and sums are exact before that; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import common, vectors

#: Rows of a block, slices kept of each component, queries that meet a block in one task.
ROWS, SLICES, QUERIES = 16_384, 6, 4096
LONG = 2**63 - 1


def signed_powers(x: int) -> list[tuple[int, int]]:
    """(sign, power) with x as their sum, no two powers adjacent."""
    out, power, sign = [], 0, 1 if x >= 0 else -1
    x = abs(int(x))
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((sign * digit, power))
            x -= digit
        x >>= 1
        power += 1
    return out


class Block:
    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: int = SLICES):
        self.ids, self.values, self.most = ids, values, None
        self.low = values.min(0)
        above = values.view(np.uint64) - self.low.view(np.uint64)  # by wrapping, right for any two longs
        bits = max(1, int(above.max()).bit_length())
        self.shift = max(0, bits - slices)
        high = above >> np.uint64(self.shift)
        self.n = bits - self.shift
        words = -(-len(ids) // 64)
        maps = np.zeros((values.shape[1], self.n, words), np.uint64)
        for b in range(self.n):
            packed = np.packbits((high >> np.uint64(b) & np.uint64(1)).T.astype(np.uint8), axis=1, bitorder="little")
            padded = np.zeros((values.shape[1], words * 8), np.uint8)
            padded[:, : packed.shape[1]] = packed
            maps[:, b] = padded.view(np.uint64)
        self.all = np.zeros(words * 8, np.uint8)
        whole = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        self.all[: len(whole)] = whole
        self.all = self.all.view(np.uint64)
        self.with_complements(maps)

    def with_complements(self, maps: np.ndarray) -> None:
        """Only the slices are stored; their complements are made where they are used."""
        self.slices, self.maps = maps, np.stack([~maps & self.all, maps])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of query * high bits, moved up by a constant that all rows share."""
        signs, columns, powers = [], [], []
        for j, x in enumerate(query.tolist()):
            for sign, power in signed_powers(x):
                signs.append(int(sign > 0))
                columns.append(j)
                powers.append(power)
        signs, columns, powers = np.array(signs, int), np.array(columns, int), np.array(powers, int)
        top = int(powers.max()) + self.n if len(powers) else 0
        carried: list[list[np.ndarray]] = [[] for _ in range(top + 40)]
        out: list[np.ndarray] = []
        for w in range(len(carried)):
            parts = carried[w]
            for b in range(self.n):
                at = np.flatnonzero(powers == w - b)
                if len(at):
                    parts.append(self.maps[signs[at], columns[at], b])
            if not parts:
                if w >= top and not any(carried[w + 1 :]):
                    break
                out.append(np.zeros_like(self.all))
                continue
            held = np.concatenate(parts) if len(parts) > 1 else parts[0]
            while len(held) > 1:
                k = len(held) // 3
                if k:
                    a, b, c = held[:k], held[k : 2 * k], held[2 * k : 3 * k]
                    half = a ^ b
                    carried[w + 1].append(a & b | c & half)
                    held = np.concatenate([half ^ c, held[3 * k :]]) if len(held) > 3 * k else half ^ c
                else:
                    carried[w + 1].append(held[:1] & held[1:])
                    held = held[:1] ^ held[1:]
            out.append(held[0])
        return out

    def boundary(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward."""
        tied, above, value = self.all, 0, 0
        for w in range(len(slices) - 1, -1, -1):
            ones = tied & slices[w]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                tied, value = ones, value | 1 << w
            else:
                tied, above = tied & ~slices[w], above + n
        return value

    def at_least(self, slices: list[np.ndarray], value: int) -> np.ndarray:
        """Places of the rows with such a sum."""
        if value <= 0:
            return np.arange(len(self.ids))
        tied, over = self.all, np.zeros_like(self.all)
        for w in range(max(len(slices), value.bit_length()) - 1, -1, -1):
            here = slices[w] if w < len(slices) else np.zeros_like(self.all)
            if value >> w & 1:
                tied = tied & here
            else:
                over = over | tied & here
                tied = tied & ~here
        return np.flatnonzero(np.unpackbits((over | tied).view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the block's k best rows."""
        most = k + int((self.ids == query_id).sum())
        if len(self.ids) > most:
            slices = self.sums(query)
            left_out = sum(map(abs, query.tolist())) * ((1 << self.shift) - 1)  # of both rows together, at most
            at = self.at_least(slices, self.boundary(slices, most) - -(-left_out >> self.shift) - 1)
        else:
            at = np.arange(len(self.ids))
        at = at[self.ids[at] != query_id]
        scores = self.products(at, query)
        order = vectors.best(~scores, self.ids[at], k)  # the order of -scores, without its overflow
        return self.ids[at][order], scores[order]

    def products(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        own = self.values[at]
        if self.most is None:
            self.most = max(map(abs, (int(self.values.max()), int(self.values.min()))))
        if self.most * sum(map(abs, query.tolist())) <= LONG:
            return own @ query
        exact = [sum(x * y for x, y in zip(row, query.tolist(), strict=True)) for row in own.tolist()]
        return np.array([max(-LONG - 1, min(LONG, x)) for x in exact], np.int64)


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component, within a long's range."""
    return vectors.usable(rows, zero=True).select("vec_id", F.transform("v", lambda x: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63 - 1024), x * 256)))).alias("v"))


def top_k(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k highest of each row whose vec_id is divisible by `every`, among all other rows: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    common.small_batches(spark)
    numbers = common.written(whole_numbers(rows), "numbers")
    n, asked = numbers.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, parts = max(1, -(-n // ROWS)), max(1, -(-asked // QUERIES))
    own = numbers.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        b = Block(table.column("vec_id").to_numpy()[order], vectors.matrix(table.column("v"))[order].astype(np.int64))
        wide = np.dtype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= b.values.min() and b.values.max() <= np.iinfo(t).max))
        parts = [b.ids, b.values.astype(wide), b.low, b.slices, b.all]
        return pa.table([pa.array([int(table.column("block")[0].as_py())], pa.int32()), pa.array([b.shift], pa.int32()), pa.array([b.n], pa.int32()), pa.array([wide.itemsize], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=["block", "shift", "n", "width", *PARTS])

    index = common.written(own.groupBy("block").applyInArrow(build, "block int, shift int, n int, width int, " + ", ".join(f"{p} binary" for p in PARTS)), "bit-slices")
    queries = numbers.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int"))
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        if one.num_rows and two.num_rows:
            b = _open(one)
            for query, i in zip(vectors.matrix(two.column("v")).astype(np.int64), two.column("vec_id").to_pylist(), strict=True):
                ids, scores = b.top(query, i, k)
                out.append((np.full(len(ids), i, np.int64), ids, scores))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


PARTS = ("ids", "whole", "low", "maps", "used")


def _open(table: pa.Table) -> Block:
    b = object.__new__(Block)
    get = lambda name, kind: np.frombuffer(table.column(name)[0].as_py(), kind)
    b.shift, b.n = table.column("shift")[0].as_py(), table.column("n")[0].as_py()
    b.ids, b.low, b.all = get("ids", np.int64), get("low", np.int64), get("used", np.uint64)
    b.values, b.most = get("whole", f"<i{table.column('width')[0].as_py()}").reshape(len(b.ids), -1).astype(np.int64), None
    b.with_complements(get("maps", np.uint64).reshape(len(b.low), b.n, len(b.all)))
    return b


ORACLE = """
WITH num AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(cast(q.v AS double[]), cast(c.v AS double[])) AS bigint) AS score
  FROM num q JOIN num c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
