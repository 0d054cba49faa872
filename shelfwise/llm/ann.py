"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The upper tree is fitted on at most SAMPLE rows (smallest hash of vec_id) on the driver and has at most LEAVES leaves, so
its broadcast is bounded. Every row is indexed by its leaf. Leaves grow with the rows: one that holds more than twice
LEAF_ROWS is split by a lower tree of at most SUB leaves, fitted in a task on a bounded sample of its own rows and kept
in a table; rows and queries meet it there.

A query takes nodes from a priority queue by the distance of their centres and so orders the leaves; it visits the first
`visits` of the upper tree, and more until they hold enough rows, and of each the first `share` of its lower leaves, in
the same way. Both are calibrated: PROBES queries are searched exactly, and both widen until the share of their true
neighbours within what is visited reaches `recall`.

Leaves are searched in blocks of at most BLOCK rows by at most BLOCK queries, so a leaf that holds a third of all rows
becomes many tasks.

Defined results: see vectors.usable() for the rows that take part; of repeated vec_ids each row is a candidate, and a
query's own vec_id none; a repeated query is searched once, by the last of its vectors in order; equal distances go to the
smaller vec_id; too few rows give shorter lists; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import common, vectors

SAMPLE, LEAVES, LEAF_ROWS, BRANCH, SEED = 20_000, 2048, 256, 8, 11
PROBES, RECALL, BLOCK = 256, 0.95, 8192
#: Leaves of a lower tree, and rows that each is fitted on.
SUB, FIT_ROWS = 256, 16


class Tree:
    """centres: of each node; children: ids of a node's children, none for a leaf; leaf: a node's leaf number or -1."""

    def __init__(self, centres: np.ndarray, children: list[np.ndarray], leaf: np.ndarray):
        self.centres, self.children, self.leaf = centres, children, leaf
        self.leaves = int(leaf.max()) + 1

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = SEED) -> Tree:
        rng = np.random.default_rng(seed)
        most = max(1, -(-len(sample) // max(1, leaves)))
        centres, children, leaf, open_nodes = [sample.mean(0)], [np.empty(0, int)], [-1], [(0, np.arange(len(sample)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            own = sample[rows]
            groups = kmeans(own, min(branch, -(-len(rows) // most)), rng) if len(rows) > most else None
            if groups is None:
                leaf[node] = sum(n >= 0 for n in leaf)
                continue
            at = []
            for g in range(groups.max() + 1):
                at.append(len(centres))
                centres.append(own[groups == g].mean(0))
                children.append(np.empty(0, int))
                leaf.append(-1)
                open_nodes.append((at[-1], rows[groups == g]))
            children[node] = np.array(at)
        return cls(np.array(centres), children, np.array(leaf))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root, always on to the nearest child."""
        at = np.zeros(len(rows), int)
        while True:
            inner = [n for n in np.unique(at) if len(self.children[n])]
            if not inner:
                return self.leaf[at]
            for n in inner:
                here, below = np.flatnonzero(at == n), self.children[n]
                at[here] = below[distances(rows[here], self.centres[below]).argmin(1)]

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for d, n in zip(((self.centres[self.children[node]] - query) ** 2).sum(1).tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (d, n))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, good enough to choose a branch."""
    return (b**2).sum(1) - 2 * a @ b.T


def kmeans(rows: np.ndarray, k: int, rng, turns: int = 12) -> np.ndarray | None:
    """Group numbers without gaps; None if rows can't be split."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2 or k < 2:
        return None
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), False)]
    for _ in range(turns):
        group = distances(rows, centres).argmin(1)
        centres = np.array([rows[group == g].mean(0) for g in np.unique(group)])
    _, group = np.unique(distances(rows, centres).argmin(1), return_inverse=True)
    return group if group.max() else None


def exact(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, keep: str = "leaf") -> DataFrame:
    """(query_id, vec_id, score, keep) of the k nearest to each of a bounded number of queries, over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = sent.value
        top = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        for b in batches:
            x, own, kept = vectors.matrix(b.column("v")), b.column("vec_id").to_numpy(), b.column(keep).to_numpy()
            for n, (at, d) in enumerate(vectors.nearest(x, own, q, q_ids, k)):
                both = [np.concatenate(z) for z in zip(top[n], (d, own[at], kept[at]), strict=True)]
                top[n] = tuple(z[vectors.best(both[0], both[1], k)] for z in both)
        sizes = [len(t[0]) for t in top]
        d, v, kept = (np.concatenate(z) for z in zip(*top, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, sizes)), pa.array(v), pa.array(d), pa.array(kept)], names=["query_id", "vec_id", "score", keep])

    found = rows.select("vec_id", "v", keep).mapInArrow(run, f"query_id long, vec_id long, score double, {keep} long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """A table of all usable rows with their leaf, the upper tree, and a table of lower trees."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES):
        common.small_batches(rows.sparkSession)
        self.spark = rows.sparkSession
        usable = vectors.usable(rows, zero=False)
        chosen = common.smallest(usable, sample, "vec_id").collect()
        self.tree = None
        if chosen:
            n = usable.count()
            self.tree = Tree.fit(np.array([r.v for r in chosen]), min(leaves, max(1, n // leaf_rows)))
            upper = common.written(self._with_leaf(usable), "upper-leaves")
            self.tops = {r.leaf: r["count"] for r in upper.groupBy("leaf").count().collect()}
            self.kinds = {top: min(SUB, size // leaf_rows) if size > 2 * leaf_rows else 1 for top, size in self.tops.items()}
            self.split = {top: (k, self.tops[top]) for top, k in self.kinds.items() if k > 1}
            self.lower = self._fit_lower(upper)
            self.rows = common.written(self._with_lower_leaf(upper), "leaves")
            self.sizes = {r.leaf: r["count"] for r in self.rows.groupBy("leaf").count().collect()}  # LEAVES * SUB numbers at most

    def _with_leaf(self, rows: DataFrame) -> DataFrame:
        tree = self.spark.sparkContext.broadcast(self.tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.value.assign(vectors.matrix(b.column("v"))) if b.num_rows else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int64))], names=["vec_id", "v", "leaf"])

        return rows.mapInArrow(run, "vec_id long, v array<double>, leaf long")

    def _cuts(self) -> DataFrame:
        """(leaf, k, blocks, part) of the upper leaves that are split, LEAVES rows at most; part: of its rows to fit on."""
        cuts = [(int(top), int(k), int(-(-size // BLOCK)), float(FIT_ROWS * k / size)) for top, (k, size) in self.split.items()]
        return F.broadcast(self.spark.createDataFrame(cuts, "leaf long, k int, blocks int, part double"))

    def _fit_lower(self, upper: DataFrame) -> DataFrame:
        """(leaf, tree) of the upper leaves that are split."""
        if not self.split:
            return self.spark.createDataFrame([], "leaf long, tree binary")
        draw = (F.xxhash64("vec_id", F.lit(7)).bitwiseAND(F.lit((1 << 40) - 1))) / float(1 << 40)
        rows = upper.join(self._cuts(), "leaf").where(draw < F.col("part")).select("leaf", "k", "v")

        def fit(table: pa.Table) -> pa.Table:
            tree = Tree.fit(vectors.matrix(table.column("v")), table.column("k")[0].as_py())
            return pa.table({"leaf": table.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

        return common.written(rows.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "lower-trees")

    def _meet(self, rows: DataFrame, by: str, run, schema: str) -> DataFrame:
        """Rows of split upper leaves and their lower tree, by blocks."""
        block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
        dealt = rows.join(self._cuts(), "leaf").withColumn("block", block(by)).drop("k", "blocks", "part")
        trees = self.lower.join(self._cuts(), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "tree")

        def both(one: pa.Table, two: pa.Table) -> pa.Table:
            return run(one, pickle.loads(two.column("tree")[0].as_py()) if two.num_rows else None)

        return dealt.groupBy("leaf", "block").cogroup(trees.groupBy("leaf", "block")).applyInArrow(both, schema)

    def _with_lower_leaf(self, upper: DataFrame) -> DataFrame:
        whole = upper.withColumn("leaf", F.col("leaf") * SUB)
        if not self.split:
            return whole

        def assign(one: pa.Table, tree: Tree | None) -> pa.Table:
            leaf = one.column("leaf").to_numpy() * SUB
            if tree is not None and len(leaf):
                leaf = leaf + tree.assign(vectors.matrix(one.column("v")))
            return pa.table({"vec_id": one.column("vec_id"), "v": one.column("v"), "leaf": pa.array(leaf)})

        names = [int(t) * SUB for t in self.split]
        return whole.where(~F.col("leaf").isin(names)).unionByName(self._meet(upper, "vec_id", assign, "vec_id long, v array<double>, leaf long"))

    def lower_leaves(self, asks: DataFrame, share: float = 1.0) -> DataFrame:
        """asks (query_id, q, leaf: of the upper tree) → (query_id, q, leaf, place): the first share of the lower leaves, place as a share of them."""
        names = [int(t) for t in self.split]
        whole = asks.where(~F.col("leaf").isin(names)) if names else asks
        whole = whole.select("query_id", "q", (F.col("leaf") * SUB).alias("leaf"), F.lit(0.0).alias("place"))
        if not names:
            return whole

        def order(one: pa.Table, tree: Tree | None) -> pa.Table:
            at, leaf, place = [], [], []
            for n, (q, top) in enumerate(zip(vectors.matrix(one.column("q")), one.column("leaf").to_pylist(), strict=True) if one.num_rows else ()):
                count = tree.leaves if tree is not None else 1
                for turn, sub in enumerate(tree.order(q) if tree is not None else (0,)):
                    if turn and turn / count > share:
                        break
                    at.append(n)
                    leaf.append(top * SUB + sub)
                    place.append(turn / count)
            picked = one.take(pa.array(at, pa.int64()))
            return pa.table({"query_id": picked.column("query_id"), "q": picked.column("q"), "leaf": pa.array(leaf, pa.int64()), "place": pa.array(place, pa.float64())})

        return whole.unionByName(self._meet(asks, "query_id", order, "query_id long, q array<double>, leaf long, place double"))

    def calibrate(self, queries: DataFrame, k: int, recall: float = RECALL, probes: int = PROBES) -> tuple[int, float, float]:
        """(visits of upper leaves, share of each one's lower leaves, recall that they have on the probes)."""
        chosen = common.smallest(queries, probes, "vec_id").collect()
        vs, ids = np.array([r.v for r in chosen]), np.array([r.vec_id for r in chosen])
        true = exact(self.rows, vs, ids, k).select("query_id", "leaf").collect()  # probes * k rows at most
        if not true:
            return 1, 1.0, 1.0
        upper = {(i, leaf): n for v, i in zip(vs, ids.tolist(), strict=True) for n, leaf in enumerate(self.tree.order(v))}
        at = np.array([upper[r.query_id, r.leaf // SUB] for r in true])
        lower = np.zeros(len(true))
        if self.split:
            of = {i: v.tolist() for v, i in zip(vs, ids.tolist(), strict=True)}
            pairs = sorted({(r.query_id, r.leaf // SUB) for r in true})
            asks = self.spark.createDataFrame([(i, of[i], leaf) for i, leaf in pairs], "query_id long, q array<double>, leaf long")
            wanted = self.spark.createDataFrame(sorted({tuple(r) for r in true}), "query_id long, leaf long")
            place = {(r.query_id, r.leaf): r.place for r in self.lower_leaves(asks).join(F.broadcast(wanted), ["query_id", "leaf"]).select("query_id", "leaf", "place").collect()}
            lower = np.array([place[r.query_id, r.leaf] for r in true])
        least = recall if not self.split else recall**0.5
        at_most = lambda xs: np.sort(xs)[max(0, int(np.ceil(least * len(xs))) - 1)]
        visits = int(at_most(at)) + 1
        share = float(at_most(lower[at < visits]))
        return visits, share, float(np.mean((at < visits) & (lower <= share)))

    def search(self, queries: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
        """queries: (vec_id, v), rows of the index. query_id, rank, vec_id, score."""
        visits, share, _ = self.calibrate(queries, k, recall)
        tree, tops, sizes = self.spark.sparkContext.broadcast(self.tree), self.tops, self.sizes

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, to = [], []
                for n, q in enumerate(vectors.matrix(b.column("v")) if b.num_rows else ()):
                    held = 0
                    for turn, leaf in enumerate(tree.value.order(q)):
                        if turn >= visits and held > k:
                            break
                        held += tops.get(leaf, 0)
                        at.append(n)
                        to.append(leaf)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at, pa.int64())), b.column("v").take(pa.array(at, pa.int64())), pa.array(to, pa.int64())], names=["query_id", "q", "leaf"])

        upper = queries.groupBy("vec_id").agg(F.max("v").alias("v")).mapInArrow(leaves, "query_id long, q array<double>, leaf long")
        asks = common.written(self.lower_leaves(upper, share).drop("place"), "asks")
        askers = {r.leaf: r["count"] for r in asks.groupBy("leaf").count().collect()}
        cut = [(int(leaf), -(-n // BLOCK), -(-askers.get(leaf, 0) // BLOCK)) for leaf, n in sizes.items() if askers.get(leaf)]
        if not cut:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        plan = lambda: F.broadcast(self.spark.createDataFrame(cut, "leaf long, row_blocks int, query_blocks int"))  # noqa: E731  LEAVES * SUB rows at most
        block = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.join(plan(), "leaf").withColumn("row_block", block("vec_id", "row_blocks")).withColumn("query_block", every("query_blocks"))
        right = asks.join(plan(), "leaf").withColumn("query_block", block("query_id", "query_blocks")).withColumn("row_block", every("row_blocks"))
        keys = ["leaf", "row_block", "query_block"]

        def near(one: pa.Table, two: pa.Table) -> pa.Table:
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if one.num_rows and two.num_rows:
                ids, asked = one.column("vec_id").to_numpy(), two.column("query_id").to_numpy()
                for i, (at, d) in zip(asked, vectors.nearest(vectors.matrix(one.column("v")), ids, vectors.matrix(two.column("q")), asked, k), strict=True):
                    out.append((np.full(len(at), i), ids[at], d))
            return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, "query_id long, vec_id long, score double")
        return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`, among all other rows."""
    index = Index(rows)
    if index.tree is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.search(index.rows.where(F.col("vec_id") % every == 0).select("vec_id", "v"), k, recall)
