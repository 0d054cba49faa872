"""Ranked lexical search by a document FP-tree.

Texts are read once: each document becomes its length and a vector of the terms that some item asks for, with their
counts; a table. Then every task builds FP-trees over blocks of that table. A document's terms are ordered from the
commonest to the rarest, so documents with equal beginnings share a path; chains are one node, and small neighbouring
branches one bucket. Every node holds for each of its branches (a bucket for each of its documents) the largest tf of each
term below and the smallest m: a term adds more with more tf and less with more m, so these bound what any document below
can score. For each item the tree is walked depth first, the most promising branch first, and a branch is left out once
its bound is below the item's k-th score so far (not where it is equal, as a smaller doc_id may stand there). That score
is kept from block to block. What tasks return are at most k rows an item, of which the k best are taken.

Items are a stated query set. They are searched in groups of at most ITEM_TERMS different terms in all, so what is
broadcast is bounded whatever their number.

Scores are integers: a term's weight w is floor(1000 * ln((2N + 2) / (2df + 1))), m is 75 + (25nN) div L, a document gets
w * ((1000000000 tf) div (1000 tf + 12 m)) for each term of the item, repeats included.

Defined results: null and empty texts have no terms, are in no count and no result; very long texts are read whole; rows
with a null doc_id take no part; rows that repeat a doc_id are documents each; rows that repeat an item_id are one item
with the terms of all; rows with a null item_id take no part; items without terms, or whose terms no document has, have
no rows; equal scores go by ascending doc_id; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import common

TOP = 20
#: Different terms of items that are searched for at once.
ITEM_TERMS = 1 << 19
BLOCK_DOCS, BLOCK_ENTRIES, BUCKET = 4096, 1 << 19, 64
#: Branchings below one another in a tree; what lies deeper is cut into buckets.
LEVELS = 200
# Terms are runs of letters, digits and all beyond ASCII; for UTF-8 bytes that is: all else becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats)."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("repeats", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t, n) for i, text in zip(b.column(0).to_pylist(), common.raw(b.column(1)), strict=True) for t, n in Counter(terms(text)).items()]
            if found:
                yield common.batch(schema, *zip(*found, strict=True))

    own = common.own_ids(items, "text", "item_id").withColumnRenamed("doc_id", "item_id")
    return own.mapInArrow(run, "item_id long, term binary, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and the numbers of those that items ask for with their counts."""
    common.small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(number)
    lists = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", lists), ("tfs", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value.get
        for b in batches:
            sizes, which, often = [], [], []
            for text in common.raw(b.column(1)):
                found = terms(text)
                counts = Counter(map(of, found))
                counts.pop(None, None)
                sizes.append(len(found))
                which.append(list(counts))
                often.append(list(counts.values()))
            yield common.batch(schema, b.column(0), sizes, which, often)

    return common.own_ids(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Items:
    """Items as arrays: the ranks of each one's terms, ascending, and their weights times repeats."""

    def __init__(self, ids: list[int], ranks: list[np.ndarray], weights: list[np.ndarray]):
        self.ids, self.ranks, self.weights = ids, ranks, weights

    @classmethod
    def of(cls, rows: list, number: dict[bytes, int], rank: np.ndarray, weight: np.ndarray) -> Items:
        own: dict[int, list[tuple[int, int]]] = {}
        for item_id, term, repeats in rows:
            at = number[bytes(term)]
            own.setdefault(item_id, []).append((int(rank[at]), int(weight[at]) * repeats))
        ids = sorted(own)
        both = [np.array(sorted(own[i]), np.int64).reshape(-1, 2) for i in ids]
        return cls(ids, [x[:, 0].copy() for x in both], [x[:, 1].copy() for x in both])


class Node:
    """ranks: the terms below, ascending. gains: (terms, branches), the most that a term can add in a branch. A bucket's branches are its documents."""

    __slots__ = ("branches", "docs", "gains", "ranks")

    def __init__(self, ranks: np.ndarray, gains: np.ndarray, branches: list | None, docs: np.ndarray | None):
        self.ranks, self.gains, self.branches, self.docs = ranks, gains, branches, docs

    def bounds(self, ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each branch the most that a document in it can score; in a bucket, its score."""
        if not len(self.ranks):
            return np.zeros(self.gains.shape[1], np.int64)
        at = np.searchsorted(self.ranks, ranks)
        at[at == len(self.ranks)] = 0
        held = self.ranks[at] == ranks
        return weights[held] @ self.gains[at[held]]


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """An FP-tree over a block of documents: their ids and m, and their (rank, tf) entries by document, ranks ascending."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray):
        paths = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = sorted(range(len(ids)), key=lambda k: (paths[k], ids[k]))
        self.paths, self.ids, self.m = [paths[k] for k in order], ids[order], m[order]
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ranks, self.tfs = ranks[entries], tfs[entries]
        self.root = self._node(0, len(ids), 0, 0)[0] if len(ids) else None

    def _spans(self, low: int, high: int, depth: int) -> list[tuple[int, int]]:
        """The branches below a path of so many terms: documents that go on with the same term; small neighbours are put together."""
        edges, k = [low], low
        while k < high:
            step = self.paths[k][4 * depth : 4 * depth + 4]
            a, b = k + 1, high
            while a < b:  # the paths are sorted
                half = (a + b) // 2
                a, b = (half + 1, b) if self.paths[half][4 * depth : 4 * depth + 4] == step else (a, half)
            k = a
            edges.append(k)
        out = [(edges[0], edges[1])]
        for a, b in zip(edges[1:-1], edges[2:], strict=True):
            if b - out[-1][0] <= BUCKET:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _node(self, low: int, high: int, depth: int, level: int) -> tuple[Node, np.ndarray, np.ndarray, int]:
        """The node, and for its own branch in its parent: ranks, largest tfs and smallest m."""
        one, last = self.paths[low], self.paths[high - 1]
        if high - low <= BUCKET:
            return self._bucket(low, high)
        if one == last or level == LEVELS:
            return self._inner([(a, min(a + BUCKET, high)) for a in range(low, high, BUCKET)], depth, level)
        while one[4 * depth : 4 * depth + 4] == last[4 * depth : 4 * depth + 4]:  # a chain
            depth += 1
        return self._inner(self._spans(low, high, depth), depth + 1, level + 1)

    def _bucket(self, low: int, high: int) -> tuple[Node, np.ndarray, np.ndarray, int]:
        part = slice(self.starts[low], self.starts[high])
        ranks, at = np.unique(self.ranks[part], return_inverse=True)
        doc = np.repeat(np.arange(high - low), np.diff(self.starts[low : high + 1]))
        gains = np.zeros((len(ranks), high - low), np.int64)
        gains[at, doc] = gain(self.tfs[part], self.m[low:high][doc])
        most = np.zeros(len(ranks), np.int64)
        np.maximum.at(most, at, self.tfs[part])
        return Node(ranks, gains, None, self.ids[low:high]), ranks, most, int(self.m[low:high].min())

    def _inner(self, spans: list[tuple[int, int]], depth: int, level: int) -> tuple[Node, np.ndarray, np.ndarray, int]:
        below = [self._node(a, b, depth, level) for a, b in spans]
        ranks, at = np.unique(np.concatenate([x[1] for x in below]), return_inverse=True)
        tfs = np.concatenate([x[2] for x in below])
        branch = np.repeat(np.arange(len(below)), [len(x[1]) for x in below])
        gains = np.zeros((len(ranks), len(below)), np.int64)
        gains[at, branch] = gain(tfs, np.array([x[3] for x in below])[branch])
        most = np.zeros(len(ranks), np.int64)
        np.maximum.at(most, at, tfs)
        return Node(ranks, gains, [x[0] for x in below], None), ranks, most, min(x[3] for x in below)

    def search(self, ranks: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Puts what is among the k best in the heap of (score, -doc_id). Returns how many documents it scored."""
        scored, stack = 0, [(math.inf, self.root)] if self.root else []  # what was found in other trees says nothing of this root
        while stack:
            bound, node = stack.pop()
            if bound < (best[0][0] if len(best) == k else 1):
                continue
            bounds = node.bounds(ranks, weights)
            least = best[0][0] if len(best) == k else 1
            at = np.flatnonzero(bounds >= least)
            if node.docs is None:
                at = at[np.argsort(bounds[at], kind="stable")]  # the most promising is popped first
                stack += [(int(bounds[b]), node.branches[b]) for b in at]
                continue
            scored += len(node.docs)
            for score, doc_id in zip(bounds[at].tolist(), node.docs[at].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -doc_id))
                elif (score, -doc_id) > best[0]:
                    heapq.heapreplace(best, (score, -doc_id))
        return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, entries = [], 0, 0
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.slice(at, 256)
            size = len(part.column(2).flatten())
            if held and (docs + len(part) > BLOCK_DOCS or entries + size > BLOCK_ENTRIES):
                yield pa.Table.from_batches(held)
                held, docs, entries = [], 0, 0
            held.append(part)
            docs, entries = docs + len(part), entries + size
    if held:
        yield pa.Table.from_batches(held)


def tree_of(block: pa.Table, rank: np.ndarray, n_docs: int, n_terms: int) -> Tree:
    """block: rows of vectors(). rank: each term's place from the commonest to the rarest."""
    ids, n = block.column(0).to_numpy(), block.column(1).to_pylist()
    m = np.array([75 + 25 * x * n_docs // n_terms for x in n], np.int64)
    lists = [c.combine_chunks() for c in block.columns[2:4]]
    sizes = np.diff(lists[0].offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    ranks, tfs = rank[lists[0].flatten().to_numpy()].astype(np.int64), lists[1].flatten().to_numpy().astype(np.int64)
    order = np.lexsort((ranks, np.repeat(np.arange(len(ids)), sizes)))
    return Tree(ids, m, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ranks[order], tfs[order])


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    asked = common.written(item_terms(items), "asked")
    groups = max(1, -(-asked.count() // ITEM_TERMS))
    found = None
    for group in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group) if groups > 1 else asked
        part = _search(docs, rows.collect(), top)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best, of a group of items."""
    spark = docs.sparkSession
    number = {t: k for k, t in enumerate(sorted({bytes(r[1]) for r in rows}))}
    table = common.written(vectors(docs, number), "vectors")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for term, held in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = held
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    rank = np.empty(len(number), np.int64)
    rank[np.lexsort((np.arange(len(number)), -df))] = np.arange(len(number))
    plan = spark.sparkContext.broadcast((rank, Items.of(rows, number, rank, weight)))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, asked = plan.value
        best = [[] for _ in asked.ids]
        for block in _blocks(batches):
            tree = tree_of(block, rank, n_docs, n_terms)
            for own, ranks, weights in zip(best, asked.ranks, asked.weights, strict=True):
                tree.search(ranks, weights, own, top)
        out = [(i, -d, s) for i, own in zip(asked.ids, best, strict=True) for s, d in own]
        if out:
            yield common.batch(schema, *zip(*out, strict=True))

    return table.where("n > 0").mapInArrow(run, "item_id long, doc_id long, score long")


ORACLE = """
WITH term AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (
    SELECT doc_id, row_id, len(w) AS n, unnest(w) AS t FROM (
      SELECT doc_id, row_number() OVER () AS row_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
      FROM documents WHERE doc_id IS NOT NULL))
  GROUP BY doc_id, row_id, n, t
), size AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM (
    SELECT len(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS n FROM documents WHERE doc_id IS NOT NULL) WHERE n > 0
), held AS (
  SELECT t, count(*) AS df FROM term GROUP BY t
), weight AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM held, size
), item AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
  WHERE item_id IS NOT NULL GROUP BY item_id, t
), scored AS (
  SELECT i.item_id, d.doc_id, sum(i.q * w.w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * d.n * s.docs) // s.terms))))::BIGINT AS score
  FROM item i JOIN term d USING (t) JOIN weight w USING (t), size s GROUP BY i.item_id, d.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
