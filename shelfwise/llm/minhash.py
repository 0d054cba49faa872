"""MinHash near-dedup: an inverted join of signature coordinates with prefix and skip merging.

A document's set of word shingles has a signature of COORDINATES values, each made of the least hashes of ROWS permutations.
Two sets of similarity s agree in a coordinate with probability s ** ROWS, so a pair is retained if MATCHES coordinates at
least agree: at 0.8 that misses five in a million, above it far fewer. Two permutations a coordinate keep texts apart that
merely have a common shingle. Retained pairs are confirmed on the full sets, so no pair that isn't a link passes.

Documents are posted under each (coordinate, value). A value that one document alone has can match nothing. Of two
documents with MATCHES agreements at least, ordered from the rarest value to the commonest, the first COORDINATES -
MATCHES + 1 values of each must share one: only those are merged (prefix), and the long lists of common values are
skipped and looked up in the signatures of the candidates alone, where all agreements are counted. Most documents have
so many values of their own that nothing of them is left to merge.

Equal sets are one node, so copies make no pairs. Nor do large groups of near copies, whose members share most lists. Each
list has a leader, the document whose values are the commonest and so the likely origin, and all that agree with it in
NEAR coordinates are measured against it: what differs from the leader, shingles more or less, is a set D, and the
symmetric difference of two documents is that of their Ds. Two sets are similar if and only if they differ in no more than
a ninth of their sizes' sum; a document that is not similar to the leader therefore is similar to none whose D has no
part in common with its own, and how large that part must be follows from the sizes. So of a list's pairs only those are
candidates where one is a straggler, not similar to the leader, and both have a difference in common among the first of
their Ds, rarest first (a prefix again). Where two meet first, no more is in common than what either has left from there on, so
what the sizes of these two call for must fit in it. Pairs with one who is far from the leader are candidates as they are. Nothing
is lost by it: pairs that are both similar to the leader are joined through it.

Defined results: null text is empty; a text without words has an empty set and is linked with nothing; with fewer words
than a shingle has, all are one shingle; very long texts are read whole; rows with a null doc_id take no part; rows that
repeat a doc_id get a row each and are one document for links: what any of them reaches, all of them reach; ties can't be
(the smallest doc_id is one); an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import common
from shelfwise.llm.components import components
from shelfwise.llm.line_dedup import Digest

WORDS, PERCENT = 2, 80
COORDINATES, ROWS, MATCHES = 64, 2, 24
#: Agreements with a list's leader from which a document is measured against it.
NEAR = 12
_BLOCK = 1 << 14


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and an addend for each permutation, from a fixed generator."""
    drawn = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 32, (2, COORDINATES * ROWS), np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


_TIMES, _PLUS = _coefficients()


def shingles(text: bytes | None, words: int = WORDS) -> set[bytes]:
    found = (text or b"").lower().split()  # for bytes: A-Z, and exactly [\x20\x09-\x0D]
    if not found:
        return set()
    return set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))) if len(found) >= words else {b" ".join(found)}


def signature(hashes: np.ndarray) -> np.ndarray:
    """A set's values as tokens: 64 bits of each coordinate's number and its permutations' least values over the set's hashes."""
    low, least = hashes.astype(np.uint32), np.full(COORDINATES * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _BLOCK):
        x = low[None, at : at + _BLOCK] * _TIMES[:, None]
        x += _PLUS[:, None]
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(1), out=least)
    token = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    for k in range(ROWS):
        token = (token ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        token ^= token >> np.uint64(32)
    return token.view(np.int64)


def _name(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order of its members."""
    x = hashes ^ (hashes >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return int(hashes.sum().astype(np.int64)), int((x * x).sum().astype(np.int64))


def similar(one: set, two: set, percent: int = PERCENT) -> bool:
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both) and both > 0


def _sized(one: Column | str, two: Column | str) -> Column:
    """Sets of these sizes can be similar."""
    one, two = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    return 100 * F.least(one, two) >= PERCENT * F.greatest(one, two)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, hi, lo, content, least): size and name of the set, a hash of the text, and the signature."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("content", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, least = [], [], np.zeros((len(b), COORDINATES), np.int64)
            for k, text in enumerate(common.raw(b.column(1))):
                found = shingles(text)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                sizes.append(len(found))
                names.append(_name(hashes))
                least[k] = signature(hashes)
            hi, lo = zip(*names, strict=True) if names else ((), ())
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * COORDINATES), pa.array(least.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), b.column(2), values], schema=schema)

    own = common.own_ids(docs).withColumn("content", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, n long, hi long, lo long, content long, least array<long>")


def nodes(rows: DataFrame) -> DataFrame:
    """(node, doc_id, n, hi, lo, content, least, copies), one for each different set: its smallest doc_id stands for it."""
    first = F.min(F.struct("doc_id", "content", "n", "least")).alias("first")
    one = rows.where("n > 0").groupBy("hi", "lo").agg(first, F.count("*").alias("copies"))
    return one.select(F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.n", "hi", "lo", "first.content", "first.least", "copies")


def prefixes(found: DataFrame) -> DataFrame:
    """(token, node, n, weight): the postings to be merged. weight is the sum of how many documents share each of a node's values."""
    smallest = -(-PERCENT // (100 - PERCENT))  # smaller sets are similar to equal ones only
    posted = found.where(F.col("n") >= smallest).select("node", "n", F.explode("least").alias("token"))
    shared = common.written(posted.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"), "tokens")
    total = shared.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    repeated = common.hot_join(posted, shared.withColumn("lists", F.col("held")), ["token"], "held", total)
    own = Window.partitionBy("node")
    ranked = repeated.select("*", F.row_number().over(own.orderBy("lists", "token")).alias("rank"), F.count("*").over(own).alias("repeated"), F.sum("lists").over(own).alias("weight"))
    # values of its own come first in a node's order, and use up its prefix
    return ranked.where(F.col("rank") <= F.col("repeated") - (MATCHES - 1)).select("token", "node", "n", "weight")


def _texts(docs: DataFrame, found: DataFrame, posts: DataFrame, repeated_ids: bool) -> DataFrame:
    """(node, text) of the nodes with postings. A digest of their ids spares other texts the shuffle."""
    wanted = common.written(found.join(posts.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "content"), "wanted")
    digest = docs.sparkSession.sparkContext.broadcast(Digest.of(wanted.select("doc_id"), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(digest.value(b.column(0).to_numpy())))

    own = common.own_ids(docs)
    texts = own.mapInArrow(run, own.schema).withColumn("content", F.xxhash64("text")).join(wanted, ["doc_id", "content"])
    texts = texts.groupBy("node").agg(F.min("text").alias("text")) if repeated_ids else texts.select("node", "text")
    return common.written(texts, "texts")


def retained(pairs: DataFrame, found: DataFrame, least: int = MATCHES) -> DataFrame:
    """The pairs whose signatures agree in so many coordinates at least."""
    side = lambda end: found.select(F.col("node").alias(end), F.col("least").alias("least_" + end)).hint("merge")
    agree = F.size(F.filter(F.zip_with("least_a", "least_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(agree >= least).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(None, set()), (None, set())]

        def of(side: int, node: int, text: pa.Scalar) -> set:
            if kept[side][0] != node:
                kept[side] = (node, shingles(text.as_py().encode()))
            return kept[side][1]

        for batch in batches:
            a, b, one, two = batch.columns
            good = [similar(of(0, x, s), of(1, y, t)) for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], schema=schema).filter(pa.array(good, pa.bool_()))

    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias("text_" + end)).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def differences(own: set[bytes], leader: set[bytes]) -> tuple[bool, int, list[int]]:
    """Whether the sets are similar; how many differences a straggler and any other of this leader have in common at least, if they are similar; and all differences."""
    apart = own ^ leader
    linked, n = similar(own, leader), len(apart)
    least = -((len(own) - 4 * n) // 4) if not linked else -((len(own) - len(leader) - 9 * n) // 18)
    return linked, max(1, least), [xxhash.xxh3_64_intdigest(x) >> 1 for x in apart]


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (leader, node) → (leader, node, linked, least, cost, differences).

    A and B with Ds of a and b members, c of them in common, are similar if and only if a + b - 2 * c <= (|A| + |B|) / 9, that is
    if 18 * c reaches the sum of their costs, which are 9 * a - |A| and 9 * b - |B|.
    """
    schema = pa.schema([("leader", pa.int64()), ("node", pa.int64()), ("linked", pa.bool_()), ("least", pa.int64()), ("cost", pa.int64()), ("differences", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, set()
        for b in batches:
            found = []
            for x, one, two in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if x != at:
                    at, leader = x, shingles(one.as_py().encode())
                own = shingles(two.as_py().encode())
                linked, least, apart = differences(own, leader)
                found.append((linked, least, 9 * len(apart) - len(own), apart))
            yield common.batch(schema, b.column(0), b.column(1), *(zip(*found, strict=True) if found else ([], [], [], [])))

    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias("text_" + end)).hint("merge")
    met = pairs.join(side("node"), "node").join(side("leader"), "leader").select("leader", "node", "text_leader", "text_node")
    return met.mapInArrow(run, "leader long, node long, linked boolean, least long, cost long, differences array<long>")


def _pair(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _leaders(posts: DataFrame) -> DataFrame:
    """posts (token, node, n) with their list's leader, of lists that have other members."""
    lead = F.max(F.struct("weight", -F.col("node"))).alias("lead")
    lists = posts.groupBy("token").agg(lead, F.count("*").alias("length")).where("length > 1")
    lists = common.written(lists.select("token", (-F.col("lead.col2")).alias("leader"), "length"), "leaders")
    total = lists.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return common.written(common.hot_join(posts.select("token", "node", "n"), lists, ["token"], "length", total), "lists")


def _shared(near: DataFrame) -> DataFrame:
    """(leader, difference, node, loose, cost, room): the first of each one's differences, from the rarest to the commonest.

    One that no straggler has, or a single document, can join no pair that is wanted: those come first and use up a
    document's prefix. room: how many differences a document has from this one on, those counted out that can't be shared.
    """
    rows = near.select("leader", "node", (~F.col("linked")).alias("loose"), "least", "cost", F.explode("differences").alias("difference"))
    held = rows.groupBy("leader", "difference").agg(F.count("*").alias("held"), F.count_if("loose").alias("stray")).where("held > 1 and stray > 0")
    held = common.written(held.withColumn("length", F.col("held")), "differences")
    total = held.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    own = Window.partitionBy("leader", "node")
    some = common.hot_join(rows, held, ["leader", "difference"], "length", total)
    some = some.withColumn("room", F.count("*").over(own) - F.row_number().over(own.orderBy("stray", "held", "difference")) + 1)
    return _met(common.written(some.where("room >= least").select("leader", "difference", "node", "loose", "cost", "room"), "shared"))


def _fits(room: Column, other_room: Column, cost: Column, other_cost: Column) -> Column:
    """Two that have their first difference in common here can be similar: no more than the smaller room is common to both."""
    return 18 * F.least(room, other_room) >= cost + other_cost


def _met(rows: DataFrame) -> DataFrame:
    """Of rows of _shared, those that fit the largest room and the smallest cost among whom they could meet in their list."""
    best = [f(F.when(F.col("loose"), F.col(c)) if stray else F.col(c)).alias(("loose_" if stray else "any_") + c) for f, c in ((F.max, "room"), (F.min, "cost")) for stray in (True, False)]
    lists = common.written(rows.groupBy("leader", "difference").agg(*best, F.count("*").alias("length")).where("length > 1 and loose_room is not null"), "differences")
    total = lists.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    other = lambda c: F.when(F.col("loose"), F.col("any_" + c)).otherwise(F.col("loose_" + c))
    kept = common.hot_join(rows, lists, ["leader", "difference"], "length", total).where(_fits(F.col("room"), other("room"), F.col("cost"), other("cost")))
    return common.written(kept.select(rows.columns), "met")


def _stragglers(near: DataFrame) -> DataFrame:
    """(a, b): a straggler and another of the same leader that have one of the first differences in common, and room for as many as they need."""
    rows = _shared(near)
    other = rows.where("loose").select("leader", "difference", F.col("node").alias("other"), F.col("cost").alias("other_cost"), F.col("room").alias("other_room"))
    wanted = (F.col("node") != F.col("other")) & (~F.col("loose") | (F.col("node") < F.col("other")))
    met = rows.hint("merge").join(other, ["leader", "difference"]).where(wanted & _fits(F.col("room"), F.col("other_room"), F.col("cost"), F.col("other_cost")))
    return met.select(*_pair("node", "other"))


def _far(lists: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b): pairs of a list in which one at least is far from the leader. The leader is similar to none of those."""
    known = near.select("leader", "node", F.lit(True).alias("near"))
    rows = lists.where("node <> leader").join(known, ["leader", "node"], "left").select("token", "node", "n", F.coalesce("near", F.lit(False)).alias("near"))
    rows = common.written(rows, "members")
    far = rows.where("not near").select("token", F.col("node").alias("other"), F.col("n").alias("other_n"))
    met = rows.hint("merge").join(far, "token").where((F.col("node") != F.col("other")) & (F.col("near") | (F.col("node") < F.col("other"))) & _sized("n", "other_n"))
    return met.select(*_pair("node", "other"))


def links(docs: DataFrame, found: DataFrame, repeated_ids: bool = False) -> DataFrame:
    """(a, b) nodes that are similar: enough links to reach, from each node, all that links reach. Each is confirmed."""
    posts = common.written(prefixes(found), "postings")
    texts = _texts(docs, found, posts, repeated_ids)
    lists = _leaders(posts)
    pairs = lists.where("node <> leader").select("leader", "node").distinct()
    near = retained(pairs.withColumnsRenamed({"leader": "a", "node": "b"}), found, NEAR).withColumnsRenamed({"a": "leader", "b": "node"})
    near = common.written(measured(near, texts), "measured")
    others = common.written(_stragglers(near).unionByName(_far(lists, near)).distinct(), "pairs")
    more = common.written(confirmed(retained(others, found), texts), "confirmed")
    return near.where("linked").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    rows = common.written(sets(docs), "sets")
    found = common.written(nodes(rows), "nodes")
    n_rows, n_ids = rows.where("n > 0").agg(F.count("*"), F.count_distinct("doc_id")).first()
    known = links(docs, found, n_rows > n_ids)
    if n_rows > n_ids:  # the sets of one doc_id belong together
        same = rows.where("n > 0").select("doc_id", "hi", "lo").distinct().join(found.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node")
        first = same.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("held")).where("held > 1").drop("held")
        known = known.unionByName(same.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    roots = components(known)
    placed = found.select("node", "doc_id", "hi", "lo", "copies").join(roots.withColumnsRenamed({"id": "node"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = common.written(placed.join(least, "root").select("hi", "lo", "copies", "component_id"), "classes")
    some = common.hot_join(rows.where("n > 0").select("doc_id", "n", "hi", "lo"), classes, ["hi", "lo"], "copies", n_rows).select("doc_id", "n", "component_id")
    all_rows = some.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return all_rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


#: All pairs that share a shingle: for small tables, by definition.
ORACLE = """
WITH word AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), shingle AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM word
), one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM shingle
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE r(id, root) AS (SELECT doc_id, doc_id FROM shingle UNION SELECT l.b, r.root FROM r JOIN link l ON l.a = r.id) SELECT id, min(root) AS root FROM r GROUP BY id
)
SELECT s.doc_id, len(s.s) AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept FROM shingle s JOIN reach r ON r.id = s.doc_id
"""
