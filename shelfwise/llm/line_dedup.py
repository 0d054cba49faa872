"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

State, as tables in one folder: `postings` (key, doc_id) for every document that holds a long line, appended by each
insertion; `deleted` (doc_id), appended by each deletion; `refs` (key, n_docs, last_doc), exact and replaced a version
at a time; `filters` (shard, keys, filter), cuckoo filters of the keys that are repeated now. A key that becomes repeated
is inserted in its shard's filter, one that no longer is gets deleted from it, so both directions stay incremental; a
filter that would be too full is built anew from the exact table. Filters are never gathered: postings are dealt to
their shard and meet its filter there, and what passes meets the exact table. `manifest` is written last, so that
LineStore.open() finds the last whole state after a lost driver. Many small tables are merged into one.

A line's key is its 128-bit XXH3 after stripping [\\x20\\x09-\\x0D] at both ends and lower-casing A-Z. Lines of a
repeated key go, but for those in the largest doc_id that holds it.

Every posting meets a filter. A shard with many postings, such as that of a hot key, has them dealt over as many copies of
its filter. In the exact table hot keys (more than a fixed share of what passed, so at most common.HOT_KEYS) are broadcast.

Defined results: a null or empty text is one empty line; very long texts and lines are read whole; rows with a null
doc_id take no part; rows that repeat a doc_id are one document that holds the lines of all of them, and each gets a row;
inserting a doc_id again replaces it; ties can't be (the largest doc_id is one); an empty table gives an empty result;
extra columns are kept by dedup_lines(), but for its own n_lines and n_dropped, which replace an input's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import common

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys that a filter shard is made for, and postings that meet a copy of it in one group.
SHARD_KEYS, GROUP_ROWS = 1 << 12, 1 << 13
#: Bits of the digest of documents that lose lines, at most: it is broadcast, and a fuller one only lets more documents pass.
DIGEST_BITS = 1 << 28
#: Tables of postings and deletions that a store keeps before it merges them.
TABLES = 8
#: So many shards that a number for each may be broadcast: 3 MB.
FEW_SHARDS = 1 << 18
SLOTS, LOAD = 4, 0.85


class CuckooFilter:
    """16-bit fingerprints, four to a bucket; what finds no place is kept whole in a stash, so there are no false negatives."""

    def __init__(self, table: np.ndarray, stash: dict[int, int] | None = None):
        self.table, self.stash, self.mask = table, stash or {}, len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, hi: np.ndarray, lo: np.ndarray):
        """Fingerprint (never 0) and both buckets of each key."""
        mark = (lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (hi.view(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995 >> 7)) & self.mask

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, one, two in zip(*self.places(hi, lo), strict=True):
            self._place(mark, int(one), int(two))

    def _place(self, mark, one: int, two: int) -> None:
        at = one
        for turn in range(200):
            for bucket in (at, two) if turn == 0 else (at,):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    return
            slot = turn % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(self.other(np.int64(at), mark))
        self.stash[at << 16 | int(mark)] = self.stash.get(at << 16 | int(mark), 0) + 1

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Of keys that were inserted only: a filter can't tell others apart."""
        for mark, one, two in zip(*self.places(hi, lo), strict=True):
            for bucket in (int(one), int(two)):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
                if self.stash.get(bucket << 16 | int(mark), 0) > 0:
                    self.stash[bucket << 16 | int(mark)] -= 1
                    break

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hi, lo)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.stash:
            kept = np.fromiter((k for k, n in self.stash.items() if n > 0), np.int64)
            found |= np.isin(one << 16 | mark, kept) | np.isin(two << 16 | mark, kept)
        return found

    def to_bytes(self) -> bytes:
        stash = np.array([(k, n) for k, n in self.stash.items() if n > 0], np.int64).reshape(-1, 2)
        return np.int64([len(self.table), len(stash)]).tobytes() + self.table.tobytes() + stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, n = np.frombuffer(data, np.int64, 2)
        end = 16 + int(buckets) * SLOTS * 2
        stash = np.frombuffer(data, np.int64, int(n) * 2, end).reshape(-1, 2)
        return cls(np.frombuffer(data, np.uint16, int(buckets) * SLOTS, 16).reshape(-1, SLOTS).copy(), dict(stash.tolist()))


def keyed_lines(text: bytes | None, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """(line, key) of each line; key None for short ones."""
    text = text or b""
    out = []
    for line, low in zip(text.split(b"\n"), text.lower().split(b"\n"), strict=True):
        key = low.strip()
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append((line, xxhash.xxh3_128_digest(key) if long else None))
    return out


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id), once for each document and long key in it."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), common.raw(b.column(1)), strict=True):
                own = {k for _, k in keyed_lines(text, min_chars) if k}
                keys += own
                ids += [doc_id] * len(own)
            both = _halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], schema=schema)

    return common.own_ids(docs).mapInArrow(run, "hi long, lo long, doc_id long")


def reference_counts(held: DataFrame) -> DataFrame:
    """Exact counts. Partial sums are made before the shuffle, so a line that all documents share is a row for each task."""
    return held.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(repeated: DataFrame, n_shards: int) -> DataFrame:
    """(shard, keys, filter) of the repeated keys; a shard has about SHARD_KEYS of them."""

    def build(pdf):
        import pandas as pd

        f = CuckooFilter.sized(len(pdf))
        f.insert(pdf.hi.to_numpy(), pdf.lo.to_numpy())
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "keys": [len(pdf)], "filter": [f.to_bytes()]})

    return repeated.select(_shard(n_shards), "hi", "lo").groupBy("shard").applyInPandas(build, "shard int, keys long, filter binary")


def _shard(n: int):
    return F.pmod(F.col("hi").bitwiseXOR(F.col("lo")), F.lit(n)).cast("int").alias("shard")


class Digest:
    """A bitmap of numbers with two bits each: says no only of numbers that it doesn't hold."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(ids: np.ndarray, mask: np.uint64):
        x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x >> np.uint64(32) & mask, (x ^ x >> np.uint64(17)) & mask

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        one, two = self.places(ids, self.mask)
        bit = lambda x: self.bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1
        return (bit(one) & bit(two)).astype(bool)

    @classmethod
    def of(cls, ids: DataFrame, n: int, most: int = DIGEST_BITS) -> Digest:
        """Of a column of longs. Each task sends the bytes of its segments, so the driver gets the bitmap, not the ids."""
        size = 1 << int(np.clip(np.ceil(np.log2(max(1, n) * 16)), 12, np.log2(most)))
        segment, mask = min(size, 1 << 18), np.uint64(size - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for b in batches:
                for at in cls.places(b.column(0).to_numpy(), mask):
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            parts = bits.reshape(-1, segment // 8)
            used = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["part", "bits"])

        def either(pdf):
            import pandas as pd

            return pd.DataFrame({"part": [int(pdf.part.iloc[0])], "bits": [np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in pdf.bits])).tobytes()]})

        found = ids.mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary")
        bits = np.zeros((size // segment, segment // 8), np.uint8)
        for r in found.collect():
            bits[r.part] = np.frombuffer(r.bits, np.uint8)
        return cls(bits.reshape(-1))


class LineStore:
    """Reversible line dedup: insert and delete documents in batches, and drop lines by what the store holds then."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        common.small_batches(spark)
        self.spark, self.path, self.min_chars, self.min_docs = spark, path or common.new_path(spark, "lines"), min_chars, min_docs
        self.version, self.n_shards, self.n_postings = 0, 1, 0
        self.tables: dict[str, str] = {}
        self.batches: list[tuple[int, str]] = []
        self.deleted: list[tuple[int, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineStore:
        """The last whole state that was written in this folder."""
        last = spark.read.schema("version long, state string").parquet(f"{path}/manifest-*").orderBy(F.desc("version")).first()
        state = json.loads(last.state)
        store = cls(spark, path, state.pop("min_chars"), state.pop("min_docs"))
        for name, value in state.items():
            setattr(store, name, value)
        return store

    def _kept(self) -> LineStore:
        names = ("min_chars", "min_docs", "version", "n_shards", "n_postings", "tables", "batches", "deleted")
        state = json.dumps({n: getattr(self, n) for n in names})
        self.spark.range(1).select(F.lit(self.version).cast("long").alias("version"), F.lit(state).alias("state")).write.parquet(f"{self.path}/manifest-{self.version}")
        return self

    SCHEMAS = {"postings": "hi long, lo long, doc_id long", "deleted": "doc_id long", "refs": "hi long, lo long, n_docs long, last_doc long", "filters": "shard int, keys long, filter binary"}

    def _write(self, df: DataFrame, name: str) -> str:
        at = f"{name}-{self.version}"
        df.write.mode("overwrite").parquet(f"{self.path}/{at}")  # over what a lost driver left
        return at

    def _read(self, at: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMAS[at.split("-")[0]]).parquet(f"{self.path}/{at}")

    @property
    def refs(self) -> DataFrame:
        return self._read(self.tables["refs"])

    @property
    def filters(self) -> DataFrame:
        return self._read(self.tables["filters"])

    def held(self) -> DataFrame:
        """Postings of all documents that are in the store."""
        out = None
        for k, at in self.batches:
            rows = self._read(at)
            for j, gone in self.deleted:
                if j > k:  # a document may come back after its deletion
                    rows = rows.join(self._read(gone), "doc_id", "left_anti").select("hi", "lo", "doc_id")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], self.SCHEMAS["postings"])

    def insert(self, docs: DataFrame) -> LineStore:
        """Documents that the store holds already are replaced, so a batch that is inserted again changes nothing."""
        own = common.own_ids(docs)
        if self.batches:
            ids = own.select("doc_id").distinct()
            again = common.written(self.held().select("doc_id").distinct().join(ids, "doc_id", "left_semi"), "again")
            if not again.isEmpty():
                self.delete(again)
        self.version += 1
        found = postings(own, self.min_chars)
        twice = common.written(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
        if not twice.isEmpty():
            found = common.written(found, "found")
            found = found.join(twice, "doc_id", "left_anti").unionByName(found.join(twice, "doc_id", "left_semi").distinct()).select("hi", "lo", "doc_id")
        at = self._write(found, "postings")
        self.batches.append((self.version, at))
        return self._count(reference_counts(self._read(at)), None)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """doc_ids: a table with doc_id. Only keys that those documents hold are counted anew."""
        self.version += 1
        at = self._write(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "deleted")
        touched = self.held().join(self._read(at), "doc_id", "left_semi").select("hi", "lo").distinct()
        touched = common.written(touched, "touched")
        self.deleted.append((self.version, at))
        return self._count(None, touched)

    def _merge(self) -> None:
        if len(self.batches) + len(self.deleted) > TABLES:
            self.batches, self.deleted = [(self.version, self._write(self.held(), "postings-merged"))], []

    def _count(self, new: DataFrame | None, touched: DataFrame | None) -> LineStore:
        old = self.refs if "refs" in self.tables else None
        if old is None:
            refs = new if new is not None else reference_counts(self.held())
        elif new is not None:
            refs = old.unionByName(new).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        else:
            kept = reference_counts(self.held().join(touched, ["hi", "lo"], "left_semi"))
            refs = old.join(touched, ["hi", "lo"], "left_anti").unionByName(kept)
        self.tables["refs"] = self._write(refs.select("hi", "lo", "n_docs", "last_doc"), "refs")
        self._merge()
        return self._refilter(old)._kept()

    def repeated(self, refs: DataFrame | None = None) -> DataFrame:
        return (self.refs if refs is None else refs).where(F.col("n_docs") >= self.min_docs)

    def _refilter(self, old: DataFrame | None) -> LineStore:
        now = self.repeated()
        self.n_postings, keys = self.refs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.count_if(F.col("n_docs") >= self.min_docs)).first()
        if "filters" not in self.tables or old is None or keys > 2 * SHARD_KEYS * self.n_shards:
            self.n_shards = max(1, -(-keys // SHARD_KEYS))
            self.tables["filters"] = self._write(build_filters(now, self.n_shards), "filters")
            return self
        before, n = self.repeated(old), self.n_shards
        turn = now.join(before, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(True).alias("come")).unionByName(before.join(now, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(False).alias("come")))

        def change(key, turns, filters):
            import pandas as pd

            come, go = turns[turns.come], turns[~turns.come]
            keys = (int(filters["keys"].iloc[0]) if len(filters) else 0) + len(come) - len(go)
            f = CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else CuckooFilter.sized(keys)
            if keys > LOAD * f.table.size or f.stash:  # too full: to be built anew
                return pd.DataFrame({"shard": [int(key[0])], "keys": [keys], "filter": [b""]})
            f.delete(go.hi.to_numpy(), go.lo.to_numpy())
            f.insert(come.hi.to_numpy(), come.lo.to_numpy())
            return pd.DataFrame({"shard": [int(key[0])], "keys": [keys], "filter": [f.to_bytes()]})

        moved = turn.select(_shard(n), "hi", "lo", "come").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(change, self.SCHEMAS["filters"])
        moved = common.written(moved, "moved")
        full = moved.where(F.length("filter") == 0).select("shard")
        anew = build_filters(now.withColumn("shard", _shard(n)).join(full, "shard", "left_semi"), n)
        self.tables["filters"] = self._write(moved.where(F.length("filter") > 0).unionByName(anew), "filters")
        return self

    def passing(self, rows: DataFrame) -> DataFrame:
        """The postings whose key its shard's filter knows. Each group is a part of a shard's postings and a copy of its filter."""
        sizes = self.refs.select(_shard(self.n_shards), "n_docs").groupBy("shard").agg(F.sum("n_docs").alias("n"))
        parts = sizes.select("shard", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
        few = F.broadcast if self.n_shards <= FEW_SHARDS else lambda x: x
        dealt = rows.withColumn("shard", _shard(self.n_shards)).join(few(parts), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).drop("parts")
        copies = self.filters.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def known(one: pa.Table, two: pa.Table) -> pa.Table:
            one = one.select(["hi", "lo", "doc_id"])
            if not one.num_rows or not two.num_rows:
                return one.slice(0, 0)
            f = CuckooFilter.from_bytes(two.column("filter")[0].as_py())
            return one.filter(pa.array(f.holds(one.column("hi").to_numpy(), one.column("lo").to_numpy())))

        return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(known, self.SCHEMAS["postings"])

    def drops(self) -> DataFrame:
        """(doc_id, __keys) of the documents that lose lines: keys that a filter passes and the exact table confirms."""
        passed = common.written(self.passing(self.held()), "passed")
        found = common.hot_join(passed, self.repeated().select("hi", "lo", "last_doc", "n_docs"), ["hi", "lo"], "n_docs", passed.count()).where("doc_id < last_doc")
        return common.written(found.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("__keys")), "drops")

    def dedup(self, docs: DataFrame, kept: bool = True) -> DataFrame:
        """docs with repeated lines gone from text, and n_lines (before) and n_dropped. docs must be in the store.

        A digest of the documents that lose lines lets the others be finished where they are read; only the text of
        those is shuffled, to meet its keys. kept=False: (doc_id, n_lines, n_dropped, kept_sha256).
        """
        drops = self.drops()
        digest = self.spark.sparkContext.broadcast(Digest.of(drops.select("doc_id"), drops.count()))
        if not kept:
            docs = common.own_ids(docs)
        else:
            docs = docs.where("doc_id is not null").drop("n_lines", "n_dropped")
        hit, keys, other = (common.fresh(docs, name) for name in ("__hit", "__keys", "__doc_id"))
        unmarked = docs.withColumn(hit, F.lit(0))
        marked = unmarked.mapInArrow(_mark(digest, hit), unmarked.schema)
        lines = F.when(F.col("text").isNull(), 1).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        first = marked.where(F.col(hit) == 0).select(*docs.columns, lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
        met = marked.where(F.col(hit) == 1).drop(hit).join(drops.withColumnsRenamed({"doc_id": other, "__keys": keys}).hint("merge"), F.col("doc_id") == F.col(other), "left").drop(other)
        last = met.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")})
        last = last.mapInArrow(_drop(self.min_chars, keys), last.schema).drop(keys)
        out = first.unionByName(last)
        if not kept:
            return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
        return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def _mark(digest, to: str):
    """Sets a column to 1 on the documents that may lose lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = digest.value(b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield b.set_column(b.schema.get_field_index(to), to, pa.array(hit))

    return run


def _drop(min_chars: int, by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, dropped = [], [], []
            for text, keys in zip(common.raw(b.column("text")), b.column(by).to_pylist(), strict=True):
                lines = keyed_lines(text, min_chars) if keys else None
                gone = {np.int64([k["hi"], k["lo"]]).tobytes() for k in keys or ()}
                stay = [line for line, k in lines if k not in gone] if gone else None
                counts.append(len(lines) if lines else (text or b"").count(b"\n") + 1)
                dropped.append(len(lines) - len(stay) if gone else 0)
                texts.append(b"\n".join(stay) if gone and text is not None else text)
            new = {"text": pa.array(texts, pa.binary()).cast(b.schema.field("text").type), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            for name, column in new.items():
                b = b.set_column(b.schema.get_field_index(name), name, column)
            yield b

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, kept: bool = True) -> DataFrame:
    """One batch: all documents inserted in a new store, then deduplicated by it."""
    return LineStore(docs.sparkSession, None, min_chars, min_docs).insert(docs).dedup(docs, kept)


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their own columns, repeated lines gone from text, and n_chars, if there is one, that of the new text.

    Rows without doc_id stay as they are; columns named n_lines and n_dropped keep the input's values.
    """
    taken = {c: common.fresh(docs, "__" + c) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    own = docs.withColumnsRenamed(taken)
    out = dedup_lines(own, min_chars, min_docs).select(*own.columns)
    return out.unionByName(own.where("doc_id is null")).withColumnsRenamed({v: k for k, v in taken.items()})


ORACLE = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id < r.last_doc AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
