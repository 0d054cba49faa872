"""Fill-in-the-middle by a secondary sort.

Each text is cut at two places that its doc_id alone decides; prefix, middle and suffix are cut further into chunks of
CHUNK units (a unit is a code point), and every chunk is a piece keyed by document and by its place in the output.
Pieces are dealt by document and sorted by that place within partitions (the DataFrame form of
repartitionAndSortWithinPartitions, which keeps them in Tungsten's rows and lets a sort spill), so a task reads each output
from start to end as a stream into a running digest. The same pass reads the marks in the output, which tell the part of each
piece and with it its place in the restored text; a second sort within the same partitions, no further shuffle, streams
the pieces in that order into the second digest. No task holds more of a document than a piece, nor more than one
document's state.

Defined results: null text is empty, an empty text is plain; very long texts are read whole; rows with a null doc_id take
no part; rows that repeat a doc_id, or are equal, get a row each; an empty table gives an empty result; other columns
play no part in digests() and are kept by transformed(), whose own columns replace an input's of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common

# The marks, and the parts of each form in the order of its output.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Of 100 documents so many at least stay plain, and of those that don't so many put the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
CHUNK = 1 << 14
_RESTORED = ("prefix", "middle", "suffix")
_KEY = ("doc_id", "content", "copy")


def plan(doc_id: int, text: str) -> tuple[str, int, int]:
    """Form, and the ends of prefix and middle."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[at : at + 8], 16) for at in (0, 8, 16, 24))
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in MARKS.values()):
        return "plain", 0, 0
    one, two = h1 % (len(text) + 1), h2 % (len(text) + 1)
    return "spm" if h4 % 100 < SPM_BELOW else "psm", min(one, two), max(one, two)


def parts(text: str, form: str, one: int, two: int) -> list[tuple[str, int, int]]:
    """(mark, start, end) of the parts, in the order of the output."""
    if form == "plain":
        return [("", 0, len(text))]
    ends = {"prefix": (0, one), "middle": (one, two), "suffix": (two, len(text))}
    return [(MARKS[name], *ends[name]) for name in FORMS[form]]


def output(text: str, form: str, one: int, two: int) -> str:
    return "".join(mark + text[start:end] for mark, start, end in parts(text, form, one, two))


def restore(out: str, form: str) -> str:
    """The text, from its output and form alone."""
    if form == "plain":
        return out
    found = {}
    for name in reversed(FORMS[form]):
        out, _, found[name] = out.rpartition(MARKS[name])
    return "".join(found[name] for name in _RESTORED)


_PIECES = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("form", pa.string()), ("text", pa.string())])
_PLACED = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("copy", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("text", pa.string()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_BATCH_CHARS = 1 << 21


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches that hold a bounded number of characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[text] or "") if text is not None else 0)
        if size > _BATCH_CHARS:
            yield common.batch(schema, *zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield common.batch(schema, *zip(*held, strict=True))


def pieces(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, content, copy, at, form, text): chunks of the outputs, a mark in front of each part's first.

    content is a hash of the text and copy tells equal rows apart; neither depends on the order in which a partition's
    rows come, so a task that runs again makes the same keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[tuple[int, int], int] = {}
        base = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc_id, raw in zip(b.column(0).to_pylist(), common.raw(b.column(1)), strict=True):
                    content = xxhash.xxh3_64_intdigest(raw or b"") - (1 << 63)
                    copy = copies[doc_id, content] = copies.get((doc_id, content), -1) + 1
                    text = (raw or b"").decode("utf-8", "replace")
                    form, one, two = plan(doc_id, text)
                    at = 0
                    for mark, start, end in parts(text, form, one, two):
                        for cut in range(start, max(end, start + 1), chunk):
                            piece = text[cut : min(cut + chunk, end)]
                            if cut == start:
                                piece = mark + piece
                            yield doc_id, content, base + copy, at, form, piece
                            at += len(piece)

        yield from _batches(rows(), _PIECES, 5)

    return common.own_ids(docs).mapInArrow(run, _ddl(_PIECES))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the output → pieces with their place in the restored text, and a last row with the output's digest."""
    order = {mark: _RESTORED.index(name) for name, mark in MARKS.items()}

    def rows() -> Iterator[tuple]:
        key = None
        for doc_id, content, copy, _, form, text in _rows(batches):
            if key != (doc_id, content, copy):
                if key is not None:
                    yield end()
                key, digest, lengths, part, kind = (doc_id, content, copy), hashlib.sha256(), [0, 0, 0], 0, form

                def end(key=key, digest=digest, lengths=lengths, kind=kind) -> tuple:
                    cuts = (None, None) if kind == "plain" else lengths[:2]
                    return (*key, 3, 0, None, kind, *cuts, digest.hexdigest())

            digest.update(text.encode())
            if form != "plain" and text[:3] in order:  # a text with marks of its own is plain
                part, text = order[text[:3]], text[3:]
            yield (*key, part, lengths[part], text, None, None, None, None)
            lengths[part] += len(text)
        if key is not None:
            yield end()

    return _batches(rows(), _PLACED, 5)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the text, each document's last row behind them → a row a document."""

    def rows() -> Iterator[tuple]:
        digest, n = hashlib.sha256(), 0
        for doc_id, _, _, part, _, text, form, one, two, sha in _rows(batches):
            if part < 3:
                digest.update(text.encode())
                n += len(text)
            else:
                yield doc_id, n, form, one, two, sha, digest.hexdigest()
                digest, n = hashlib.sha256(), 0

    return _batches(rows(), _DIGESTS)


def digests(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    common.small_batches(docs.sparkSession)
    dealt = pieces(docs, chunk).repartition(*_KEY).sortWithinPartitions(*_KEY, "at")
    placed = dealt.mapInArrow(_place, _ddl(_PLACED)).sortWithinPartitions(*_KEY, "part", "at")
    return placed.mapInArrow(_restore, _ddl(_DIGESTS))


def transformed(docs: DataFrame) -> DataFrame:
    """docs with text transformed and form, prefix_chars, middle_chars; rows without doc_id stay plain. Made where a row is read, for training files."""
    kept = [c for c in docs.columns if c.lower() not in ("form", "prefix_chars", "middle_chars")]
    out = docs.select(*kept, F.lit("plain").alias("form"), F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, forms, ones, middles = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), common.words_of(b.column("text")), strict=True):
                form, one, two = plan(doc_id, text) if doc_id is not None else ("plain", 0, 0)
                texts.append(output(text, form, one, two))
                forms.append(form)
                ones.append(None if form == "plain" else one)
                middles.append(None if form == "plain" else two - one)
            for name, column in (("text", texts), ("form", forms), ("prefix_chars", ones), ("middle_chars", middles)):
                field = b.schema.field(name)
                b = b.set_column(b.schema.get_field_index(name), field.with_nullable(True), pa.array(column, field.type))
            yield b

    return out.mapInArrow(run, out.schema)


def restored(rows: DataFrame) -> DataFrame:
    """transformed() undone: the text rebuilt from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field = b.schema.field("text")
            text = [restore(t, form) for t, form in zip(common.words_of(b.column("text")), b.column("form").to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("text"), field, pa.array(text, field.type))

    return rows.mapInArrow(run, rows.schema)


ORACLE = """
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL
), hashed AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM doc
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), part AS (
  SELECT *, substring(text, 1, one) AS prefix, substring(text, one + 1, two - one) AS middle, substring(text, two + 1, n - two) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN one END AS prefix_chars, CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM part
"""
