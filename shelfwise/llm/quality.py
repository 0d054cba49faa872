"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Each byte, with a mark of whether it repeats what
stood a few bytes before, is embedded, learned filters run over the chunk, and the largest response of each filter in the
chunk is kept. The chunks' responses are combined by their mean and their largest, and a small dense net makes one
probability of them.

It is trained on at most SAMPLE labelled rows (those with the smallest hash of doc_id) of together at most SAMPLE_BYTES
bytes of text; both bounds are parameters. Training sees all chunks of those texts, and runs on the driver with a fixed
seed. Rows whose crc32(doc_id as text) mod 5 is 0 are held out. labels, lang, source and doc_id are no inputs. Every text
is scored whole.

Defined results: null or empty text is scored as one chunk of padding; very long texts are scored by blocks of chunks;
rows with a null doc_id take no part; labels that are null or are not 0 or 1 are left out; of a doc_id's labels the
largest counts, of its texts the last in order is trained on; without any label all scores are 0.5; rows that repeat a
doc_id get one row each; a score at the threshold is predicted 1; an empty table gives an empty result; reject() keeps
extra columns, whatever their names, and rows without doc_id as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common

SAMPLE, SAMPLE_BYTES, SEED, THRESHOLD = 3000, 48 << 20, 7, 0.3
#: Bytes of a chunk and from one chunk's start to the next (odd, so that windows begin at all places); bytes a filter sees and steps by.
CHUNK, HOP, WIDTH, STEP = 512, 449, 8, 4
EMBED, FILTERS, HIDDEN = 8, 40, 24
#: Chunks that go through the net at once.
BLOCK = 512
PAD = 0
#: A symbol's offset for bytes that repeat what stood a few bytes before, and how few.
SAME, LAGS = 256, 40


def symbols(text: bytes | None) -> np.ndarray:
    """A symbol for each byte: the byte, and SAME more where it and the three after it stood the same up to LAGS bytes before."""
    data = np.frombuffer(text or b"", np.uint8)
    out = data.astype(np.uint16)
    if len(data) > 4:
        four = data[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            four |= data[k : len(data) - 3 + k].astype(np.uint32) << 8 * k
        same = np.zeros(len(four), bool)
        for lag in range(1, min(LAGS, len(four) - 1) + 1):
            same[lag:] |= four[lag:] == four[:-lag]
        out[: len(four)] += same.astype(np.uint16) * SAME
    return out


def chunks(text: bytes | None) -> np.ndarray:
    """(n, CHUNK) symbols; the last is filled up with PAD."""
    data = symbols(text)
    n = max(1, -(-max(0, len(data) - (CHUNK - HOP)) // HOP))
    full = np.full((n - 1) * HOP + CHUNK, PAD, np.uint16)
    full[: len(data)] = data
    return np.lib.stride_tricks.as_strided(full, (n, CHUNK), (2 * HOP, 2))


class ByteNet:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, seed: int = SEED) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(
            {
                "embed": draw(2 * SAME, EMBED, by=0.5),
                "conv": draw(WIDTH * EMBED, FILTERS, by=(1 / (WIDTH * EMBED)) ** 0.5),
                "conv_b": np.zeros(FILTERS, np.float32),
                "dense": draw(2 * FILTERS, HIDDEN, by=(1 / FILTERS) ** 0.5),
                "dense_b": np.zeros(HIDDEN, np.float32),
                "out": draw(HIDDEN, by=0.2),
                "out_b": np.zeros(1, np.float32),
            }
        )

    def windows(self, block: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED)"""
        seen = np.ascontiguousarray(self.w["embed"][block].reshape(len(block), -1))
        places = (CHUNK - WIDTH) // STEP + 1
        a, b = seen.strides
        return np.lib.stride_tricks.as_strided(seen, (len(block), places, WIDTH * EMBED), (a, STEP * EMBED * b, b))

    def pooled(self, block: np.ndarray, where: bool = False):
        """Each filter's largest response in each chunk, through a rectifier; with where, also its place."""
        seen = self.windows(block)
        flat = seen.reshape(-1, WIDTH * EMBED) @ self.w["conv"]
        flat = flat.reshape(len(block), -1, FILTERS)
        top = flat.max(1) + self.w["conv_b"]
        return (np.maximum(top, 0), flat.argmax(1)) if where else np.maximum(top, 0)

    def combine(self, responses: np.ndarray, starts: np.ndarray):
        """Document features: mean and largest over a document's chunks, whose first rows are starts."""
        counts = np.diff(np.append(starts, len(responses)))[:, None]
        return np.concatenate([np.add.reduceat(responses, starts, 0) / counts, np.maximum.reduceat(responses, starts, 0)], 1)

    def head(self, features: np.ndarray):
        hidden = np.tanh(features @ self.w["dense"] + self.w["dense_b"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_b"], -30, 30)))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = [chunks(t) for t in texts]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        responses, held, n = [], [], 0
        for p in parts:  # blocks of chunks, over the bounds of documents
            for at in range(0, len(p), BLOCK):
                held.append(p[at : at + BLOCK])
                n += len(held[-1])
                if n >= BLOCK:
                    responses.append(self.pooled(np.concatenate(held)))
                    held, n = [], 0
        if held:
            responses.append(self.pooled(np.concatenate(held)))
        return self.head(self.combine(np.concatenate(responses), starts))[1].astype(np.float64)

    def train(self, texts: list[bytes | None], labels: np.ndarray, rounds: int = 5, steps: int = 320, size: int = 48, rate: float = 4e-3, seed: int = SEED) -> ByteNet:
        """Adam on log loss, for so many rounds and steps at least, on all chunks of the texts."""
        rng, w = np.random.default_rng(seed), self.w
        parts = [chunks(t) for t in texts]
        first, second, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        batches = -(-len(parts) // size)
        rounds = max(rounds, -(-steps // batches))
        for turn in range(rounds):
            order = rng.permutation(len(parts))
            for at in range(0, len(order), size):
                own = order[at : at + size]
                grads = self._gradients([parts[i] for i in own], labels[own].astype(np.float32))
                t += 1
                now = rate * min(1, t / 30) * (1 - 0.95 * t / (rounds * batches))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] -= (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def _gradients(self, picked: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        w, block = self.w, np.concatenate(picked)
        counts = np.array([len(p) for p in picked])
        starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(picked)), counts)
        responses, place = self.pooled(block, where=True)
        features = self.combine(responses, starts)
        hidden, p = self.head(features)
        off = (p - labels) / len(labels)
        grads = {"out": hidden.T @ off, "out_b": off.sum(keepdims=True)}
        back = np.outer(off, w["out"]) * (1 - hidden**2)
        grads["dense"], grads["dense_b"] = features.T @ back, back.sum(0)
        to_features = back @ w["dense"].T
        largest = responses == features[owner, FILTERS:]
        ties = np.add.reduceat(largest, starts, 0)[owner]
        to_responses = to_features[owner, :FILTERS] / counts[owner][:, None] + to_features[owner, FILTERS:] * largest / np.maximum(ties, 1)
        to_responses *= responses > 0
        grads["conv_b"] = to_responses.sum(0)
        at = (place * STEP)[:, :, None] + np.arange(WIDTH)  # (chunks, filters, WIDTH)
        seen = block[np.arange(len(block))[:, None, None], at]
        window = w["embed"][seen].reshape(len(block), FILTERS, WIDTH * EMBED)
        grads["conv"] = np.einsum("cf,cfk->kf", to_responses, window)
        to_window = (to_responses[:, :, None] * w["conv"].T[None]).reshape(-1, EMBED)
        which = seen.reshape(-1)
        grads["embed"] = np.stack([np.bincount(which, to_window[:, k], 2 * SAME) for k in range(EMBED)], 1)
        return {k: g.astype(np.float32) for k, g in grads.items()}


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES, label: str = "quality") -> DataFrame:
    """(doc_id, text as bytes, label) to train on: the same rows for the same tables, bounded in rows and bytes."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = common.smallest(marked.groupBy("doc_id").agg(F.max("label").alias("label")), sample, "doc_id")
    rows = common.own_ids(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max(F.col("text").cast("binary")).alias("text"))
    return common.within(rows, F.length("text"), most, "doc_id").orderBy("doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> ByteNet | None:
    rows = sample_of(docs, labels, sample, label=label).collect()
    if not rows:
        if not docs.join(labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))), "doc_id", "left_semi").isEmpty():
            raise ValueError(f"no labelled text fits in {SAMPLE_BYTES} bytes")
        return None
    return ByteNet.start().train([bytes(r.text or b"") for r in rows], np.array([r.label for r in rows]))


def scores(docs: DataFrame, net: ByteNet | None, to: str = "score") -> DataFrame:
    """docs with one more column. It needs text; extra columns stay."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.withColumn(to, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            found = own.score(common.raw(b.column("text"))) if own else np.full(b.num_rows, 0.5)
            yield b.set_column(b.schema.get_field_index(to), pa.field(to, pa.float64(), False), pa.array(found))

    return out.mapInArrow(run, out.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found = scores(common.own_ids(docs), fit(docs, labels, sample))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without those scored under the threshold, with the columns of docs."""
    to = common.fresh(docs, "__score")
    return scores(docs, fit(docs, labels, sample), to).where(F.col(to) >= threshold).drop(to)
