"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback.

Encoding is exact and takes linear time: Aho-Corasick finds all pieces in a stretch of text; from left to right the
longest piece is taken that is compatible with the one before, and where none is left, the last piece gives way to its
next shorter one. A bitfield marks the positions that failed, so none is tried twice. Two adjacent pieces are compatible
if merging their joined characters anew gives just these two: the merges that made the facing ends of both are followed
again, to see whether one over their bound would have come first.

No piece runs from another character into a space mark, nor over a line feed, so text is cut there, and a bounded memo
holds the ids of the stretches between. Characters that are no piece become byte pieces.

Defined results: a null text is empty and gives the begin and end ids alone; very long texts, words and runs of spaces
are encoded whole, in linear time; rows with a null doc_id take no part; rows that repeat a doc_id get one row each;
pieces of one score merge leftmost first, as in the library; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm import common, tokens

SPACE = "▁"
#: Stretches and pairs that a memo holds before it starts anew; of stretches, the memo before is kept to take from.
MEMO = 250_000


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        n = model.get_piece_size()
        self.byte, self.score, self.pieces, self.id = {}, {}, {}, {}
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)], self.text[i] = i, bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not model.is_control(i) and not model.is_unused(i):
                self.id[piece], self.score[piece], self.pieces[i] = i, model.get_score(i), piece
                self.text[i] = piece.replace(SPACE, " ").encode()
        self.single = {p for p in self.id if len(p) == 1}
        inner = [p for p in self.id if len(p) > 1]
        if SPACE not in self.id or any(SPACE in p.lstrip(SPACE) or "\n" in p or not set(p) <= self.single for p in inner):
            raise ValueError("pieces that run into a space mark, over a line feed or hold characters that are no piece are not supported")
        self.find = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.find.add_word(p, (len(p), i))
        self.find.make_automaton()
        self.cut = re.compile(r" *[^ \n]+|\n| +")
        self.unknown = re.compile("[^" + re.escape("".join(sorted(self.single))) + "]")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        self.half: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[int, int], list] = {}
        #: Characters of each piece, and its longest proper prefix that is a piece.
        self.size = [len(self.pieces.get(i, "")) for i in range(n)]
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p in (self.pieces.get(i, "") for i in range(n))]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, best score first and leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not scored:
                break
            k = -max(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that merging joins last into this one; None if it doesn't make it."""
        if (known := self.half.get(piece, 0)) != 0:
            return known
        parts = list(piece)
        while len(parts) > 2:
            scored = [(self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not scored:
                break
            k = -max(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.half[piece] = found = tuple(parts) if len(parts) == 2 else None
        return found

    def spine(self, i: int, side: int) -> list[tuple[str, float, float]]:
        """What stands at a piece's left (0) or right (1) end while it is merged: (piece, merged at, merged away at); times are negated scores."""
        if (known := self.spines.get((i, side))) is None:
            piece, until, known = self.pieces[i], float("inf"), []
            while True:
                since = -self.score[piece] if len(piece) > 1 else -float("inf")
                known.append((piece, since, until))
                if len(piece) == 1:
                    break
                piece, until = self.halves(piece)[side], since
            self.spines[i, side] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging both pieces' characters anew gives just these two: no merge over their bound comes while its parts stand there."""
        if (known := self.pair.get((a, b))) is None:
            if len(self.pair) > MEMO:
                self.pair.clear()
            known = self.pair[a, b] = self.reachable(a) and self.reachable(b) and self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        for one, s1, e1 in self.spine(a, 1):
            for two, s2, e2 in self.spine(b, 0):
                if (score := self.score.get(one + two)) is not None:
                    at = max(-score, s1, s2)
                    if -score <= max(s1, s2) or at in (e1, e2) or s1 >= e1 or s2 >= e2:  # out of order or at once: merge it all
                        return self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
                    if at < e1 and at < e2:
                        return False
        return True

    def reachable(self, i: int) -> bool:
        """Whether merging a piece's characters gives that piece."""
        return len(self.pieces[i]) == 1 or self.halves(self.pieces[i]) is not None

    def backtrack(self, text: str) -> list[int]:
        """Ids of text whose characters all are pieces."""
        n = len(text)
        longest = [-1] * n
        for end, (length, i) in self.find.iter(text):
            longest[end - length + 1] = i  # ends come in order, so the longest stays
        failed = bytearray((n >> 3) + 1)
        ids: list[int] = []
        pair, size, shorter, any_failed = self.pair, self.size, self.shorter, False
        place, i, last = 0, longest[0], -1
        while place < n:
            while i >= 0:
                end = place + size[i]
                if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        good = self.reachable(i)
                    elif (good := pair.get((last, i))) is None:
                        good = self.compatible(last, i)
                    if good:
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                last, place = i, end
                i = longest[place] if place < n else -1
            else:
                failed[place >> 3] |= 1 << (place & 7)
                any_failed = True
                i = ids.pop()
                place -= size[i]
                i = shorter[i]
                last = ids[-1] if ids else -1
        return ids

    def stretch(self, text: str) -> list[int]:
        """Ids of a run of spaces (if any) and what follows up to the next."""
        text, ids, place = text.replace(" ", SPACE), [], 0
        for m in self.unknown.finditer(text):
            ids += self.backtrack(text[place : m.start()]) if m.start() > place else []
            ids += [self.byte[b] for b in m[0].encode("utf-8", "replace")]
            place = m.end()
        return ids + (self.backtrack(text[place:]) if place < len(text) else [])

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit bytes."""
        memo = self.memo
        parts = self.cut.findall(" " + text.replace(SPACE, " ")) if text else []
        try:
            data = b"".join([memo[p] for p in parts])
        except KeyError:
            if len(memo) > MEMO:
                self.older, memo = memo, {}
                self.memo = memo
            older = self.older
            for p in parts:
                if p not in memo:
                    memo[p] = older.get(p) or array("I", self.stretch(p)).tobytes()
            data = b"".join([memo[p] for p in parts])
        return self.begin.to_bytes(4, "little") + data + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of such ids; the mark that encoding puts first goes."""
        data = b"".join(map(self.text.__getitem__, array("I", ids)))
        return data.removeprefix(b" ").decode("utf-8", "replace").encode()


@functools.cache
def model(path: str) -> PieceModel:
    """One for each worker process, so that its memos serve all of its tasks."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with whole also the ids (bytes) and the decoded text."""
    common.small_batches(docs.sparkSession)
    path = path or tokens.vocabulary("piece_bpe_32k.model")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.binary()), ("decoded", pa.string())] * whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), common.words_of(b.column(1)), strict=True):
                ids = own.encode(text)
                back = own.decode(ids)
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                rows.append(row + (ids, back.decode()) * whole)
            yield common.batch(schema, *(zip(*rows, strict=True) if rows else [[]] * len(schema)))

    return common.own_ids(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * whole)
