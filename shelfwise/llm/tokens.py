"""Token ids of two vocabularies, as the tokenizers library gives them, faster for common text.

Texts of common characters are encoded by equivalent quicker means (rank merging of the same vocabulary; a bounded memo
of words). All other texts go through the tokenizers library itself. Ids are little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
import unicodedata
from array import array

#: Words a memo holds before it starts anew: bounds a worker's memory.
MEMO = 300_000
#: Characters on which the library's and the quick split agree: printable ASCII and Latin letters, tab and line feed.
COMMON = re.compile(r"[\t\n\r\x20-\x7e¡-©«-±´¶-¸»¿-ž]*")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the path is a parameter of all encoders."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pack(ids) -> bytes:
    return array("I", ids).tobytes()


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print stand for themselves, others for code points from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class _Words:
    """Splits common text into words and keeps their ids in a memo."""

    WORD: re.Pattern

    def __init__(self, path: str, ranks: dict[bytes, int], end: str = ""):
        import tiktoken

        self.path, self.memo, self.end = path, {}, end
        with open(path, encoding="utf-8") as f:
            special = {t["content"] for t in json.load(f)["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special))) if special else re.compile(r"(?!)")
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def prepared(self, text: str) -> str | None:
        """What is split; None if the library has to do it."""
        return text if COMMON.fullmatch(text) and not self.special.search(text) else None

    def __call__(self, text: str) -> bytes:
        if (ready := self.prepared(text)) is None:
            return _pack(_library(self.path).encode(text, add_special_tokens=False).ids)
        words, memo = self.WORD.findall(ready), self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            if len(memo) > MEMO:
                memo = self.memo = {}
            for w in words:
                if w not in memo:
                    memo[w] = _pack(self.merge(w + self.end))
            return b"".join([memo[w] for w in words])


class ByteBpe(_Words):
    """byte_bpe_50k.json; the ranks file beside it has the same vocabulary."""

    WORD = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            super().__init__(path, {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)})


class WordBpe(_Words):
    """word_bpe_49k.json: lower case, white space dropped. A zero byte, which common text lacks, stands for a word's end."""

    WORD = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        byte = _byte_of()
        ranks = {}
        for token, i in _library(path).get_vocab(with_added_tokens=False).items():
            body, end = (token[:-4], b"\0") if token.endswith("</w>") and token != "</w>" else (token, b"")
            if all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + end] = i
        super().__init__(path, ranks, "\0")

    def prepared(self, text: str) -> str | None:
        return text.lower() if super().prepared(text) is not None and unicodedata.is_normalized("NFC", text) else None


@functools.cache
def encoder(kind: str, path: str):
    """One for each worker process, so that its memo serves all of its tasks."""
    return {"byte": ByteBpe, "word": WordBpe}[kind](path)
