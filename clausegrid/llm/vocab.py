"""Byte-level BPE vocabularies as the token operators use them inside tasks.

A vocabulary file is loaded once per Python worker. A byte-level ``.json`` file whose merges
come in the order of its ids gives the same ids through the rank encoder of ``tiktoken``,
several times faster than through ``tokenizers``; any other file goes through its own
library (``tokenizers`` for ``.json``, ``sentencepiece`` for ``.model``).
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Fixed value: how byte-level BPE splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without two white-space characters in a row; it needs no look-ahead.
SPLIT_SINGLE = SPLIT.replace(r"|\s+(?!\S)", "")

_TWO_SPACES = re.compile(r"\s\s")
#: Fixed value: white space as the split pattern means it, in runs that a look-ahead must not walk back over.
_LONG_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")
_CUT = re.compile(r"(?<=\S)[ \t\n\r]")


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes and ids, if the ids are in the order of the merges."""
    byte_of, vocab = _byte_of(), model["vocab"]
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    except KeyError:
        return None
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    in_order = None not in merged and all(a < b for a, b in zip(merged, merged[1:]))
    return ranks if in_order and all(bytes([b]) in ranks for b in range(256)) else None


class Vocabulary:
    """``ids(text)``: token ids without begin, end or added special tokens. A special string
    inside a text becomes its special token, which is the default of ``tokenizers``."""

    def __init__(self, path: str):
        self._special: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda text: model.encode(text)
            self.splits = False
            return
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, ranks = spec.get("pre_tokenizer") or {}, None
        if before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer"):
            if spec["model"].get("type") == "BPE" and before.get("use_regex", True):
                self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
                plain = dict(spec["model"], vocab={t: i for t, i in spec["model"]["vocab"].items() if t not in self._special})
                ranks = _ranks(plain)
        self.splits = ranks is not None
        if ranks is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self._special = {}
            return
        import tiktoken

        self._general = tiktoken.Encoding("general", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._single = tiktoken.Encoding("single", pat_str=SPLIT_SINGLE, mergeable_ranks=ranks, special_tokens={})
        self._encode = self._by_ranks

    def _by_ranks(self, text: str) -> list[int]:
        if not _TWO_SPACES.search(text):
            return self._single.encode_ordinary(text)
        # A run of white space is one match but for its last character, which may belong to what
        # follows; a long one is encoded by itself, where no look-ahead is needed.
        out, start = [], 0
        for run in _LONG_SPACES.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self._general.encode_ordinary(text[start : run.start()]) + self._single.encode_ordinary(text[run.start() : end])
            start = end
        return out + self._general.encode_ordinary(text[start:]) if start else self._general.encode_ordinary(text)

    def ids(self, text: str) -> list[int]:
        for mark, number in self._special.items():
            if mark in text:
                out = []
                for i, part in enumerate(text.split(mark)):
                    out += ([number] if i else []) + self.ids(part)
                return out
        return self._encode(text)

    def parts(self, text: str, piece_chars: int = 1 << 16):
        """The ids in lists, one of each piece of a long text."""
        if not self.splits or len(text) <= piece_chars:
            yield self.ids(text)
            return
        for piece in safe_pieces(text, piece_chars):
            yield self.ids(piece)

    def count(self, text: str, piece_chars: int = 1 << 16) -> int:
        """Number of ids; a long text is encoded in pieces, so no long list of ids is built."""
        return sum(map(len, self.parts(text, piece_chars)))

    def encoded(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(np.array(part, "<u4").tobytes() for part in self.parts(text))


def safe_pieces(text: str, piece_chars: int):
    """Cut before white space that follows a visible character: the split pattern always has
    a boundary there, so the pieces give the ids of the whole text. A text without such a
    place stays whole."""
    start = 0
    while len(text) - start > piece_chars:
        cut = _CUT.search(text, start + piece_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def public(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
