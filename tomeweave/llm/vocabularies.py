"""The two vocabularies whose token boundaries are followed through a text, byte by byte.

Both readers give ids as arrays and the bytes of every id, so a token's place is a running sum.
Neither forms a token over the blank between two words: the byte-level reader starts a new piece
of text at every blank after a word, and a piece vocabulary is checked for it when it is read.
"""

from __future__ import annotations

import json
import os

import numpy as np

# What begins a word in a piece vocabulary.
MARK = "▁"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tokens:
    """Bytes and lengths by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.names = [str(i).encode() for i in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte after each token."""
        return np.cumsum(self.lengths[ids])


class ByteBpe(_Tokens):
    """A byte-level vocabulary; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        splits = read.get("pre_tokenizer") or {}
        # Words are encoded apart only by the usual pattern, over the text as it stands.
        self.parted = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not read.get("normalizer")
        letters, words = _letters(), self._tokenizer.get_vocab()
        tokens = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            tokens[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        super().__init__(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a blank and each text."""
        found = self._tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]


class Pieces(_Tokens):
    """A piece vocabulary, which puts a blank before each text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._processor = SentencePieceProcessor(model_file=path)
        words = [self._processor.id_to_piece(i) for i in range(self._processor.get_piece_size())]
        whole = [w for i, w in enumerate(words) if not self._processor.is_byte(i)]
        super().__init__([
            bytes([int(w[3:-1], 16)]) if self._processor.is_byte(i) else w.replace(MARK, " ").encode()
            for i, w in enumerate(words)
        ])
        # No piece goes on after a word's end into the next blank, so none is formed over it.
        self.parted = not any(MARK in w.lstrip(MARK) for w in whole)
        pairs = {a + b for w in whole for a, b in zip(w, w[1:])}
        #: Neighbouring characters that some piece holds; no token lies over any others.
        self.pairs = {p.replace(MARK, " ") for p in pairs}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.array(ids, np.int64) for ids in self._processor.encode(texts, out_type=int, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self._processor.encode(texts, out_type=int, num_threads=1)]


_read: dict[tuple, _Tokens] = {}


def read(kind: type, path: str):
    """One per Python worker; vocabularies are small and do not grow."""
    if (kind, path) not in _read:
        _read[kind, path] = kind(path)
    return _read[kind, path]
