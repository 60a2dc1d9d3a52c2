"""Pack tokenized documents into windows by sum-of-squares online packing.

Each task packs the documents of its own splits as they arrive. A document first fills whole
windows by itself; its rest goes to the fill level, or to a fresh window, after which the sum of
the squared counts of partly filled windows is least. The counts are held in an array by level.
At the end of a task the emptiest windows are taken apart to top up the fullest, cutting where
needed, and the one that stays is cut at powers of two, which need no padding. So neither texts
nor tokens are shuffled, and a task holds its open windows only.

Defined results: NULL and empty texts are a document of the end token alone. Very long texts are
one document in many pieces. Equal rows are packed each on its own. An empty table gives no
pieces. ``columns`` names what is carried of the input; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import release, released, ship, table

SCHEMA = "doc_id LONG, start LONG, length LONG, doc_tokens LONG, sequence_id LONG, offset LONG, ids BINARY"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
# Bytes of words and their ids that a Python worker remembers, and what a word takes beside its
# own and its ids' bytes: two objects and a place in a table.
REMEMBERED, OVERHEAD = 160_000_000, 180
# Marks that the tokenizer parts from the letters before them.
MARKS = ".,;:!?%$#&*()"
# Words that one call of the tokenizer takes; characters whose words are looked up together.
TOGETHER, CHARACTERS = 1000, 2_000_000
# Rows of an output batch.
ROWS = 2000
STOP = re.compile(r"(?<=[a-z])([.,])(?=[ \n])")
# str.split() parts at the first four, the tokenizer does not; the others have lower cases that
# depend on their neighbours, or begin special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, remembered word by word.

    The tokenizer drops blanks and never joins what they part, so a text's ids are those of its
    blank-separated words in turn. Words of letters alone, which make up almost all of the new
    ones, are encoded many at a time and parted again at the tokens that end a word.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        # Two generations: words that are met again move to the younger one, which replaces the
        # older when it holds half of what is remembered.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.remembered = remembered

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one run of letters each."""
        out: list[bytes] = []
        joined = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        for ids in self._encode(joined):
            ends = 4 * (1 + np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]))
            starts = [0, *ends[:-1].tolist()]
            out += [ids[i:j] for i, j in zip(starts, ends.tolist())]
        return out

    def _learn(self, new: set[str]) -> None:
        known = self.known
        # Marks after letters are encoded apart from them.
        stems, letters, others = [], set(), []
        for w in new:
            s = w.rstrip(MARKS)
            if s.isalpha():
                letters.add(s)
                if len(s) < len(w):
                    stems.append((w, s, w[len(s) :]))
            else:
                others.append(w)
        todo = [s for s in letters if s not in known]
        known.update(zip(todo, self._letters(todo)))
        others += [t for t in {t for _, _, t in stems} if t and t not in known]
        known.update(zip(others, self._encode(others)))
        known.update([(w, known[s] + known[t]) for w, s, t in stems])

    def _plain(self, text: str) -> bool:
        """Whether lower-casing and parting a text's words here leaves its ids as they are."""
        return not any(c in text for c in _ODD) and is_normalized("NFC", text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        # Stops after a letter are words of their own, so fewer words are new.
        words = [STOP.sub(r" \1", t.lower()).split() if ok else [] for t, ok in zip(texts, plain)]
        if 2 * self.size > self.remembered:
            self.known, self.older, self.size = {}, self.known, 0
        # Each word is looked up once; the memory is large, so that is what takes the time.
        found = [list(map(self.known.get, w)) for w in words]
        new = {w for ws, ids in zip(words, found) for w, x in zip(ws, ids) if x is None}
        if new:
            before = len(self.known)
            if self.older:
                self.known.update([(w, self.older[w]) for w in new if w in self.older])
                new = new - self.known.keys()
            if new:
                self._learn(new)
            fresh = itertools.islice(reversed(self.known.items()), len(self.known) - before)
            self.size += sum([OVERHEAD + len(w) + len(ids) for w, ids in fresh])
        known = self.known
        return [
            b"".join([known[w] if x is None else x for w, x in zip(ws, ids)]) if ok else self._encode([t])[0]
            for t, ws, ids, ok in zip(texts, words, found, plain)
        ]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str, remembered: int) -> Encoder:
    """One per Python worker and vocabulary, kept between tasks; what it remembers is bounded."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary, remembered)
        release()  # what reading the vocabulary took
    _encoders[vocabulary].remembered = remembered
    return _encoders[vocabulary]


class Packer:
    """Open windows by fill level; closed ones are handed out as lists of pieces."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # of partly filled windows, by level
        self.open: dict[int, list[list[tuple]]] = {}

    def add(self, doc, ids: bytes) -> Iterator[list[tuple]]:
        """Place a document; yields the windows it closes."""
        size, total = self.window, len(ids) // 4
        rest = total % size
        for start in range(0, total - rest, size):
            yield [(doc, start, ids[4 * start : 4 * (start + size)], total)]
        if not rest:
            return
        level = self._level(rest)
        pieces = self.open[level].pop() if level else []
        pieces.append((doc, total - rest, ids[4 * (total - rest) :], total))
        if level:
            self.counts[level] -= 1
        if level + rest == size:
            yield pieces
        else:
            self.counts[level + rest] += 1
            self.open.setdefault(level + rest, []).append(pieces)

    def _level(self, rest: int) -> int:
        """The level to place ``rest`` tokens at; 0 is a new window. Ties go to the fullest."""
        top = self.window - rest
        counts = self.counts
        after = 2 * counts[rest:].copy() + 1  # of the level that comes to be
        after[top] = 0  # a full window is not counted
        change = after + 1 - 2 * counts[: top + 1]
        change[0] = after[0]
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def close(self) -> Iterator[list[tuple]]:
        """Fill the fullest windows from the emptiest, then cut the last at powers of two."""
        left = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        first, last = 0, len(left) - 1
        while first < last:
            level, pieces = left[first]
            while level < self.window and first < last:
                source = left[last][1]
                doc, start, ids, total = source.pop()
                take = min(self.window - level, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    source.append((doc, start + take, ids[4 * take :], total))
                if not source:
                    last -= 1
                level += take
            left[first] = (level, pieces)
            if level == self.window:
                yield pieces
                first += 1
        for _, pieces in left[first : last + 1]:
            yield from self._powers(pieces)

    @staticmethod
    def _powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
        rest = sum(len(p[2]) for p in pieces) // 4
        todo = pieces[::-1]
        while rest:
            room, out = 1 << (rest.bit_length() - 1), []
            rest -= room
            while room:
                doc, start, ids, total = todo.pop()
                take = min(room, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    todo.append((doc, start + take, ids[4 * take :], total))
                room -= take
            yield out


def _rows(sequence: int, pieces: list[tuple]) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, total in pieces:
        length = len(ids) // 4
        yield doc, start, length, total, sequence, offset, ids
        offset += length


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about CHARACTERS at a time."""
    for batch in batches:
        docs, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= CHARACTERS:
                yield docs, texts
                docs, texts, size = [], [], 0
        yield docs, texts


def pack(
    docs: DataFrame, window: int = 2048, end: int = 1, vocabulary: str | None = None, remembered: int = REMEMBERED
) -> DataFrame:
    """Pieces of all documents: where each lies in its document and its sequence, and its ids.

    ``ids`` holds little-endian unsigned 32-bit token ids. ``sequence_id`` is unique over tasks.
    Remembering fewer bytes of words takes less memory and more time.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here forms cycles, and the many remembered words are dear to walk through.
        gc.disable()
        encode, packer = encoder(vocabulary, remembered), Packer(window)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
            )
            rows.clear()
            return out

        for docs_, texts in _groups(batches):
            for doc, ids in zip(docs_, encode(texts)):
                for pieces in packer.add(doc, ids + mark):
                    rows.extend(_rows(sequence, pieces))
                    sequence += 1
                if len(rows) >= ROWS:
                    yield flush()
        for pieces in packer.close():
            rows.extend(_rows(sequence, pieces))
            sequence += 1
        gc.enable()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(released(run), SCHEMA)


def query(spark, folder: str) -> DataFrame:
    """Contract ``op10``: every piece with the checksum of its ids."""
    return pack(table(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
