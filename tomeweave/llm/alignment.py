"""Align two tokenizers' tokens by an associative composition of fragments of texts.

A text is read by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where tokens
of both end cut them into groups. What is known of a byte range, a *fragment*, is the tokens up to
its first cut (open prefix), the groups between cuts (closed), and the tokens after the last cut
(open suffix); a range without a cut is one open prefix. Fragments of neighbouring ranges compose
to that of both, and composition is associative, so a long text is cut into byte ranges that are
read by different tasks and composed in a tree, ``FAN`` at a time. Ranges are cut anywhere, also
inside tokens: a range is read with the rest of the words at its ends, and owns the tokens that
end in it. What a range reads is therefore bounded, unless the text has no blank between words.

Words parted by one blank are read apart by both vocabularies (``vocabularies``), so the fragment
of a word is remembered, within ``MEMORY`` bytes and as long as a task, and texts are composed
from those. Where a vocabulary gives no such promise, every text is one word.

A *link* is a pair of tokens of A and B that end together. Links are counted over the corpus by
pair of ids, as partial sums, and each document is told about its own.

Defined results: NULL and empty texts, and texts that one of the vocabularies does not give back
byte by byte (B reads U+2581 as a blank), have no tokens: zeros, an empty string, and no share in
the corpus counts. Repeated rows are documents each. Very long texts are read in ranges. Columns
other than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import ship, table
from tomeweave.llm.vocabularies import ByteBpe, Pieces, public_path, read
from tomeweave.sources.workspace import broadcast_if_few, materialise

# Characters of a range, fragments that one step composes, bytes of remembered words in a task.
RANGE, FAN, MEMORY = 65_536, 16, 160_000_000
# Words that are read in one go, characters whose words are looked up together.
TOGETHER, CHARACTERS = 1000, 1_000_000
# Bytes that a remembered word takes beside its own and its groups'.
OVERHEAD = 270
# A blank between two words. The excluded marks count as blanks in some tables of characters.
_NOT = r"[^\s\u180e\u200b\ufeff]"
BETWEEN = re.compile(rf"(?<={_NOT}) (?={_NOT})")
_ODD = frozenset("\u180e\u200b\ufeff")
# Marks that a word may end with, parted from its letters by both vocabularies.
MARKS = ".,;:!?%$#&*()"
# Letters below this have been letters in every table of characters.
LATIN = "\u0250"

_FRAGMENT = "head_a BINARY, head_b BINARY, cut BOOLEAN, body BINARY, closed LONG, tail_a BINARY, tail_b BINARY"
_READ = "row LONG, doc_id LONG, ok BOOLEAN, n_a LONG, n_b LONG, pair ARRAY<LONG>, n ARRAY<LONG>"
SHORT = f"{_READ}, n_groups LONG, groups_sha256 STRING"
LONG = f"{_READ}, part LONG, {_FRAGMENT}"
PARTS = "row LONG, doc_id LONG, part LONG, text STRING, base LONG, low LONG, high LONG"


def _both(x: bytes, y: bytes) -> bytes:
    return x + b"," + y if x and y else x or y


@dataclass(frozen=True)
class Fragment:
    """Open prefix, closed groups and open suffix of a byte range; ids are comma-joined decimals.

    ``body`` holds ``closed`` groups, joined by semicolons, each A's ids, a bar and B's. Without a
    cut all tokens are in the prefix.
    """

    head_a: bytes = b""
    head_b: bytes = b""
    cut: bool = False
    body: bytes = b""
    closed: int = 0
    tail_a: bytes = b""
    tail_b: bytes = b""

    def __add__(self, other: Fragment) -> Fragment:
        if not self.cut:
            return Fragment(
                _both(self.head_a, other.head_a), _both(self.head_b, other.head_b),
                other.cut, other.body, other.closed, other.tail_a, other.tail_b,
            )
        between_a, between_b = _both(self.tail_a, other.head_a), _both(self.tail_b, other.head_b)
        if not other.cut:
            return Fragment(self.head_a, self.head_b, True, self.body, self.closed, between_a, between_b)
        groups = [g for g in (self.body, between_a + b"|" + between_b, other.body) if g]
        return Fragment(
            self.head_a, self.head_b, True, b";".join(groups), self.closed + 1 + other.closed,
            other.tail_a, other.tail_b,
        )

    def groups(self) -> tuple[int, str]:
        """Number and digest of the groups of a whole text."""
        if not self.cut:
            return 0, ""
        digest = hashlib.sha256(self.head_a + b"|" + self.head_b)
        if self.body:
            digest.update(b";")
            digest.update(self.body)
        return 1 + self.closed, digest.hexdigest()


def of_groups(groups: bytes, n: int) -> Fragment:
    """The fragment of a range that holds whole groups."""
    if not n:
        return Fragment()
    first, _, body = groups.partition(b";")
    head_a, _, head_b = first.partition(b"|")
    return Fragment(head_a, head_b, True, body, n - 1)


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and of B that end together."""
    if not len(ends_a) or not len(ends_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(ends_b, ends_a)
    a = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a)
    return a, at[a]


def of_tokens(a: list[bytes], ends_a: np.ndarray, b: list[bytes], ends_b: np.ndarray) -> Fragment:
    """The fragment of a range's tokens, given by name and end."""
    cuts = ends_a[_common(ends_a, ends_b)[0]]
    at_a, at_b = ([0, *np.searchsorted(ends, cuts, "right").tolist()] for ends in (ends_a, ends_b))
    parts = [(b",".join(a[i:j]), b",".join(b[k:m])) for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
    tail_a, tail_b = b",".join(a[at_a[-1] :]), b",".join(b[at_b[-1] :])
    if not parts:
        return Fragment(tail_a, tail_b)
    body = b";".join([x + b"|" + y for x, y in parts[1:]])
    return Fragment(*parts[0], True, body, len(parts) - 1, tail_a, tail_b)


def _edged(word: str) -> bool:
    """Whether a word is empty, or begins or ends with a blank of some kind."""
    return not word or word[0].isspace() or word[-1].isspace() or word[0] in _ODD or word[-1] in _ODD


class Reader:
    """Reads texts word by word, remembering the groups and links of each word."""

    def __init__(self, a: str, b: str, memory: int = MEMORY):
        self.a, self.b, self.memory = read(ByteBpe, a), read(Pieces, b), memory
        self.parted = self.a.parted and self.b.parted
        # Names of ids with what follows them: a comma, or a bar after a group's last A, a semicolon after its last B.
        names_a, names_b = self.a.names, self.b.names
        self._marked = [n + m for names, m in ((names_a, b","), (names_a, b"|"), (names_b, b","), (names_b, b";")) for n in names]
        letters = [c for c in map(chr, range(ord(LATIN))) if c.isalpha()]
        self._marks = "".join(m for m in MARKS if not any(c + m in self.b.pairs for c in letters))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.edged: set[str] = set()  # words that begin or end with a blank of some kind
        self.bad: set[int] = set()  # words that are not given back
        self.groups: list[bytes] = []  # of each word, a semicolon after each
        self.n_a, self.n_b, self.n_links, self.links = (array("q") for _ in range(4))
        self.ending: dict[str, tuple[bytes, int, int, np.ndarray]] = {}  # marks after a letter
        self.size = 0

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both vocabularies, and whether their bytes are those of the text and its blank."""
        (ids_a,), (ids_b,), own = self.a.encode([text]), self.b.encode([text]), b" " + text.encode()
        return ids_a, ids_b, self.a.joined(ids_a) == own and self.b.joined(ids_b) == own

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair of ids."""
        return a * len(self.b.tokens) + b

    def names(self, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        return [self.a.names[i] for i in a.tolist()], [self.b.names[i] for i in b.tolist()]

    def _learn(self, words: list[str]) -> None:
        """Words that can be read together and parted again; or a single word."""
        a, b, ok = self.tokens(" ".join(words))
        if not ok:
            if len(words) > 1:
                for w in words:
                    self._learn([w])
            else:
                self.bad.update([len(self.groups)] if words[0] else [])
                self._keep(words, [b""], [0], [0], [0], np.zeros(0, np.int64))
            return
        ends_a, ends_b = self.a.ends(a), self.b.ends(b)
        at_a, at_b = _common(ends_a, ends_b)
        cuts = ends_a[at_a]
        stops = np.cumsum([1 + len(w.encode()) for w in words])
        last = np.searchsorted(cuts, stops)  # each word's last group
        if last[-1] >= len(cuts) or not np.array_equal(cuts[last], stops):
            raise ValueError("a token lies over the blank between two words")
        # Tokens in the order of their groups, A's before B's, each with what follows it.
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        closes_a[at_a] = closes_b[at_b] = True
        shown = np.concatenate([a + len(self.a.tokens) * closes_a, 2 * len(self.a.tokens) + b + len(self.b.tokens) * closes_b])
        group = np.concatenate([2 * np.searchsorted(cuts, ends_a), 2 * np.searchsorted(cuts, ends_b) + 1])
        marked = [self._marked[i] for i in shown[np.argsort(group, kind="stable")].tolist()]
        n_a, n_b = np.diff(at_a[last] + 1, prepend=0), np.diff(at_b[last] + 1, prepend=0)
        ends = np.cumsum(n_a + n_b).tolist()
        groups = [b"".join(marked[i:j]) for i, j in zip([0, *ends], ends)]
        n_links = np.diff(last + 1, prepend=0)
        self._keep(words, groups, n_a.tolist(), n_b.tolist(), n_links.tolist(), self.pair(a[at_a], b[at_b]))

    def _keep(self, words: list[str], groups: list[bytes], n_a, n_b, n_links, links: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += groups
        for held, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links)):
            held.extend(more)
        self.links.frombytes(np.ascontiguousarray(links, np.int64).tobytes())
        self.size += OVERHEAD * len(words) + sum(map(len, words)) + sum(map(len, groups)) + links.nbytes

    def _end(self, marks: str) -> tuple[bytes, int, int, np.ndarray]:
        """Groups, tokens and links of marks that follow a letter."""
        if marks not in self.ending:
            _, n_a, n_b, found, links = self._clipped("a" + marks, 0, 2, 2 + len(marks))
            groups = [found.head_a + b"|" + found.head_b, found.body]
            self.ending[marks] = b"".join([g + b";" for g in groups if g]), n_a, n_b, links
        return self.ending[marks]

    def _learn_all(self, new: set[str]) -> None:
        """Words that begin and end with characters other than blanks."""
        plain, marked = [], []
        for w in new:
            stem = w.rstrip(self._marks)
            if len(stem) < len(w) and stem.isalpha() and max(stem) < LATIN:
                marked.append((w, stem, w[len(stem) :]))
            else:
                plain.append(w)
        plain += {stem for _, stem, _ in marked if stem not in self.known and stem not in new}
        plain.sort()
        for i in range(0, len(plain), TOGETHER):
            self._learn(plain[i : i + TOGETHER])
        if not marked:
            return
        n_links = np.array(self.n_links, np.int64)
        first, links = np.cumsum(n_links) - n_links, np.array(self.links, np.int64)
        at = [self.known[stem] for _, stem, _ in marked]
        ends = [self._end(m) for _, _, m in marked]
        self._keep(
            [w for w, _, _ in marked], [self.groups[i] + e[0] for i, e in zip(at, ends)],
            [self.n_a[i] + e[1] for i, e in zip(at, ends)], [self.n_b[i] + e[2] for i, e in zip(at, ends)],
            [self.n_links[i] + len(e[3]) for i, e in zip(at, ends)],
            np.concatenate([x for i, e in zip(at, ends) for x in (links[first[i] : first[i] + n_links[i]], e[3])]),
        )

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """Each text's words, and in turn the places where they are known until the next call."""
        if self.size > self.memory:
            self._forget()
        out = [t.split(" ") for t in texts] if self.parted else [[t] for t in texts]
        at = list(map(self.known.get, chain.from_iterable(out)))
        new = {w for w, i in zip(chain.from_iterable(out), at) if i is None}
        if not self.parted:
            for w in new:
                self._learn([w])
        else:
            self.edged |= {w for w in new if _edged(w)}
            if self.edged:
                for i, found in enumerate(out):
                    if not self.edged.isdisjoint(found):
                        out[i] = BETWEEN.split(texts[i])
                at = list(map(self.known.get, chain.from_iterable(out)))
                new = {w for w, i in zip(chain.from_iterable(out), at) if i is None}
            edged = {w for w in new if _edged(w)}
            self._learn_all(new - edged)
            for w in sorted(edged):
                self._learn([w])
        if new:
            at = [self.known[w] if i is None else i for w, i in zip(chain.from_iterable(out), at)]
        return out, np.array(at, np.int64)

    def whole(self, sizes: list[int], at: np.ndarray) -> Iterator[tuple[bool, int, int, bytes, np.ndarray]]:
        """Of each text's known words: whether all are given back, tokens of A and B, groups, links."""
        n_a, n_b, n_links = (np.array(x, np.int64) for x in (self.n_a, self.n_b, self.n_links))
        first = np.cumsum(n_links) - n_links
        each = n_links[at]
        links = np.array(self.links, np.int64)[
            np.repeat(first[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        ]
        stops = np.cumsum(sizes).tolist()
        sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (n_a, n_b, n_links)]
        for start, stop in zip([0, *stops], stops):
            here = at[start:stop].tolist()
            if self.bad and not self.bad.isdisjoint(here):
                yield False, 0, 0, b"", links[:0]
                continue
            groups = b"".join([self.groups[i] for i in here])[:-1]
            yield True, *(int(x[stop] - x[start]) for x in sums[:2]), groups, links[sums[2][start] : sums[2][stop]]

    def part(self, text: str, base: int, low: int, high: int) -> tuple[bool, int, int, Fragment, np.ndarray]:
        """The same of the tokens that end after byte ``low`` and not after ``high``.

        ``text`` are the words that the range touches; its blank is byte ``base`` of the document.
        """
        (words,), at = self.words([text])
        stops = base + np.cumsum([1 + len(w.encode()) for w in words])
        starts = np.concatenate([[base], stops[:-1]])
        inside = np.flatnonzero((starts >= low) & (stops <= high))
        start, stop = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (len(words), len(words))
        read = [self._clipped(words[i], int(starts[i]), low, high) for i in range(start)]
        read += [(ok, x, y, of_groups(groups, len(pairs)), pairs) for ok, x, y, groups, pairs in self.whole([stop - start], at[start:stop])]
        read += [self._clipped(words[i], int(starts[i]), low, high) for i in range(stop, len(words))]
        found = Fragment()
        for _, _, _, more, _ in read:
            found += more
        ok = all(r[0] for r in read)
        return ok, sum(r[1] for r in read), sum(r[2] for r in read), found, np.concatenate([r[4] for r in read])

    def _clipped(self, word: str, start: int, low: int, high: int) -> tuple[bool, int, int, Fragment, np.ndarray]:
        """A word whose blank is byte ``start``, as far as its tokens end in the range."""
        a, b, ok = self.tokens(word)
        if not ok:
            return False, 0, 0, Fragment(), np.zeros(0, np.int64)
        ends_a, ends_b = start + self.a.ends(a), start + self.b.ends(b)
        mine_a, mine_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        a, b, ends_a, ends_b = a[mine_a], b[mine_b], ends_a[mine_a], ends_b[mine_b]
        at_a, at_b = _common(ends_a, ends_b)
        names_a, names_b = self.names(a, b)
        return True, len(a), len(b), of_tokens(names_a, ends_a, names_b, ends_b), self.pair(a[at_a], b[at_b])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """Positions and texts, about CHARACTERS at a time."""
    at, texts, size = [], [], 0
    for i, text in enumerate(batch.column("text")):
        at.append(i)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHARACTERS:
            yield at, texts
            at, texts, size = [], [], 0
    yield at, texts


def _short(a: str, b: str):
    """Whole texts of one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(a, b)
        for batch in batches:
            ids, docs = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            for at, texts in _texts(batch):
                rows = []
                words, known = reader.words(texts)
                for i, (ok, n_a, n_b, groups, links) in zip(at, reader.whole([len(w) for w in words], known)):
                    n_groups, digest = of_groups(groups, len(links)).groups()
                    pairs, n = np.unique(links, return_counts=True)
                    rows.append((ids[i], docs[i], ok, n_a, n_b, pairs, n, n_groups, digest))
                yield _batch(rows, _SHORT)

    return run


def _cut(size: int):
    """Rows of byte ranges of long texts, with the words that each touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column("row"), batch.column("doc_id"), batch.column("text")):
                for part, held in enumerate(ranges(text.as_py(), size)):
                    yield _batch([(row.as_py(), doc.as_py(), part, *held)], _PARTS)

    return run


def ranges(text: str, size: int) -> Iterator[tuple[str, int, int, int]]:
    """Words that each range of about ``size`` characters touches, their first byte, and its ends.

    Byte 0 is the blank that both vocabularies put before the text.
    """
    left, base = 0, 0  # where the words begin: at 0 or a blank, and that blank's byte
    start, low = 0, 0  # the range itself
    while start < len(text):
        end = min(len(text), start + size)
        found = BETWEEN.search(text, end) if end < len(text) else None
        right = found.start() if found else len(text)
        if right - end > size:
            end = right  # a long run without blanks is not read twice
        words = text[left:right] if left == 0 else text[left + 1 : right]
        high = low + len(text[start:end].encode()) + (start == 0)
        yield words, base, low, high
        # The next words begin at the last blank up to the end of this range.
        back, width = left, 256
        while end < len(text):
            tried = max(left, end - width)
            before = [m.start() for m in BETWEEN.finditer(text, tried, min(len(text), end + 2)) if m.start() <= end]
            if before or tried == left:
                back = before[-1] if before else left
                break
            width *= 4
        if back > left:
            base += len(text[left:back].encode()) + (left == 0)
            left = back
        start, low = end, high


def _long(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(a, b)
        for batch in batches:
            for r in batch.to_pylist():
                ok, n_a, n_b, found, links = reader.part(r["text"], r["base"], r["low"], r["high"])
                pairs, n = np.unique(links, return_counts=True)
                yield _batch([(r["row"], r["doc_id"], ok, n_a, n_b, pairs, n, r["part"], *vars(found).values())], _LONG)

    return run


def _composed(parts: pa.Table) -> Fragment:
    """Neighbouring fragments as one, the halves first so that long bodies are copied few times."""
    found = [Fragment(**{c: r[c] for c in Fragment.__dataclass_fields__}) for r in parts.sort_by("part").to_pylist()]
    while len(found) > 1:
        found = [found[i] + found[i + 1] if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def _step(parts: pa.Table) -> pa.Table:
    found = _composed(parts)
    return pa.Table.from_batches([_batch([(parts["row"][0].as_py(), parts["above"][0].as_py(), *vars(found).values())], _TREE)])


def _root(parts: pa.Table) -> pa.Table:
    n, digest = _composed(parts).groups()
    return pa.Table.from_batches([_batch([(parts["row"][0].as_py(), n, digest)], _ROOT)])


def _fields(*names: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(names))


_I, _S, _B, _X = pa.int64(), pa.string(), pa.bool_(), pa.binary()
_PARTS_OF = [("head_a", _X), ("head_b", _X), ("cut", _B), ("body", _X), ("closed", _I), ("tail_a", _X), ("tail_b", _X)]
_KNOWN = [("row", _I), ("doc_id", _I), ("ok", _B), ("n_a", _I), ("n_b", _I), ("pair", pa.list_(_I)), ("n", pa.list_(_I))]
_SHORT = _fields(*_KNOWN, ("n_groups", _I), ("groups_sha256", _S))
_LONG = _fields(*_KNOWN, ("part", _I), *_PARTS_OF)
_PARTS = _fields(("row", _I), ("doc_id", _I), ("part", _I), ("text", _S), ("base", _I), ("low", _I), ("high", _I))
_TREE = _fields(("row", _I), ("part", _I), *_PARTS_OF)
_ROOT = _fields(("row", _I), ("n_groups", _I), ("groups_sha256", _S))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def align(docs: DataFrame, a: str, b: str, size: int = RANGE) -> DataFrame:
    """Per document ``row, doc_id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum``.

    ``a`` and ``b`` are the paths of the two vocabularies, ``row`` a number of the input row.
    Texts of more than ``size`` characters are read in ranges of that many.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > size, F.lit(False))
    short = materialise(rows.where(~is_long).mapInArrow(_short(a, b), SHORT), "aligned")
    # Numbered apart from the short ones, whatever the two scans' splits are.
    cut = rows.where(is_long).withColumn("row", -1 - F.col("row")).mapInArrow(_cut(size), PARTS)
    parts = materialise(cut.repartition("row", "part").mapInArrow(_long(a, b), LONG), "fragments")
    links = short.select("row", "pair", "n").unionByName(_whole(parts).select("row", "pair", "n"))
    links = links.select("row", F.inline(F.arrays_zip("pair", "n")))
    known = links.join(broadcast_if_few(_pairs(links, len(read(Pieces, b).tokens))), "pair")
    sums = known.groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("is_best"), F.col("n"))).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    )
    counted = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    texts = short.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").unionByName(_roots(parts))
    return texts.join(sums, "row", "left").select(
        "row", "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def _whole(parts: DataFrame) -> DataFrame:
    """The ranges of texts that are given back whole."""
    bad = parts.where("NOT ok").select("row").distinct()
    return parts.join(bad, "row", "left_anti")


def _pairs(links: DataFrame, size: int) -> DataFrame:
    """``pair, count, is_best``: links of each pair of ids, and whether no other has more of its B."""
    counts = materialise(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    of_b = F.pmod("pair", F.lit(size))
    most = materialise(counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most")), "most-linked")
    best = counts.withColumn("b", of_b).join(broadcast_if_few(most), "b")
    return materialise(best.select("pair", "count", (F.col("count") == F.col("most")).alias("is_best")), "pairs")


def _roots(parts: DataFrame) -> DataFrame:
    """Long texts, their fragments composed in a tree."""
    whole = _whole(parts)
    level = whole.select("row", "part", *Fragment.__dataclass_fields__)
    height = parts.agg(F.max("part")).first()[0] or 0
    while height >= FAN:
        height //= FAN
        above = level.withColumn("above", F.floor(F.col("part") / FAN).cast("long"))
        level = above.groupBy("row", "above").applyInArrow(_step, f"row LONG, part LONG, {_FRAGMENT}")
    composed = level.groupBy("row").applyInArrow(_root, "row LONG, n_groups LONG, groups_sha256 STRING")
    every = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.min("ok").alias("ok"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")
    )
    zero = [F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b")]
    return every.join(composed, "row", "left").select("row", "doc_id", *zero, "n_groups", "groups_sha256")


def query(spark, folder: str) -> DataFrame:
    """Contract ``op12``: every document's tokens, groups and links."""
    a, b = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    return align(table(spark, folder, "documents"), a, b).drop("row")
