"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A text of at most ``CHUNK`` characters is encoded as it is. A longer one is cut into chunks that
reach ``overlap`` characters into their neighbours on both sides, and the chunks are encoded by
different tasks. The bytes of the ids give every token's place, so each chunk knows its token
boundaries in the text. At a *proven* boundary, between two characters that no piece of the
vocabulary holds next to each other, no token lies over whatever stands around it: every encoding
that has read enough on both sides has a boundary there, and the tokens before and after it do not
depend on each other. Two neighbours are spliced at the first boundary of that kind, after the
nominal cut, that both encodings have; each counts its tokens between its two splices.

Where two chunks share no such boundary, alignment has failed: their text is cut again with an
overlap ``WIDER`` times as wide, until it succeeds or one chunk holds all of the text. Only texts
that no piece boundary parts, such as one letter repeated, get that far.

Defined results: NULL and empty texts have no bytes and no tokens. Special strings inside texts are
plain text, as the library takes them. A vocabulary that rewrites texts before encoding them is
found out by its tokens' bytes and read in one chunk. Repeated rows are counted each. Columns other
than ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import ship, table
from tomeweave.llm.vocabularies import Pieces, public_path, read
from tomeweave.sources.workspace import materialise

# Characters of a chunk and of the first overlap, how much wider each further one is.
CHUNK, OVERLAP, WIDER = 65_536, 128, 16
# Characters that are encoded in one call.
CHARACTERS = 1_000_000

COUNTED = "row LONG, doc_id LONG, n_bytes LONG, n_tokens LONG"
CHUNKS = "row LONG, part LONG, text STRING, start LONG, cut LONG, stop LONG, last BOOLEAN"
SPLICED = "row LONG, part LONG, last BOOLEAN, left LONG, right LONG, n LONG"


def _whole(vocabulary: str):
    """Counts of texts that are encoded as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read(Pieces, vocabulary)
        for batch in batches:
            counts, texts, size = [], [], 0
            for text in batch.column("text"):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= CHARACTERS:
                    counts += pieces.counts(texts)
                    texts, size = [], 0
            counts += pieces.counts(texts)
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            columns = [batch.column("row"), batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_bytes", "n_tokens"])

    return run


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int, int, bool]]:
    """``part, text, start, cut, stop, last``: each chunk with its overlaps, and where in the text
    its first character, its nominal start and its nominal end are."""
    if overlap >= len(text):
        size = len(text)  # the overlap takes all of it in
    for part, cut in enumerate(range(0, len(text), size)):
        stop, start = min(len(text), cut + size), max(0, cut - overlap)
        yield part, text[start : stop + overlap], start, cut, stop, stop == len(text)


def spliced(
    pieces: Pieces, text: str, start: int, cut: int, stop: int, last: bool, overlap: int
) -> tuple[int | None, int | None, int | None]:
    """A chunk's splices with its neighbours, as places in the whole text, and the tokens between.

    A text's two ends are splices. None where there is no proven boundary in the overlap.
    """
    (ids,) = pieces.encode([text])
    if cut == 0 and last:
        return 0, stop, len(ids)
    data = text.encode()
    if pieces.joined(ids) != b" " + data:
        return None, None, None
    ends = pieces.ends(ids)  # the first byte is the blank that is put before a text
    first = 1 + np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # byte of each character

    def splice(low: int) -> int | None:
        for at in range(max(low, 1), min(low + overlap, len(text))):
            if text[at - 1 : at + 1] not in pieces.pairs and first[at] in ends:
                return at
        return None

    left, right = (0 if cut == 0 else splice(cut - start)), (len(text) if last else splice(stop - start))
    if left is None or right is None:
        return None, None, None
    low, high = (0 if cut == 0 else first[left]), (ends[-1] if last else first[right])
    return start + left, start + right, int(((ends > low) & (ends <= high)).sum())


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                for chunk in chunks(text.as_py(), size, overlap):
                    yield _one(CHUNKS, (row, *chunk))

    return run


def _encode(vocabulary: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = read(Pieces, vocabulary)
        for batch in batches:
            for row, part, text, start, cut, stop, last in zip(*(c.to_pylist() for c in batch.columns)):
                yield _one(SPLICED, (row, part, last, *spliced(pieces, text, start, cut, stop, last, overlap)))

    return run


def _one(schema: str, row: tuple) -> pa.RecordBatch:
    kinds = {"LONG": pa.int64(), "STRING": pa.string(), "BOOLEAN": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[k]) for x, (_, k) in zip(row, fields)], names=[n for n, _ in fields])


def _resynchronised(huge: DataFrame, vocabulary: str, size: int, overlap: int) -> DataFrame:
    """``row, n_tokens`` of stored texts of several chunks."""
    in_turn = Window.partitionBy("row").orderBy("part")
    meets = F.col("last") | (F.col("right") == F.lead("left").over(in_turn))
    done = None
    while True:
        cut = huge.select("row", "text").mapInArrow(_cut(size, overlap), CHUNKS)
        read_ = cut.repartition("row", "part").mapInArrow(_encode(vocabulary, overlap), SPLICED)
        sums = read_.withColumn("meets", F.coalesce(meets & F.col("n").isNotNull(), F.lit(False))).groupBy("row").agg(
            F.min("meets").alias("whole"), F.sum("n").alias("n_tokens")
        )
        sums = materialise(sums, "spliced")
        whole = sums.where("whole").select("row", "n_tokens")
        done = whole if done is None else done.unionByName(whole)
        failed = sums.where("NOT whole").select("row")
        if failed.isEmpty():
            return done
        huge, overlap = materialise(huge.join(failed, "row", "left_semi"), "unaligned"), overlap * WIDER


def count_tokens(docs: DataFrame, vocabulary: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``row, doc_id, n_bytes, n_tokens`` of every text; ``row`` is a number of the input row.

    ``vocabulary`` is the path of a piece vocabulary. No begin, end or special tokens are counted.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > size, F.lit(False))
    # Texts of one chunk stay where they are read.
    plain = rows.where(~is_long).mapInArrow(_whole(vocabulary), COUNTED)
    # Numbered apart from the short ones, whatever the two scans' splits are.
    huge = materialise(rows.where(is_long).withColumn("row", -1 - F.col("row")), "huge")
    counted = huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return plain.unionByName(counted.join(_resynchronised(huge, vocabulary, size, overlap), "row"))


def query(spark, folder: str, limit: int = 4096) -> DataFrame:
    """Contract ``op13``: bytes and tokens of every document, and whether they exceed the limit."""
    counted = count_tokens(table(spark, folder, "documents"), public_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
