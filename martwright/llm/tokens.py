"""Token-ID output: one ORC row per document with its ids, run-length encoded, indexed and sorted by document id.

Files are written by Spark's ORC writer in ascending document order: integer columns are run-length
encoded, every stripe and row group has minimum and maximum of each column, and document ids have
Bloom filters.  Readers split files at stripes and skip what a filter on ``doc_id`` rules out.

Encoding splits a text as the tokenizer's own first step does, and keeps the ids of parts it has met in
a bounded table of the worker process, so that a common word is merged once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martwright.llm.base import held, in_order, query, slices, table, vocabulary_file
from martwright.session import stage, stage_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
#: Parts kept per worker process, and the longest part that is kept.
KEPT_PARTS, KEPT_LENGTH = 900_000, 64
BYTES_AT_ONCE = 8_000_000
#: White space, letters and numbers by Unicode property, below U+0250.
WHITE = "\\t-\\r \\x85\\xa0"
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: The tokenizer's own first split, for texts whose characters all lie below U+0250.
PART = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BEYOND = re.compile("[^\\x00-\\u024f]")
SCHEMA = "doc_id long, part int, row long, ids array<int>"


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class _Parts(dict):
    """Ids of parts met before, a bounded number of them; a part is looked up once, met before or not."""

    def __init__(self, tokenizer: Tokenizer):
        self.merge, self.letters = tokenizer.model.tokenize, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = array("i", [t.id for t in self.merge(part.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(part) <= KEPT_LENGTH:
            if len(self) > KEPT_PARTS:
                self.clear()
            self[part] = ids
        return ids


class CachingEncoder:
    """Ids of whole texts, as little-endian 32-bit integers.

    Texts with a special token's string, or with a character whose class the split here does not know,
    go to the tokenizer as they are; all others part by part, a part once as long as it is kept.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids_of = _Parts(self.tokenizer).__getitem__

    def encode(self, text: str) -> bytes:
        if BEYOND.search(text) or any(s in text for s in self.special):
            return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.ids_of, PART.findall(text)))


def caching_encoder(path: str) -> CachingEncoder:
    """One per process."""
    return held(("tokens", path), lambda: CachingEncoder(path))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write ORC files in ascending order of document id.

    A null or empty text gives the end id alone.  Null ids come first; rows with one id are ordered by
    text.  Columns other than id and text are ignored.  An empty table writes no rows.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row = caching_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<i4").tobytes()
        for batch in slices(batches, 1, BYTES_AT_ONCE):
            ids = [encoder.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["doc_id", "part", "row", "ids"])
            row += batch.num_rows

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written documents.  Filters on ``doc_id`` prune files, stripes and row groups by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digests(tokens: DataFrame) -> DataFrame:
    """Number of ids and crc32 of the ids of each document, with its place in the files."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")


@query("op1_token_ids")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_path(spark, "token_ids")
    write_tokens(table(spark, folder, "documents"), path, vocabulary_file(TOKENIZER))
    # Staged first: finding the ranges of the order would read and digest all ids once more.
    placed = in_order(stage(token_digests(read_tokens(spark, path)), "token_digests"), ["part", "row"], ["n_tokens"], "placed_tokens")
    return placed.select("doc_id", F.col("n_tokens_before").alias("start"), "n_tokens", "ids_crc32")
