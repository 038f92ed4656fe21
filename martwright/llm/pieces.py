"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

A text's encoding is the segmentation into vocabulary pieces with the largest sum of scores, found by
dynamic programming; among equal sums the rightmost piece is the longest one, and so on leftwards.
Pieces cross no word start, so a short text is its words, and a word met again in a task is not solved
again.  A giant text is cut into chunks anywhere.  The state at a boundary is how many characters the
piece that crosses it reaches over.  A chunk gives a matrix, the best sum from each state at its left to
each state at its right; an associative max-plus scan over the matrices gives the best sums at every
boundary; with these a chunk gives a map from the state at its right to the state at its left, and a
scan over maps fixes all states.  Then every chunk is traced back on its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm.base import held, query, slices, table, vocabulary_file
from martwright.llm.lattice import SPACE, Vocabulary, blocks, steps, vocabulary
from martwright.session import stage

MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 32_768
KEPT_WORDS = 300_000
BYTES_AT_ONCE = 1_000_000
#: Where a chunk's body is among its columns.
BODY = 3
#: The digest of ids is the sum of id times place (from 1), modulo this prime.
DIGEST_PRIME = (1 << 31) - 1
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LOWEST = -np.inf


def normal(text: str) -> str:
    """Blanks as the space piece, with one in front of the text; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


# ---- one stretch of text


def best_sums(text: str, start: dict[int, float], vocab: Vocabulary, stop: int) -> np.ndarray:
    """Best sum at each position; paths begin at the positions in ``start`` with their sums, pieces before ``stop``."""
    out = np.full(len(text) + 1, LOWEST)
    for position, value in start.items():
        out[position] = max(out[position], value)
    get, scores, longest, n = vocab.id_of.get, vocab.scores, vocab.longest, len(text)
    for i in range(stop):
        here = out[i]
        if here == LOWEST:
            continue
        single = False
        for e in range(i + 1, min(n, i + longest) + 1):
            found = get(text[i:e])
            if found is not None:
                single |= e == i + 1
                out[e] = max(out[e], here + scores[found])
        if not single:
            out[i + 1] = max(out[i + 1], here + vocab.fallback_score)
    return out


def trace(text: str, sums: np.ndarray, end: int, entry: np.ndarray, vocab: Vocabulary) -> tuple[int, list[int]]:
    """Back from ``end`` to a position where the best sum is an entry's; that position and the ids in between."""
    get, ids, at = vocab.id_of.get, [], end
    while True:
        if at < len(entry) and entry[at] > LOWEST and entry[at] == sums[at]:
            return at, [i for part in reversed(ids) for i in part]
        for length in range(min(at, vocab.longest), 0, -1):
            before = sums[at - length]
            if before == LOWEST:
                continue
            found = get(text[at - length : at])
            if found is not None and before + vocab.scores[found] == sums[at]:
                ids.append([found])
                break
            if found is None and length == 1 and before + vocab.fallback_score == sums[at]:
                ids.append(vocab.fallback(text[at - 1]))
                break
        else:
            raise ValueError("no piece ends here")
        at -= length


def solve(words: list[str], vocab: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """Each word with the ids of its best segmentation as 32-bit integers, many words at a time."""
    for block in blocks(words):
        at, end, length, ids, extra = vocab.matches(block)
        scores = np.append(vocab.scores, np.full(len(extra), vocab.fallback_score))
        sizes = np.array([len(w) for w in block])
        sums = np.full((int(sizes.max()) + 1, len(block)), LOWEST)
        sums[0] = 0.0
        last, back = np.zeros(sums.shape, np.int32), np.zeros(sums.shape, np.int8)
        for e, k, part in steps(end, length):  # of one end the shorter pieces first: at equal sums the longer one stays
            rows = at[part]
            value = sums[e - k, rows] + scores[ids[part]]
            better = value >= sums[e, rows]
            rows = rows[better]
            sums[e, rows], last[e, rows], back[e, rows] = value[better], ids[part][better], k
        rows, e, taken = np.arange(len(block)), sizes.copy(), []
        while len(rows):  # all words are traced back together, a piece at a time
            taken.append((rows, last[e[rows], rows]))
            e[rows] -= back[e[rows], rows]
            rows = rows[e[rows] > 0]
        row, piece = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.lexsort((-np.arange(len(row)), row))
        ends = np.cumsum(np.bincount(row, minlength=len(block))).tolist()
        flat = piece[order].astype("<i4")
        raw = flat.tobytes()
        for word, a, b in zip(block, [0, *ends[:-1]], ends, strict=True):
            found = raw[4 * a : 4 * b]
            if extra and (flat[a:b] >= vocab.size).any():
                found = array("i", [j for i in flat[a:b].tolist() for j in (extra.get(i) or (i,))]).tobytes()
            yield word, found


class WordEncoder:
    """Ids of stretches that begin and end at word starts, with a bounded table of words met before."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.ids = vocab, {}

    def prepare(self, words: set[str]) -> None:
        """Make sure that all these words are in the table."""
        if len(self.ids) > KEPT_WORDS:
            self.ids = {}
        self.ids.update(solve([w for w in words if w not in self.ids], self.vocab))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of normalised texts as 32-bit integers."""
        lists = [_WORD.findall(t) for t in texts]
        self.prepare(set().union(*lists))
        return [b"".join(map(self.ids.__getitem__, words)) for words in lists]


# ---- chunks of giant documents


def split_chunk(chunk: str, before: str) -> tuple[int, int] | None:
    """First and last place in ``chunk`` that no piece crosses; ``before`` is the character before it."""
    places = [m.start() for m in re.finditer(f"(?<!{SPACE}){SPACE}", chunk)]
    if places and places[0] == 0 and before == SPACE:
        places = places[1:]
    return (places[0], places[-1]) if places else None


def word_encoder(path: str) -> WordEncoder:
    """One per process."""
    return held(("pieces", path), lambda: WordEncoder(vocabulary(path)))


class Chunk:
    """A stretch of a normalised text with the character before it and the few after it."""

    def __init__(self, before: str, body: str, after: str, encoder: WordEncoder):
        self.body, self.text, self.encoder, self.vocab = body, body + after, encoder, encoder.vocab
        self.states = self.vocab.longest
        self.cut = split_chunk(body, before)

    def _inner(self) -> list[str]:
        first, last = self.cut
        return _WORD.findall(self.body[first:last])

    def matrix(self) -> np.ndarray:
        """Best sum from each state at the left to each state at the right, less what all paths share.

        Between the first and the last place that no piece crosses all paths are the same; a number that is the same for
        all states changes no choice, here or further on, and is left out.
        """
        states, n = self.states, len(self.body)
        out = np.full((states, states), LOWEST)
        if self.cut is None:
            for s in range(min(states, n)):
                sums = best_sums(self.text, {s: 0.0}, self.vocab, n)
                out[s, : len(sums) - n] = sums[n : n + states]
            return out
        first, last = self.cut
        head = np.full(states, LOWEST)
        for s in range(min(states, first + 1)):
            head[s] = best_sums(self.body[:first], {s: 0.0}, self.vocab, first)[first]
        tail = np.full(states, LOWEST)
        ends = best_sums(self.text[last:], {0: 0.0}, self.vocab, n - last)[n - last :]
        tail[: len(ends[:states])] = ends[:states]
        return head[:, None] + tail[None, :]

    def _entered(self, entry: np.ndarray, stop: int, upto: int) -> np.ndarray:
        return best_sums(self.text[:upto], {s: v for s, v in enumerate(entry) if v > LOWEST and s <= upto}, self.vocab, stop)

    def left_states(self, entry: np.ndarray) -> np.ndarray:
        """For each state at the right the state at the left that the traced path has; -1 where there is none."""
        n = len(self.body)
        out = np.full(self.states, -1)
        if self.cut is None:
            sums = self._entered(entry, n, len(self.text))
            for s in range(min(self.states, len(sums) - n)):
                if sums[n + s] > LOWEST:
                    out[s] = trace(self.text, sums, n + s, entry, self.vocab)[0]
            return out
        first = self.cut[0]
        out[:] = trace(self.body[:first], self._entered(entry, first, first), first, entry[: first + 1], self.vocab)[0]
        return out

    def ids(self, entry: np.ndarray, right: int) -> bytes:
        """Ids of the pieces that begin in the chunk, the last of them reaching ``right`` characters over its end."""
        n = len(self.body)
        if self.cut is None:
            sums = self._entered(entry, n, len(self.text))
            return np.array(trace(self.text, sums, n + right, entry, self.vocab)[1], "<i4").tobytes()
        first, last = self.cut
        head = trace(self.body[:first], self._entered(entry, first, first), first, entry[: first + 1], self.vocab)[1]
        words = self._inner()
        self.encoder.prepare(set(words))
        text = self.text[last:]
        start = np.array([0.0])
        tail = trace(text, best_sums(text, {0: 0.0}, self.vocab, n - last), n - last + right, start, self.vocab)[1]
        return b"".join([np.array(head, "<i4").tobytes(), *map(self.encoder.ids.__getitem__, words), np.array(tail, "<i4").tobytes()])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices where sums are taken for products and the maximum for sums."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def running_products(matrices: np.ndarray) -> np.ndarray:
    """Product of each matrix with all before it, in a logarithmic number of rounds."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = max_plus(out[:-reach], out[reach:])
        reach *= 2
    return out


def running_maps(maps: np.ndarray) -> np.ndarray:
    """Each map applied after all that follow it: from the state at the very right to the state at each chunk's left."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        later = out[reach:]
        out[:-reach] = np.where(later >= 0, np.take_along_axis(out[:-reach], np.maximum(later, 0), axis=1), -1)
        reach *= 2
    return out


def chunks_of(text: str, size: int, reach: int) -> Iterator[tuple[int, str, str, str]]:
    """Number, character before, body and the ``reach`` characters after each chunk; the last is not shorter than ``reach``."""
    whole = normal(text)
    starts = list(range(0, len(whole), size)) or [0]
    if len(starts) > 1 and len(whole) - starts[-1] <= reach:
        starts.pop()
    for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(whole)], strict=True)):
        yield number, whole[a - 1 : a] if a else "", whole[a:b], whole[b : b + reach]


def _schema(docs: DataFrame, keep: tuple[str, ...], *more: tuple[str, str]) -> T.StructType:
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    return T.StructType([*fields, *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind in more)])


def _is_giant(text: str, chunk_chars: int) -> Column:
    return F.length(F.coalesce(F.col(text), F.lit(""))) > chunk_chars


def encode_whole(docs: DataFrame, path: str, keep: tuple[str, ...], text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``keep`` and ``ids`` of every text of up to ``chunk_chars`` characters; a null or empty text has no ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in slices(batches, -1, BYTES_AT_ONCE):
            ids = encoder.encode([normal(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()])
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=[*keep, "ids"])

    short = docs.where(~_is_giant(text, chunk_chars)).select(*keep, F.col(text).alias("_text"))
    return short.mapInArrow(run, _schema(docs, keep, ("ids", "array<int>")))


def encode_giants(docs: DataFrame, path: str, keep: tuple[str, ...], text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``keep``, ``row_key`` (one per text), ``chunk`` and ``ids`` of every longer text, one row per chunk."""
    reach = vocabulary(path).longest - 1
    giants = docs.where(_is_giant(text, chunk_chars)).select(*keep, F.col(text).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, -1, BYTES_AT_ONCE):
            for at, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                parts = list(chunks_of(body, chunk_chars, reach))
                kept = [pa.concat_arrays([c.slice(at, 1)] * len(parts)) for c in batch.columns[:-1]]
                columns = [pa.array(v, kind) for v, kind in zip(zip(*parts, strict=True), (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([key] * len(parts), pa.int64()), *columns], names=[*keep, "row_key", "chunk", "before", "body", "after"])
                key += 1

    cut_schema = _schema(docs, keep, ("row_key", "long"), ("chunk", "int"), ("before", "string"), ("body", "string"), ("after", "string"))
    chunks = stage(stage(giants.mapInArrow(cut, cut_schema), "cut").repartition(F.col("row_key"), F.col("chunk")), "chunks")
    place = ["row_key", "chunk"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in slices(batches, BODY, BYTES_AT_ONCE):
            found = [Chunk(*row, encoder).matrix().ravel() for row in zip(*(c.to_pylist() for c in batch.columns[2:5]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.float64()))], names=[*place, "matrix"])

    def scan_sums(frame: pd.DataFrame) -> pd.DataFrame:
        # A row's text is shorter than 2**31 bytes, so a document has fewer than 2**31 / chunk_chars of these small matrices.
        frame = frame.sort_values("chunk")
        side = int(len(frame["matrix"].iloc[0]) ** 0.5)
        products = running_products(np.stack(frame["matrix"].to_list()).reshape(-1, side, side))
        first = np.full(side, LOWEST)
        first[0] = 0.0
        return pd.DataFrame({"row_key": frame["row_key"], "chunk": frame["chunk"], "entry": [first, *(p[0] for p in products[:-1])]})

    texts = chunks.select(*place, "before", "body", "after")  # the body at place BODY
    sums = stage(texts.mapInArrow(matrices, "row_key long, chunk int, matrix array<double>").groupBy("row_key").applyInPandas(
        scan_sums, "row_key long, chunk int, entry array<double>"), "entries")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in slices(batches, BODY, BYTES_AT_ONCE):
            found = [Chunk(*row, encoder).left_states(np.array(entry)) for *row, entry in zip(*(c.to_pylist() for c in batch.columns[2:6]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=[*place, "left"])

    def scan_maps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        lefts = running_maps(np.stack(frame["left"].to_list()))[:, 0]  # the text ends in state 0
        return pd.DataFrame({"row_key": frame["row_key"], "chunk": frame["chunk"], "right": np.append(lefts[1:], 0)})

    rights = stage(texts.join(sums, place).select(*place, "before", "body", "after", "entry").mapInArrow(maps, "row_key long, chunk int, left array<long>").groupBy("row_key").applyInPandas(
        scan_maps, "row_key long, chunk int, right long"), "rights")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in slices(batches, -4, BYTES_AT_ONCE):
            columns = [c.to_pylist() for c in batch.columns[-5:]]
            ids = [np.frombuffer(Chunk(before, body, after, encoder).ids(np.array(entry), right), "<i4") for before, body, after, entry, right in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-5], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, *place, "ids"])

    ready = chunks.join(sums, place).join(rights, place).select(*keep, *place, "before", "body", "after", "entry", "right")
    return ready.mapInArrow(traced, _schema(docs, keep, ("row_key", "long"), ("chunk", "int"), ("ids", "array<int>")))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``keep``, ``row_key``, ``chunk`` and ``ids``: short texts in one row (key null, chunk 0), giant ones in a row per chunk.

    Repeated rows are encoded each; an empty table gives no rows.  Ids do not depend on ``chunk_chars``.
    """
    whole = encode_whole(docs, path, keep, text, chunk_chars).select(*keep, F.lit(None).cast("long").alias("row_key"), F.lit(0).alias("chunk"), "ids")
    return whole.unionByName(encode_giants(docs, path, keep, text, chunk_chars))


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """The stretch of normalised text that ids stand for, with blanks for space pieces."""
    if vocab.byte_of.keys().isdisjoint(ids):
        text = "".join(map(vocab.piece_of.__getitem__, ids))
    else:
        text = b"".join(bytes([vocab.byte_of[i]]) if i in vocab.byte_of else vocab.piece_of[i].encode() for i in ids).decode("utf-8", "replace")
    return text.replace(SPACE, " ")


def digest(ids: np.ndarray, before: int = 0) -> int:
    """Sum of id times place, modulo a prime, where ``before`` ids come earlier."""
    total = 0
    for at in range(0, len(ids), 1 << 20):
        part = ids[at : at + (1 << 20)].astype(np.int64)
        total += int((part * np.arange(1, len(part) + 1)).sum()) + int(part.sum()) * (before + at)
    return total % DIGEST_PRIME


RESULT = (("n_pieces", "long"), ("ids_digest", "long"), ("decoded_crc32", "long"))


def _results(spans: list[np.ndarray], vocab: Vocabulary) -> list[pa.Array]:
    crc = [zlib.crc32(decode_ids(ids.tolist(), vocab)[1:].encode()) for ids in spans]
    return [pa.array([len(ids) for ids in spans], pa.int64()), pa.array([digest(ids) for ids in spans], pa.int64()), pa.array(crc, pa.int64())]


def encode_and_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``keep`` with the number of ids of each text, a digest of them in order, and the checksum of what they decode to.

    ``round_trip`` says whether that is the text (where the space piece's own character counts as a blank).
    A null text counts as empty: no ids, checksum 0.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    rows = docs.select(*keep, F.col(text).alias("_body"), F.crc32(F.encode(plain, "UTF-8")).alias("text_crc32"))
    held_columns = (*keep, "text_crc32")

    def shorts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Encoded and decoded by one worker: ids need not cross to a second one.
        encoder = word_encoder(path)
        for batch in slices(batches, -1, BYTES_AT_ONCE):
            ids = encoder.encode([normal(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_results([np.frombuffer(i, "<i4") for i in ids], encoder.vocab)], names=[*held_columns, *(n for n, _ in RESULT)])

    def giant(key: tuple, chunks: pa.Table) -> pa.Table:
        # The chunks of one text: what a row held.
        vocab, n, total, crc, first = vocabulary(path), 0, 0, 0, True
        chunks = chunks.sort_by("chunk")
        for ids in chunks.column("ids"):
            values = ids.values.to_numpy(zero_copy_only=False)
            total += digest(values, n)
            n += len(values)
            part = decode_ids(values.tolist(), vocab)
            crc, first = zlib.crc32((part[1:] if first else part).encode(), crc), False
        return pa.table([*(chunks.column(c).slice(0, 1) for c in held_columns), [n], [total % DIGEST_PRIME], [crc]], names=[*held_columns, *(n for n, _ in RESULT)])

    schema = _schema(rows, held_columns, *RESULT)
    short = rows.where(~_is_giant("_body", chunk_chars)).select(*held_columns, "_body")
    done = short.mapInArrow(shorts, schema).unionByName(
        encode_giants(rows, path, held_columns, "_body", chunk_chars).groupBy("row_key").applyInArrow(giant, schema))
    return done.select(*keep, *(n for n, _ in RESULT), (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))


@query("op4_sentencepiece")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(table(spark, folder, "documents"), vocabulary_file(MODEL))
