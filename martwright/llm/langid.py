"""Language identification by unigram models whose word probability is summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary.  A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; probabilities of pieces are learned
by expectation maximisation with the same sums.  A text is its words, so its log probability is a sum over
them, and a word met again in a task is not summed again.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import bounded_sample, held, held_out, query, slices, table, vocabulary_file, with_text
from martwright.llm.lattice import SPACE, blocks, steps, vocabulary
from martwright.session import stage

VOCABULARY = "piece_bpe_32k.model"
#: Learning reads about this many labelled documents of each language, chosen by a hash of their ids.
SAMPLE_DOCS = 400
ROUNDS = 3
SMOOTHING = 50.0
LONGEST_LEARNED = 64
KEPT_WORDS = 200_000
BYTES_AT_ONCE = 2_000_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class LanguageModel:
    """Probability of each vocabulary piece (rows) in each language (columns)."""

    languages: tuple[str, ...]
    pieces: np.ndarray
    vocabulary_path: str
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def forward(words: list[str], model: LanguageModel) -> np.ndarray:
    """Log probability of each word in each language, over all segmentations, at any length."""
    vocab = vocabulary(model.vocabulary_path)
    kinds, place, out = len(model.languages), {}, []
    known = np.log(model.pieces)
    for block in blocks(words):
        at, end, length, ids, extra = vocab.matches(block)
        table_ = known
        if extra:
            table_ = np.vstack([table_, *(known[b].sum(axis=0) for b in extra.values())])
        sizes = np.array([len(w) for w in block])
        # Logs, because a letter outside the vocabulary costs the product of its bytes: a few in a row leave the range of floats.
        sums = np.full((int(sizes.max()) + 1, len(block), kinds), -np.inf)
        sums[0] = 0.0
        for e, k, part in steps(end, length):
            rows = at[part]
            sums[e, rows] = np.logaddexp(sums[e, rows], sums[e - k, rows] + table_[ids[part]])
        out.append(sums[sizes, np.arange(len(block))])
        place.update(zip(block, range(len(place), len(place) + len(block)), strict=True))
    if not words:
        return np.zeros((0, kinds))
    whole = np.vstack(out)
    return whole[[place[w] for w in words]]


def expected_counts(words: list[str], weights: np.ndarray, kinds: np.ndarray, pieces: np.ndarray, path: str) -> np.ndarray:
    """How often each piece is expected in each language, over all segmentations of words of known language."""
    vocab, logs = vocabulary(path), np.log(pieces)
    out = np.zeros_like(pieces)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for block in blocks([words[i] for i in order]):
        rows = np.array(order[start : start + len(block)])
        start += len(block)
        at, end, length, ids, extra = vocab.matches(block)
        known = ids < vocab.size
        kind, weight = kinds[rows], weights[rows]
        p = np.zeros(len(ids))
        p[known] = logs[ids[known], kind[at[known]]]
        if extra:
            rest = {i: logs[b].sum(axis=0) for i, b in extra.items()}
            p[~known] = [rest[i][kind[a]] for i, a in zip(ids[~known].tolist(), at[~known].tolist(), strict=True)]
        sizes = np.array([len(w) for w in block])
        n = int(sizes.max())
        ahead, behind = np.full((len(block), n + 1), -np.inf), np.full((len(block), n + 1), -np.inf)
        ahead[:, 0] = 0.0
        behind[np.arange(len(block)), sizes] = 0.0
        for e, k, part in steps(end, length):
            ahead[at[part], e] = np.logaddexp(ahead[at[part], e], ahead[at[part], e - k] + p[part])
        for s, k, part in reversed(steps(end - length, length)):
            behind[at[part], s] = np.logaddexp(behind[at[part], s], p[part] + behind[at[part], s + k])
        total = ahead[np.arange(len(block)), sizes]
        share = weight[at] * np.exp(ahead[at, end - length] + p + behind[at, end] - total[at])
        np.add.at(out, (ids[known], kind[at[known]]), share[known])
        for i, b in extra.items():
            mine = ids == i
            for byte in b:
                np.add.at(out, (np.full(mine.sum(), byte), kind[at[mine]]), share[mine])
    return out


def train(labelled: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> LanguageModel:
    """Learn from whole texts of about ``sample_docs`` documents per language; rows without text or language are passed over.

    Words are counted per language before they are shuffled; a round returns to the driver one number per
    piece and language, which the vocabulary bounds.  Without any labelled row the model has no languages.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sample = bounded_sample(rows, "doc_id", "lang", sample_docs, "langid").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run in words_of(body):
                    for word in _LETTERS.findall(run):
                        counts.update((name, SPACE + word[i : i + LONGEST_LEARNED]) for i in range(0, len(word), LONGEST_LEARNED))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words = stage(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid_words")
    languages = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
    vocab = vocabulary(vocabulary_path)
    model = LanguageModel(languages, np.full((vocab.size, len(languages)), 1.0 / vocab.size), vocabulary_path)
    if not languages:
        return model
    number = {name: k for k, name in enumerate(languages)}
    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast(model.pieces)

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                part = expected_counts(frame["word"].tolist(), frame["n"].to_numpy(float), frame["lang"].map(number).to_numpy(), sent.value, vocabulary_path)  # noqa: B023
                total = part if total is None else total + part
            if total is not None:
                piece, kind = np.nonzero(total)
                yield pd.DataFrame({"piece": piece, "kind": kind, "n": total[piece, kind]})

        sums = words.mapInPandas(expect, "piece long, kind long, n double").groupBy("piece", "kind").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(model.pieces)
        counts[sums["piece"].to_numpy(), sums["kind"].to_numpy()] = sums["n"].to_numpy()
        # Every language keeps some of the pooled distribution, and that some of the even one.
        pooled = counts.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        pieces = (counts + smoothing * pooled[:, None]) / (counts.sum(axis=0) + smoothing)
        model = LanguageModel(languages, pieces, vocabulary_path)
        sent.unpersist()
    return model


class Scorer:
    """Log probabilities of texts, with a bounded table of words met before."""

    def __init__(self, model: LanguageModel):
        self.model, self.place, self.logs = model, {}, np.zeros((0, len(model.languages) + 1))

    def _learn(self, words: list[str]) -> None:
        parts = [[SPACE + w] if w.isalpha() else [SPACE + run for run in _LETTERS.findall(w)] for w in words]
        distinct = list(dict.fromkeys(p for ps in parts for p in ps))
        place, logs = {p: n for n, p in enumerate(distinct)}, forward(distinct, self.model)
        owner = np.repeat(np.arange(len(words)), [len(ps) for ps in parts])
        fresh = np.zeros((len(words), self.logs.shape[1]))
        np.add.at(fresh, owner, np.column_stack([logs, np.ones(len(logs))])[[place[p] for ps in parts for p in ps]])
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.logs = np.vstack([self.logs, fresh])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Best language and its share of the total probability (languages equally likely beforehand)."""
        names, shares = [], []
        lists = [words_of(t) if t else [] for t in texts]
        if len(self.place) > KEPT_WORDS:
            self.place, self.logs = {}, self.logs[:0]
        missing = [w for w in set().union(*lists) if w not in self.place]
        if missing:
            self._learn(missing)
        for words in lists:
            sums = self.logs[list(map(self.place.__getitem__, words))].sum(axis=0) if words else np.zeros(self.logs.shape[1])
            if not sums[-1] or not self.model.languages:
                names.append(UNDETERMINED), shares.append(0.0)
                continue
            best = int(np.argmax(sums[:-1]))
            names.append(self.model.languages[best])
            shares.append(float(1.0 / np.exp(sums[:-1] - sums[best]).sum()))
        return names, shares


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` (0 to 1) for every whole text.

    A null text, or one without letters, is ``und`` with score 0.  Equal scores go to the language first by
    code point.  Repeated rows stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("langid", sent.value.key), lambda: Scorer(sent.value))
        for batch in slices(batches, at, BYTES_AT_ONCE):
            names, shares = scorer.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def train_on(docs: DataFrame) -> LanguageModel:
    """Learn from the documents that are not held out."""
    return train(docs.where(~held_out()), vocabulary_file(VOCABULARY))


@query("op2_language_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs, train_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
