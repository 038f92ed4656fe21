"""A fixed public vocabulary of pieces, and where its pieces lie in words."""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece

#: Cells (words times positions) of one block of words that are worked on together.
BLOCK_CELLS = 60_000
SPACE = "▁"
#: Odd multipliers of the hash of a stretch of characters and of its place in the table, and the table's size.
_BASE, _MIX, _TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 19


class Vocabulary:
    """Pieces of a sentencepiece model; a character that is no piece falls back to the pieces of its bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        ids = range(self.size)
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.piece_of = [model.id_to_piece(i) for i in ids]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id_of))
        self.scores = np.array([model.get_score(i) for i in ids])
        self.score_list = self.scores.tolist()
        self.is_byte = np.isin(np.arange(self.size), list(self.byte_of))
        usual = self.scores[[i for i in plain if self.scores[i] > -1e8]]
        self.fallback_score = float(usual.min()) - 10

    @functools.cached_property
    def begins(self) -> dict[str, int]:
        """Every beginning of a piece, with the piece's id or -1."""
        return {piece[:n]: -1 for piece in self.id_of for n in range(1, len(piece))} | self.id_of

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown) for b in char.encode("utf-8", "replace")]

    @functools.cached_property
    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """The beginnings of pieces in a table with open addresses: their 64-bit hashes and their ids."""
        texts = list(self.begins)
        codes = np.zeros((len(texts), self.longest), np.uint64)
        for n, text in enumerate(texts):
            codes[n, : len(text)] = [ord(c) for c in text]
        sizes, hashes = np.array([len(t) for t in texts]), np.zeros(len(texts), np.uint64)
        for k in range(self.longest):
            hashes = np.where(sizes > k, hashes * _BASE + codes[:, k] + np.uint64(1), hashes)
        assert len(np.unique(hashes)) == len(texts) and hashes.all()
        keys, ids = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -2, np.int32)
        for value, found in zip(hashes.tolist(), self.begins.values(), strict=True):
            at = (value * int(_MIX) & (1 << 64) - 1) >> 64 - _TABLE_BITS
            while keys[at]:
                at = (at + 1) & (1 << _TABLE_BITS) - 1
            keys[at], ids[at] = value, found
        return keys, ids

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, -1 for a mere beginning, -2 for none."""
        keys, ids = self._hashed
        at = (hashes * _MIX) >> np.uint64(64 - _TABLE_BITS)
        at = at.astype(np.int64)
        found = np.where(keys[at] == hashes, ids[at], -2)
        open_ = np.flatnonzero((keys[at] != hashes) & (keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (1 << _TABLE_BITS) - 1
            now = keys[at[open_]]
            hit = now == hashes[open_]
            found[open_[hit]] = ids[at[open_[hit]]]
            open_ = open_[~hit & (now != 0)]
        return found

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Word, end, length and id of every piece in every word, and the byte ids that ids from ``size`` on stand for.

        All positions of all words are followed together, one character further at a time, as long as what lies
        behind is the beginning of a piece.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        active, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        at, end, length, ids = [], [], [], []
        extra: dict[int, list[int]] = {}
        for k in range(1, self.longest + 1):
            more = left[active] >= k
            active, hashes = active[more], hashes[more]
            if not len(active):
                break
            hashes = hashes * _BASE + codes[active + (k - 1)] + np.uint64(1)
            found = self._look_up(hashes)
            whole = found >= 0
            if k == 1 and not whole.all():
                odd = active[~whole]
                kinds, which = np.unique(codes[odd], return_inverse=True)
                extra = {self.size + n: self.fallback(chr(int(c))) for n, c in enumerate(kinds)}
                at.append(word[odd]), end.append(place[odd] + 1), length.append(np.ones(len(odd), np.int64)), ids.append(self.size + which)
            hit = active[whole]
            at.append(word[hit]), end.append(place[hit] + k), length.append(np.full(len(hit), k)), ids.append(found[whole].astype(np.int64))
            begun = found > -2
            active, hashes = active[begun], hashes[begun]
        if not at:
            return *(np.zeros(0, np.int64) for _ in range(4)), extra
        return np.concatenate(at), np.concatenate(end), np.concatenate(length), np.concatenate(ids), extra


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per process."""
    return Vocabulary(path)


def blocks(words: list[str]) -> list[list[str]]:
    """The words by length, in blocks of bounded size."""
    out, now, cells = [], [], 0
    for word in sorted(words, key=len):
        if now and (len(now) + 1) * (len(word) + 1) > BLOCK_CELLS:
            out.append(now)
            now = []
        now.append(word)
    return [*out, now] if now else out


def steps(end: np.ndarray, length: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Matches by end and length, ends ascending: within one step each word occurs once at most."""
    if not len(end):
        return []
    width = int(length.max()) + 1
    code = end * width + length
    order = np.argsort(code.astype(np.int16) if code.max() < 1 << 15 else code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    return [(int(end[part[0]]), int(length[part[0]]), part) for part in np.split(order, cuts)]
