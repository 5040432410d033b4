"""Piece lattices of many short strings at once, over a fixed public vocabulary.

A string's lattice has a node per byte position and an arc for every
vocabulary piece that matches there; a byte without a piece of its own has a
fallback arc, so every lattice is connected.  ``Lattice.blocks`` finds the arcs
of a block of strings with vector operations: the rolling hash of every span
is looked up in the table of piece hashes.  Callers run their own recursion
(sum for marginal likelihoods, max for best paths) over the arcs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .common import BASES, Rolling, byte_table, powers

SPACE = "▁"
OCCUPIED_LOG2 = 20


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes, the space mark written as a space; ``log_prob`` by id."""

    pieces: tuple[bytes, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]  # id of the fallback piece of each byte
    size: int


def load_pieces(model_file: str) -> Pieces:
    """Read a public SentencePiece model (on the driver; the path is a parameter)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, ids, byte_ids = [], [], [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            continue
        pieces.append(model.id_to_piece(i).replace(SPACE, " ").encode())
        ids.append(i)
    return Pieces(tuple(pieces), tuple(ids), tuple(byte_ids), model.get_piece_size())


def zipf_log_probs(vocab: Pieces, fallback: float = -50.0) -> np.ndarray:
    """Prior log probability by id: pieces are listed by falling frequency, so the
    n-th has probability in proportion to 1 / (n + 10); a fallback byte costs
    more than any path of pieces.  Multiples of 2**-20, so that sums are exact
    and equal paths have equal scores."""
    weight = 1.0 / (np.arange(len(vocab.pieces)) + 10.0)
    out = np.full(vocab.size, fallback)
    out[np.array(vocab.ids)] = np.log(weight / weight.sum())
    return np.round(out * 2.0**20) / 2.0**20


class Lattice:
    def __init__(self, vocab: Pieces):
        self.vocab = vocab
        lengths = np.array([len(p) for p in vocab.pieces])
        self.longest = int(lengths.max())
        table, power = byte_table(0), powers(self.longest, BASES[0])
        raw = np.zeros(len(vocab.pieces), np.uint64)
        for k, p in enumerate(vocab.pieces):
            data = np.frombuffer(p, np.uint8)
            raw[k] = (table[data] * power[:len(data)]).sum(dtype=np.uint64)
        order = np.argsort(raw)
        self.keys, self.ids = raw[order], np.array(vocab.ids, np.int32)[order]
        # slot -> place of one of its keys, -1: none; keys that share a slot are searched
        slot = self._slot(self.keys)
        self.place = np.full(1 << OCCUPIED_LOG2, -1, np.int32)
        self.place[slot] = np.arange(len(self.keys))
        self.crowded = np.bincount(slot.astype(np.int64), minlength=1 << OCCUPIED_LOG2) > 1
        self.byte_ids = np.array(vocab.byte_ids, np.int32)

    @staticmethod
    def _slot(raw: np.ndarray) -> np.ndarray:
        return (raw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - OCCUPIED_LOG2)

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, piece ids) of the span hashes that are pieces."""
        slot = self._slot(raw)
        k = self.place[slot]
        at = np.flatnonzero(k >= 0)
        k, want = k[at], raw[at]
        hit = self.keys[k] == want
        search = np.flatnonzero(~hit & self.crowded[slot[at]])
        if len(search):
            k[search] = np.minimum(np.searchsorted(self.keys, want[search]), len(self.keys) - 1)
            hit[search] = self.keys[k[search]] == want[search]
        return at[hit], self.ids[k[hit]]

    def blocks(self, data: np.ndarray, rolling: Rolling, starts: np.ndarray, lengths: np.ndarray,
               cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, int, dict]]:
        """Strings of one length, in blocks: (which strings, length, arcs);
        arcs[(i, j)] is (rows of the block, piece ids) for the span i..j."""
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        at = 0
        while at < len(order):
            size = int(ordered[at])
            end = int(np.searchsorted(ordered, size, "right"))
            end = min(end, at + max(1, cells // max(size * min(size, self.longest), 1)))
            which = order[at:end]
            yield which, size, self.arcs(data, rolling, starts[which], size)
            at = end

    def arcs(self, data, rolling, start, size):
        out = {}
        prefix = [rolling.prefix[start + k] for k in range(size + 1)]
        for i in range(size):
            inverse = rolling.inverse[start + i]
            rows, ids = self.find((prefix[i + 1] - prefix[i]) * inverse)
            if len(rows) < len(start):  # bytes without a piece: fallback
                lacking = np.ones(len(start), bool)
                lacking[rows] = False
                lacking = np.flatnonzero(lacking)
                rows = np.concatenate([rows, lacking])
                ids = np.concatenate([ids, self.byte_ids[data[start[lacking] + i]]])
            out[i, i + 1] = (rows, ids)
            for j in range(i + 2, min(size, i + self.longest) + 1):
                rows, ids = self.find((prefix[j] - prefix[i]) * inverse)
                if len(rows):
                    out[i, j] = (rows, ids)
        return out


def with_lead(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of a buffer laid end to end with a space before each; offsets."""
    size = ends - starts + 1
    offsets = np.r_[0, np.cumsum(size)]
    out = np.full(offsets[-1], 32, np.uint8)
    body = np.ones(offsets[-1], bool)
    body[offsets[:-1]] = False
    source = np.repeat(starts - offsets[:-1] - 1, size) + np.arange(offsets[-1])
    out[body] = data[source[body]]
    return out, offsets
