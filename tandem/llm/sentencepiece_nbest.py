"""SentencePiece encoding and decoding with n-best segmentations.

A text is read as SentencePiece reads it without normalisation: a space is put
before it, a space is part of the piece it starts, and a byte that no piece
covers becomes its fallback piece.  The best segmentation has the largest sum
of piece log probabilities (``lattice.zipf_log_probs``).

No piece goes on past a space into the next run of spaces, nor over a line
feed, so a text's lattice is a chain of the lattices of its units (a run of
spaces and what follows it).  For every distinct unit:

* forward Viterbi scores give the best path;
* forward and backward scores give the exact loss of the second-best path:
  the least loss over arcs that the best path does not use.

A text's n best segmentations change only units among the n - 1 occurrences
with the smallest such loss.  Those units are searched by A*, backward from
their end, with the forward Viterbi scores as exact heuristics, and their
alternatives are combined into the n best of the text.  A row holds the piece
ids of the best segmentation and, for each of the n, the runs of those ids that
it replaces; ``segmentations`` writes all n out.

Defined results: null or empty text has no pieces, score 0 and itself as its
only segmentation; a text has fewer than n segmentations if its lattice has.
The best among equal scores is the path whose pieces, read from the end, are
longer first; those after it are distinct, and the same in every run.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, key_text, ranges, slabs
from .lattice import Lattice, Pieces, load_pieces, zipf_log_probs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
LONG_UNIT = 64


class Codec:
    def __init__(self, vocab: Pieces, n_best: int = N_BEST):
        self.vocab, self.n_best = vocab, n_best
        self.lattice = Lattice(vocab)
        self.score = zipf_log_probs(vocab)
        self.by_bytes = dict(zip(vocab.pieces, vocab.ids))
        self.piece_of = [b""] * vocab.size
        for piece, i in self.by_bytes.items():
            self.piece_of[i] = piece
        for b, i in enumerate(vocab.byte_ids):
            self.piece_of[i] = bytes([b])
        self.found: dict[bytes, list[tuple[float, list[int]]]] = {}

    # ------------------------------------------------------------- one unit
    def arcs_into(self, unit: bytes, j: int) -> list[tuple[int, int]]:
        """(start, piece id) of the arcs that end at byte j, longest first."""
        out = []
        for i in range(max(0, j - self.lattice.longest), j):
            k = self.by_bytes.get(unit[i:j])
            if k is not None:
                out.append((i, k))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, self.vocab.byte_ids[unit[j - 1]]))
        return out

    def viterbi(self, unit: bytes) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """Best score of a path from the start to each byte, and the arcs into it."""
        alpha, into = [0.0] + [0.0] * len(unit), [[]]
        for j in range(1, len(unit) + 1):
            arcs = self.arcs_into(unit, j)
            into.append(arcs)
            alpha[j] = max(alpha[i] + self.score[k] for i, k in arcs)
        return alpha, into

    def a_star(self, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, piece ids), best first: backward from the end, a
        partial path's priority is its own score plus the forward Viterbi score
        of where it stands, which is exactly the best it can still reach.  Among
        equals the path that has come furthest goes first."""
        alpha, into = self.viterbi(unit)
        heap = [(-alpha[-1], len(unit), 0, 0.0, ())]
        out, made = [], 0
        while heap and len(out) < n:
            _, at, _, own, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((own, ids))
                continue
            for i, k in into[at]:
                made += 1
                score = own + self.score[k]
                heapq.heappush(heap, (-(score + alpha[i]), i, made, score, (k, path)))
        return out

    def alternatives(self, unit: bytes) -> list[tuple[float, list[int]]]:
        if unit not in self.found:
            if len(self.found) > 200_000:
                self.found.clear()
            self.found[unit] = self.a_star(unit, self.n_best)
        return self.found[unit]

    # --------------------------------------------------------- many units
    def best_paths(self, data, rolling, starts, lengths):
        """For distinct units: ids of the best paths end to end, their offsets,
        best scores, and the loss of the second-best path (inf: there is none)."""
        n = len(starts)
        best, loss = np.zeros(n), np.full(n, np.inf)
        count = np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, pieces per unit, ids
        long = np.flatnonzero(lengths > LONG_UNIT)
        for u in long:
            unit = data[starts[u]:starts[u] + lengths[u]].tobytes()
            ids, best[u], loss[u] = self._long_unit(unit)
            count[u] = len(ids)
            kept.append((np.array([u]), count[u:u + 1], np.array(ids, np.int32)))
        short = np.flatnonzero(lengths <= LONG_UNIT)
        for which, size, arcs in self.lattice.blocks(data, rolling, starts[short], lengths[short]):
            which = short[which]
            rows, m = np.arange(len(which)), len(which)
            alpha = np.full((size + 1, m), -np.inf)
            alpha[0] = 0.0
            back, piece = np.zeros((size + 1, m), np.int32), np.zeros((size + 1, m), np.int32)
            order = sorted(arcs.items(), key=lambda a: (a[0][1], a[0][0]))
            for (i, j), (r, ids) in order:
                new = alpha[i][r] + self.score[ids]
                better = new > alpha[j][r]
                r, ids, new = r[better], ids[better], new[better]
                alpha[j][r], back[j][r], piece[j][r] = new, i, ids
            path, at, used = [], np.full(m, size), np.full((size + 1, m), -1, np.int32)
            while at.any():
                live = at > 0
                path.append(np.where(live, piece[at, rows], -1))
                before = np.where(live, back[at, rows], 0)
                used[at[live], rows[live]] = before[live]
                at = before
            beta = np.full((size + 1, m), -np.inf)
            beta[size] = 0.0
            second = np.full(m, -np.inf)
            for (i, j), (r, ids) in sorted(arcs.items(), key=lambda a: (a[0][0], a[0][1]), reverse=True):
                rest = self.score[ids] + beta[j][r]
                beta[i][r] = np.maximum(beta[i][r], rest)
                off = used[j][r] != i
                second[r[off]] = np.maximum(second[r[off]], alpha[i][r[off]] + rest[off])
            best[which], loss[which] = alpha[size], np.maximum(alpha[size] - second, 0.0)
            grid = np.stack(path[::-1], axis=1)
            pieces = (grid >= 0).sum(1)
            count[which] = pieces
            kept.append((which, pieces, grid[grid >= 0].astype(np.int32)))
        offsets = np.r_[0, np.cumsum(count)]
        ids = np.zeros(offsets[-1], np.int32)
        for which, pieces, flat in kept:
            ids[ranges(offsets[which], pieces)] = flat
        return ids, offsets, best, loss

    def _long_unit(self, unit: bytes) -> tuple[list[int], float, float]:
        alpha, into = self.viterbi(unit)
        ids, on, at = [], {}, len(unit)
        while at:
            i, k = max(into[at], key=lambda a: (alpha[a[0]] + self.score[a[1]], -a[0]))
            ids.append(k)
            on[at] = i
            at = i
        beta, second = [-np.inf] * len(unit) + [0.0], -np.inf
        for j in range(len(unit), 0, -1):
            for i, k in into[j]:
                rest = self.score[k] + beta[j]
                beta[i] = max(beta[i], rest)
                if on.get(j, -1) != i:
                    second = max(second, alpha[i] + rest)
        return ids[::-1], alpha[-1], max(alpha[-1] - second, 0.0)

    # ---------------------------------------------------------------- texts
    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """For texts end to end: (ids, offsets of each text's ids, best scores,
        n-best scores as a list of lists, n-best changes as a list of lists).

        A change is (start, length, ids): the ids put in place of ``length`` ids
        of the text's best segmentation from ``start``."""
        n = len(offsets) - 1
        size = offsets[1:] - offsets[:-1]
        led_offsets = np.r_[0, np.cumsum(size + (size > 0))]
        led = np.full(led_offsets[-1], 32, np.uint8)
        body = np.ones(led_offsets[-1], bool)
        body[led_offsets[:-1][size > 0]] = False
        led[body] = data
        m = len(led)
        if m == 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.int32), np.zeros(n + 1, np.int64), np.zeros(n), [[0.0]] * n, [[[]]] * n
        space, feed = led == 32, led == 10
        cut = np.zeros(m, bool)
        cut[led_offsets[:-1][size > 0]] = True
        cut[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.r_[starts, m])
        text = np.searchsorted(led_offsets, starts, "right") - 1
        rolling = Rolling(led)
        _, first, number = np.unique(rolling.span(starts, starts + lengths), return_index=True, return_inverse=True)
        ids, at, best, loss = self.best_paths(led, rolling, starts[first], lengths[first])
        pieces = np.diff(at)[number]
        flat = ids[ranges(at[:-1][number], pieces)]
        unit_start = np.searchsorted(text, np.arange(n + 1))
        piece_at = np.r_[0, np.cumsum(pieces)]
        text_at = piece_at[unit_start]
        score = np.bincount(text, best[number], n)
        scores, changes = [], []
        unit_loss = loss[number]
        for t in range(n):
            a, b = unit_start[t], unit_start[t + 1]
            s, c = self._n_best(float(score[t]), unit_loss[a:b],
                                lambda k, a=a: led[starts[a + k]:starts[a + k] + lengths[a + k]].tobytes())
            scores.append(s)
            changes.append([[(int(piece_at[a + k] - text_at[t]), int(pieces[a + k]), new) for k, new in changed]
                            for changed in c])
        return flat, text_at, score, scores, changes

    def _n_best(self, score: float, loss: np.ndarray, unit_at):
        """Scores of the n best segmentations, and what each changes against the
        best one: a list of (unit number, ids)."""
        want = self.n_best - 1
        if want == 0 or len(loss) == 0:
            return [score], [[]]
        if len(loss) > want:
            bound = np.partition(loss, want - 1)[want - 1]
            near = np.flatnonzero(loss <= bound)
            near = near[np.argsort(loss[near], kind="stable")][:want]
        else:
            near = np.arange(len(loss))
        combos = [(0.0, [])]
        for k in sorted(int(x) for x in near if np.isfinite(loss[x])):
            options = self.alternatives(unit_at(k))
            top = options[0][0]
            combos = sorted(((lost + top - s, changed if r == 0 else changed + [(k, ids)])
                             for lost, changed in combos for r, (s, ids) in enumerate(options)),
                            key=lambda c: c[0])[:self.n_best]
        return [score - lost for lost, _ in combos], [changed for _, changed in combos]

    def spelled(self, ids) -> bytes:
        return b"".join(map(self.piece_of.__getitem__, ids))

    def decode(self, ids) -> bytes:
        """The text of a list of ids: their pieces without the leading space."""
        return self.spelled(ids)[1:]

    def round_trip(self, text: bytes, ids: list[int], changes) -> bool:
        """Whether every segmentation gives the text back: the best one does, and
        what the others put in spells what they replace."""
        return self.decode(ids) == text and all(
            self.spelled(new) == self.spelled(ids[start:start + length])
            for changed in changes for start, length, new in changed)


NEW = ("n_pieces long, score double, nbest_scores array<double>, round_trip boolean, piece_ids array<int>, "
       "nbest_changes array<array<struct<start:int,length:int,ids:array<int>>>>")
ADDED = [c.split()[0] for c in NEW.split(", ")]


def _lists(values: list, inner=None) -> pa.ListArray:
    """A list array of lists; their values end to end go through ``inner``."""
    flat = [x for v in values for x in v]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)),
                                    inner(flat) if inner else pa.array(flat, pa.int32()))


def _changes(flat: list) -> pa.StructArray:
    start, length, ids = zip(*flat) if flat else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), _lists(ids)],
                                      names=["start", "length", "ids"])


def _encode(vocab: Pieces, n_best: int):
    """The rows as they are, and the columns of ``NEW`` after them."""

    def run(batches):
        codec = Codec(vocab, n_best)
        for rows, data, offsets in slabs(batches):
            flat, at, score, scores, changes = codec.encode(data, offsets)
            ids = flat.tolist()
            same = [codec.round_trip(data[offsets[t]:offsets[t + 1]].tobytes(), ids[at[t]:at[t + 1]], changes[t])
                    for t in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.diff(at)), pa.array(score),
                 pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)),
                 _lists(changes, lambda ranks: _lists(ranks, _changes))],
                names=[*rows.schema.names, *ADDED])

    return run


def encode_columns(documents: DataFrame, model_file: str = VOCABULARY, n_best: int = N_BEST) -> DataFrame:
    """``documents`` with all columns and the encoding's: n_pieces, score,
    nbest_scores, round_trip (decoding any of the n gives the text back), piece_ids
    of the best segmentation and nbest_changes: for each of the n, which runs
    of piece_ids it replaces by which ids.  Columns of those names give way."""
    rows = documents.drop(*ADDED)
    schema = T.StructType(rows.schema.fields + T.StructType.fromDDL(NEW).fields)
    return rows.mapInArrow(_encode(load_pieces(model_file), n_best), schema)


def encode_documents(documents: DataFrame, model_file: str = VOCABULARY, n_best: int = N_BEST) -> DataFrame:
    """doc_id and the encoding's columns for every whole text."""
    return encode_columns(key_text(documents), model_file, n_best).drop("text")


def segmentations(encoded: DataFrame) -> DataFrame:
    """doc_id, rank (from 1), score, piece_ids: a row per segmentation of frames
    that ``encode_columns`` gave."""

    def put(ids, c):
        after = c["start"] + c["length"]
        return F.concat(F.slice(ids, 1, c["start"]), c["ids"], F.slice(ids, after + 1, F.greatest(
            F.size(ids) - after, F.lit(0))))

    ranked = encoded.select("doc_id", "piece_ids", F.posexplode(
        F.arrays_zip("nbest_scores", "nbest_changes")).alias("rank", "one"))
    # from the last change to the first, so that the starts hold
    return ranked.select("doc_id", (F.col("rank") + 1).alias("rank"), F.col("one.nbest_scores").alias("score"),
                         F.aggregate(F.reverse("one.nbest_changes"), F.col("piece_ids"), put).alias("piece_ids"))


def _decode(vocab: Pieces):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = Codec(vocab, 1)
        for rows in batches:
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([None if x is None else codec.decode(x).decode("utf-8", "replace")
                                           for x in rows.column(1).to_pylist()], pa.string())], schema=schema)

    return run


def decode_documents(encoded: DataFrame, model_file: str = VOCABULARY) -> DataFrame:
    """doc_id, text of frames with ``doc_id`` and ``piece_ids``."""
    return encoded.select("doc_id", "piece_ids").mapInArrow(_decode(load_pieces(model_file)), "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
