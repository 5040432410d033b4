"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's likelihood in a language sums, by the forward algorithm, the products
of piece probabilities over all its segmentations; a text's is the product
over its words, and the posterior over languages gives prediction and score.

The piece probabilities are expected counts: forward and backward sums under a
prior that is the same for all languages give each piece's posterior use in
every word of every training document.  All training documents count; what
reaches the driver is one row per language and vocabulary piece.

Words are maximal runs of letters (ASCII letters and every character beyond
ASCII), lower-cased, with a leading space mark.  Scoring sums over all segmentations of
the whole word, whatever its length, scaling the forward sums before they underflow;
training counts words of more than ``MAX_TRAINING_WORD`` bytes in parts, cut between
characters.  Defined results: null text
or text without a letter is ``und`` with score 0, and so is every text when
there is nothing to learn from; equal posteriors go to the smaller name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, buffers, held_out, runs_of, slabs
from .lattice import Lattice, Pieces, load_pieces, with_lead, zipf_log_probs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: training counts the pieces of longer words in parts of whole characters; scoring takes words whole
MAX_TRAINING_WORD = 32
#: words of more bytes are scored one by one
LONG_WORD = 256
#: forward values are scaled up when the largest in reach falls below SMALL, looked at every so many bytes
SMALL, RESCALE_EVERY = 1e-60, 8
UND = "und"
#: text bytes taken together: distinct words are scored once in each
SLAB = 8 << 20
#: pseudo-count spread over the vocabulary of each language, in pieces
PRIOR_PIECES = 1000.0


def _words(texts: pa.Array, longest: int | None = None):
    """(bytes with leads, rolling hash, offsets of the distinct words, text of
    each word, distinct number of each word).  With ``longest``, longer words are
    cut between characters into parts of at most that many bytes."""
    data, offsets = buffers(pc.utf8_lower(texts))
    letter = ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | (data >= 128)
    a, b = runs_of(letter, offsets)
    text = np.searchsorted(offsets, a, "right") - 1
    if longest and len(a) and (b - a).max() > longest:
        step = longest - 3  # a part may take up to three bytes more, the rest of its last character
        parts = -(-(b - a) // step)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(b, parts)
        a, text = np.repeat(a, parts) + nth * step, np.repeat(text, parts)
        b = np.minimum(a + step, stop)
        for ends, moving in ((a, nth > 0), (b, b < stop)):  # on to the next character
            inner = np.flatnonzero(moving)
            for _ in range(3):
                inner = inner[ends[inner] < stop[inner]]
                inner = inner[data[ends[inner]] & 0xC0 == 0x80]
                ends[inner] += 1
        some = b > a
        a, b, text = a[some], b[some], text[some]
    led, starts = with_lead(data, a, b)
    rolling = Rolling(led)
    if not len(a):
        return led, rolling, starts[:0], starts[:0], text, text
    _, first, number = np.unique(rolling.span(starts[:-1], starts[1:]), return_index=True, return_inverse=True)
    return led, rolling, starts[first], starts[first + 1] - starts[first], text, number


def _forward(arcs, size: int, n: int, prob: np.ndarray, longest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(alpha[position][language, row], log[language, row] to add to their logarithms);
    prob[language, id].  With ``longest`` (bytes of the longest piece) the values that later
    positions can still use are scaled up before they underflow."""
    alpha = np.zeros((size + 1, prob.shape[0], n))
    alpha[0] = 1.0
    scale = np.zeros((prob.shape[0], n))
    at = 0
    for (i, j), (rows, ids) in sorted(arcs.items()):
        if longest and i >= at + RESCALE_EVERY:
            at = i
            live = alpha[i:i + longest + 1]
            top = live.max(0)
            small = (top > 0) & (top < SMALL)
            if small.any():
                top = np.where(small, top, 1.0)
                live /= top
                scale += np.log(top)
        alpha[j][:, rows] += alpha[i][:, rows] * prob[:, ids]
    return alpha, scale


def _long_forward(lattice: Lattice, data: np.ndarray, rolling: Rolling, start: int, size: int, prob: np.ndarray) -> np.ndarray:
    """Log likelihood of one long word in each language; all spans of one length are looked up at once."""
    prefix, inverse = rolling.prefix[start:start + size + 1], rolling.inverse[start:start + size]
    arcs: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by start: (end, piece)
    for length in range(1, min(lattice.longest, size) + 1):
        at, ids = lattice.find((prefix[length:] - prefix[:size + 1 - length]) * inverse[:size + 1 - length])
        if length == 1:
            every = lattice.byte_ids[data[start:start + size]].copy()
            every[at] = ids
            at, ids = np.arange(size), every
        for i, piece in zip(at.tolist(), ids.tolist()):
            arcs[i].append((i + length, piece))
    alpha, scale = np.zeros((size + 1, prob.shape[0])), np.zeros(prob.shape[0])
    alpha[0] = 1.0
    for i in range(size):
        if i % RESCALE_EVERY == 0:  # what later positions can still use
            live = alpha[i:i + lattice.longest + 1]
            top = live.max(0)
            live /= top
            scale += np.log(top)
        for end, piece in arcs[i]:
            alpha[end] += alpha[i] * prob[:, piece]
    return np.log(alpha[size]) + scale


def _expected_counts(vocab: Pieces, langs: list[str]):
    """Rows (lang, piece, n): expected uses of each piece, one set per task."""
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])

    def run(batches):
        lattice = Lattice(vocab)
        prob = np.exp(zipf_log_probs(vocab, fallback=np.log(1e-6)))[None, :]
        total = np.zeros((len(langs), vocab.size))
        code = {x: k for k, x in enumerate(langs)}
        for rows, _, _ in slabs(batches, limit=SLAB):
            lang = np.array([code.get(x, -1) for x in rows.column(2).to_pylist()])
            data, rolling, starts, lengths, text, number = _words(rows.column(1), MAX_TRAINING_WORD)
            use = np.zeros((len(langs), len(starts)))
            np.add.at(use, (lang[text], number), 1.0)
            for which, size, arcs in lattice.blocks(data, rolling, starts, lengths):
                alpha = _forward(arcs, size, len(which), prob)[0][:, 0]
                beta = np.zeros((size + 1, len(which)))
                beta[size] = 1.0
                for (i, j), (r, ids) in sorted(arcs.items(), reverse=True):
                    beta[i][r] += beta[j][r] * prob[0, ids]
                weight = use[:, which] / alpha[size]
                who = np.concatenate([r for r, _ in arcs.values()])
                what = np.concatenate([ids for _, ids in arcs.values()])
                share = prob[0, what] * np.concatenate(
                    [alpha[i][r] * beta[j][r] for (i, j), (r, _) in arcs.items()])
                for k in range(len(langs)):
                    total[k] += np.bincount(what, share * weight[k, who], vocab.size)
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], schema=schema)

    return run


def learn(documents: DataFrame, vocab: Pieces) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece in each)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string")) \
        .where("lang is not null and text is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # the label set
    counts = (rows.mapInArrow(_expected_counts(vocab, langs), "lang int, piece int, n double")
              .groupBy("lang", "piece").agg(F.sum("n").alias("n"))).toArrow()  # languages x vocabulary at most
    total = np.zeros((len(langs), vocab.size))
    total[counts["lang"].to_numpy(), counts["piece"].to_numpy()] = counts["n"].to_numpy()
    seen = total.sum(1, keepdims=True)
    prior = np.exp(zipf_log_probs(vocab, fallback=np.log(1e-6)))
    return langs, (total + PRIOR_PIECES * prior) / (seen + PRIOR_PIECES * prior.sum())


def _has_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = buffers(texts)
    ascii_letter = np.r_[0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))]
    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~has):
        value = texts[int(k)].as_py()
        has[k] = bool(value) and any(c.isalpha() for c in value)
    return has


def _predict(vocab: Pieces, langs: list[str], prob: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        lattice = Lattice(vocab)
        for rows, _, _ in slabs(batches, limit=SLAB):
            n = rows.num_rows
            data, rolling, starts, lengths, text, number = _words(rows.column(1))
            like = np.zeros((len(langs), len(starts)))
            short = np.flatnonzero(lengths <= LONG_WORD)
            for which, size, arcs in lattice.blocks(data, rolling, starts[short], lengths[short]):
                alpha, scale = _forward(arcs, size, len(which), prob, lattice.longest)
                like[:, short[which]] = np.log(alpha[size]) + scale
            for word in np.flatnonzero(lengths > LONG_WORD):
                like[:, word] = _long_forward(lattice, data, rolling, int(starts[word]), int(lengths[word]), prob)
            total = np.stack([np.bincount(text, x[number], n) for x in like])
            share = np.exp(total - total.max(0))
            share /= share.sum(0)
            best = share.argmax(0)
            known = _has_letter(rows.column(1))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([langs[b] if k else UND for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, share[best, np.arange(n)], 0.0))], schema=schema)

    return run


def identify(documents: DataFrame, langs: list[str], prob: np.ndarray, vocab: Pieces) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not langs:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predict(vocab, langs, prob), "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocab = load_pieces(VOCABULARY)
    langs, prob = learn(documents.where(~held_out(4, 2)), vocab)
    return identify(documents, langs, prob, vocab).select(
        "doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
