"""Supervised subword embeddings in numpy (shared by quality and toxicity).

A text is a bag of hashed features: every word and every character n-gram of
its words, marked with the word's edges.  A bag's vector is the mean of its
features' learned vectors; a linear layer and a softmax give the class.  All
weights are trained together by stochastic gradient descent with per-weight
step sizes.  A text is read in passages of ``passage`` words; its bag is the
passage that speaks most for class 1, or the whole text where ``passage`` is 0.

Since everything after the hashing is linear, a trained model reduces to one
number per bucket (``Model.weights``): a text is scored by averaging those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, buffers, held_out, key_text, lower_ascii, mix, runs_of, slabs


#: text bytes scored together: a byte has several features of some 30 bytes each
SCORE_SLAB = 512 << 10


@dataclass(frozen=True)
class Config:
    buckets_log2: int = 17
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 4, 5)
    lower: bool = True
    #: also pairs of neighbouring words; all pairs of a word with itself are one feature
    pairs: bool = False
    #: words in a passage; 0: the whole text is one bag
    passage: int = 0
    epochs: int = 8
    batch: int = 64
    rate: float = 0.5
    seed: int = 7
    #: the bound on the training sample: so many labelled rows of each class at most
    max_train_per_class: int = 4000


@dataclass
class Model:
    config: Config
    weights: np.ndarray  # logit of class 1 against 0, per bucket
    bias: float


def bags(data: np.ndarray, offsets: np.ndarray, config: Config):
    """Features of a run of texts: (bucket of each feature, passage of each
    feature, text of each passage).  Features are sorted by passage; a text
    without words has no passage."""
    if config.lower:
        data = lower_ascii(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    w0, w1 = runs_of(~space, offsets)
    if not len(w0):
        none = np.zeros(0, np.int64)
        return none, none, none
    doc = np.searchsorted(offsets, w0, "right") - 1
    if config.passage:
        first = np.r_[True, doc[1:] != doc[:-1]]
        nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
        new = first | (nth % config.passage == 0)
    else:
        new = np.r_[True, doc[1:] != doc[:-1]]
    passage_of_word = np.cumsum(new) - 1
    text_of_passage = doc[new]

    # words with one edge byte on either side, so n-grams know where a word ends
    size = w1 - w0 + 2
    edges = np.cumsum(np.r_[0, size])
    marked = np.full(edges[-1], 1, np.uint8)
    at = np.ones(edges[-1], bool)
    at[edges[:-1]] = False
    at[edges[1:] - 1] = False
    marked[at] = data[~space]
    rolling = Rolling(marked)
    word_of_byte = np.repeat(np.arange(len(w0)), size)
    mask = np.uint64((1 << config.buckets_log2) - 1)
    word = rolling.span(edges[:-1], edges[1:])
    found, owner = [word & mask], [np.arange(len(w0))]
    if config.pairs:
        second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        a, b = word[second - 1], word[second]
        pair = np.where(a == b, np.uint64(1), mix(a * np.uint64(3) + b))
        found.append(mix(pair) & mask)
        owner.append(second)
    lead = (marked & 0xC0) != 0x80  # n-grams start at a character
    for n in config.ngrams:
        if len(marked) < n:
            continue
        ok = (word_of_byte[n - 1:] == word_of_byte[:len(marked) - n + 1]) & lead[:len(marked) - n + 1]
        start = np.flatnonzero(ok)
        h = rolling.grams(n)[start]
        found.append((h * np.uint64(2 * n + 1)) >> np.uint64(64 - config.buckets_log2))
        owner.append(word_of_byte[start])
    bucket, passage = np.concatenate(found).astype(np.int64), passage_of_word[np.concatenate(owner)]
    return bucket, passage, text_of_passage


def passage_logits(data, offsets, model: Model):
    """(logit of each passage, text of each passage)."""
    bucket, passage, text = bags(data, offsets, model.config)
    n = len(text)
    if not n:
        return np.zeros(0), text
    total = np.bincount(passage, model.weights[bucket], n)
    return total / np.bincount(passage, minlength=n) + model.bias, text


def scores(data, offsets, model: Model) -> np.ndarray:
    """Probability of class 1 per text; a text without words has the bias alone."""
    logits, text = passage_logits(data, offsets, model)
    out = np.full(len(offsets) - 1, float(model.bias))
    if len(text):
        best = np.full(len(out), -np.inf)
        np.maximum.at(best, text, logits)
        out[np.unique(text)] = best[np.unique(text)]
    return 1.0 / (1.0 + np.exp(-np.clip(out, -60, 60)))


def _training_bags(texts: pa.Array | list[str | None], config: Config):
    """The bags of all training texts, laid end to end: bucket and share of each
    feature (no share: all equal), start of each bag, text of each bag.  Built from a few MB of text
    at a time; equal features of a bag are merged where bags are whole texts."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    room = buffers(batch.column(0))[1][-1] * (len(config.ngrams) + 2) + 1
    cols = np.empty(room, np.int32)  # pages of it are used only as they are filled
    share = None if config.passage else np.empty(room, np.float32)
    sizes, owners, used, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for rows, data, offsets in slabs(iter([batch]), "text", 256 << 10):
        bucket, passage, text = bags(data, offsets, config)
        length = np.bincount(passage, minlength=len(text))
        if config.passage:
            col = bucket[np.argsort(passage, kind="stable")]
            sizes.append(length)
        else:
            code, count = np.unique((passage << config.buckets_log2) + bucket, return_counts=True)
            owner, col = code >> config.buckets_log2, code & ((1 << config.buckets_log2) - 1)
            share[used:used + len(col)] = count / length[owner]
            sizes.append(np.bincount(owner, minlength=len(text)))
        cols[used:used + len(col)] = col
        used += len(col)
        owners.append(text + first)
        first += rows.num_rows
    starts = np.r_[0, np.cumsum(np.concatenate(sizes))]
    return cols[:used], share if share is None else share[:used], starts, np.concatenate(owners)


def _bag_means(flat: np.ndarray, cols: np.ndarray, starts: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Mean of ``flat`` over each bag (no bag is empty), some bags at a time."""
    out = np.empty(len(starts) - 1, np.float32)
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        out[a:b] = np.add.reduceat(flat[cols[starts[a]:starts[b]]], starts[a:b] - starts[a])
    return out / np.diff(starts)


def train(texts: pa.Array | list[str | None], labels: np.ndarray, config: Config) -> Model:
    """Stochastic gradient descent on the mean log loss, classes weighted equally."""
    rng = np.random.default_rng(config.seed)
    size = 1 << config.buckets_log2
    labels = np.asarray(labels, np.int64)
    cols, share, row_start, text = _training_bags(texts, config)
    n_pass = len(text)
    text_start = np.searchsorted(text, np.arange(len(labels) + 1))

    vectors = rng.normal(0, 1.0 / config.dim, (size, config.dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (config.dim, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    seen_v, seen_l, seen_o = np.full(size, 1e-8, np.float32), np.full((config.dim, 2), 1e-8), np.full(2, 1e-8)
    weight = np.array([len(labels) / max(2 * (labels == y).sum(), 1) for y in (0, 1)])
    usable = np.flatnonzero(text_start[1:] > text_start[:-1])

    for epoch in range(config.epochs):
        rate = config.rate * (1 - epoch / config.epochs)
        order = rng.permutation(usable)
        for at in range(0, len(order), config.batch):
            docs = order[at:at + config.batch]
            if config.passage and at % (16 * config.batch) == 0:
                flat = vectors @ (layer[:, 1] - layer[:, 0])
                logit = _bag_means(flat, cols, row_start)
            if config.passage:  # the passage of each text that speaks most for class 1
                pick = np.array([text_start[d] + int(np.argmax(logit[text_start[d]:text_start[d + 1]])) for d in docs])
            else:
                pick = text_start[docs]
            sizes = row_start[pick + 1] - row_start[pick]
            entry = np.repeat(row_start[pick] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            who, col = np.repeat(np.arange(len(pick)), sizes), cols[entry]
            part = share[entry] if share is not None else np.repeat((1.0 / sizes).astype(np.float32), sizes)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            mean = np.add.reduceat(vectors[col] * part[:, None], starts, axis=0)
            z = mean @ layer + offset
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            y = labels[docs]
            err = p
            err[np.arange(len(y)), y] -= 1
            err *= weight[y][:, None] / len(y)
            g_layer, g_offset = mean.T @ err, err.sum(0)
            g_mean = (err @ layer.T).astype(np.float32)
            used, inverse = np.unique(col, return_inverse=True)
            g = np.zeros((len(used), config.dim), np.float32)
            for k in range(config.dim):
                g[:, k] = np.bincount(inverse, part * g_mean[who, k], len(used))
            seen_v[used] += (g * g).mean(1)
            vectors[used] -= rate * g / np.sqrt(seen_v[used])[:, None]
            seen_l += g_layer * g_layer
            layer -= (0.1 * rate * g_layer / np.sqrt(seen_l)).astype(np.float32)
            seen_o += g_offset * g_offset
            offset -= (0.1 * rate * g_offset / np.sqrt(seen_o)).astype(np.float32)
    return Model(config, (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(offset[1] - offset[0]))


def training_rows(documents: DataFrame, labels: DataFrame, target: str, config: Config) -> DataFrame:
    """(text, label): of the labelled rows outside the held-out fold, the first
    ``max_train_per_class`` of each class in the order of a hash of doc_id."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
            .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0)))
    picks = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_train_per_class)
             for y in (0, 1)]
    # bounded by the parameter, whatever the size of the tables
    return key_text(documents).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")


def _learn(config: Config):
    """One record of a trained model (bias, weights as bytes) from all training rows, in their order."""
    schema = pa.schema([("bias", pa.float64()), ("weights", pa.binary())])

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts.append(batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()))
            labels.append(batch.column(batch.schema.get_field_index("label")).to_numpy())
        y = np.concatenate(labels) if labels else np.zeros(0, np.int32)
        model = train(pa.concat_arrays(texts), y, config) if len(np.unique(y)) == 2 else untrained(y, config)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary())],
                                         schema=schema)

    return run


def untrained(labels: np.ndarray, config: Config) -> Model:
    """Nothing to tell the classes apart: the share of class 1 with one pseudo-count each."""
    share = (float(labels.sum()) + 1) / (len(labels) + 2)
    return Model(config, np.zeros(1 << config.buckets_log2), float(np.log(share / (1 - share))))


def fit(documents: DataFrame, labels: DataFrame, target: str, config: Config) -> Model:
    """Train on the bounded sample inside one task, which Spark repeats elsewhere if its executor is lost; only the
    model (one number a bucket) comes to the driver.  The order of the rows is fixed, so a repeat gives the same model."""
    rows = training_rows(documents, labels, target, config).repartition(1).sortWithinPartitions("doc_id", "text")
    learned = rows.mapInArrow(_learn(config), "bias double, weights binary").collect()
    if not learned:
        return untrained(np.zeros(0), config)
    return Model(config, np.frombuffer(learned[0]["weights"], np.float64), learned[0]["bias"])


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for rows, data, offsets in slabs(batches, limit=SCORE_SLAB):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(data, offsets, model))], schema=schema)

    return run


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""
    return key_text(documents).mapInArrow(_score(model), "doc_id long, score double")


def _keep_rows(model: Model, least: float):
    def run(batches):
        for rows, data, offsets in slabs(batches, limit=SCORE_SLAB):
            yield rows.filter(pa.array(scores(data, offsets, model) >= least))

    return run


def keep_documents(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that score ``least`` or more."""
    return documents.mapInArrow(_keep_rows(model, least), documents.schema)
