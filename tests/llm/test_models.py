"""HTML extraction, search, classifiers, language ID and segmentation: brute
force, round trips, held-out accuracy and awkward rows."""

import re

import numpy as np
import pyarrow as pa
import pytest

from helpers import fold, tables
from tandem.llm import ann, html_extract, langid, lattice, sentencepiece_nbest, subword
from tandem.llm.common import buffers
from tandem.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
MODEL = html_extract.train(html_extract.LABELLED)


# ------------------------------------------------------------------------ html

@pytest.mark.parametrize("source, blocks", [
    (None, []), ("", []), ("<p>", []),
    ("<article><h1>T</h1><p>a &lt; b &amp c</p><script>x='</p>'</script><form><p>q</p></form><p>z\n w</article>",
     ["T", "a < b & c", "z w"]),
    ("<article><p>one<br>two<p>three<ul><li>x<li>y</ul></article><div class=comments><p>no</p></div>",
     ["one two", "three", "x", "y"]),
    ("<body><div id=header>S</div><div class='post-content'><p>a</p><div class='ad'>b</div><p>c</p></div>"
     "<aside>d</aside></body>", ["a", "c"]),
    ("<div class='cookie-notice'>we</div><article data-y='x'><p>full <b>text</b><hr>more</article><footer>f</footer>",
     ["full text", "more"]),
])
def test_blocks(source, blocks):
    assert html_extract.block_texts(source, MODEL) == blocks


def test_marginals_are_exact():
    """Sum-product on the tree against all labellings."""
    import itertools
    page = html_extract.parse("<div><p>a</p><nav><a>b</a></nav></div>")
    phi = [MODEL.node_potentials(f) for f in html_extract.features(page)]
    n, want = len(page.tag), np.zeros((len(page.tag), 3))
    for labels in itertools.product(range(3), repeat=n):
        p = MODEL.root[labels[0]]
        for i in range(n):
            p *= phi[i][labels[i]]
            if i:
                p *= MODEL.edge[labels[page.parent[i]]][labels[i]]
        for i in range(n):
            want[i, labels[i]] += p
    assert np.allclose(MODEL.marginals(page), want / want.sum(1, keepdims=True))


def test_pages(spark):
    import html
    import re
    rows = QUERIES["op2_html_extract"](spark, SF01).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", " ", x)).split())
                  for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<article><p>core</p></article>"
    assert html_extract.block_texts(deep, MODEL) in (["core"], [])
    assert len(html_extract.block_texts("<article>" + "<p>x</p>" * 20000, MODEL)) == 20000


# ---------------------------------------------------------------------- search

def vectors():
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(size=8).astype(float).tolist()) for k in range(300)]
    same = [1.0] * 8
    rows += [(k, same) for k in range(300, 360)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [0.0] * 6),
             (404, [float("inf")] * 8), (405, [1.0] * 3), (None, same), (300, same), (420, [])]
    return rows


def test_nearest(spark, tmp_path):
    path = tables(spark, tmp_path, vectors=vectors())
    got = {}
    for r in QUERIES["op3_ann"](spark, path).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {i: np.array(v, np.float32).astype(float) for i, v in vectors()[:360]}
    assert set(got) == {i for i in x if i % 20 == 0}
    found = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        want = sorted(((-float(np.dot(x[q], x[i])), i) for i in x if i != q))[:20]
        assert all(abs(s - np.dot(x[q], x[i])) < 1e-12 for _, i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        found += len({i for _, i, _ in rows} & {i for _, i in want})
    assert found >= 0.9 * 20 * len(got)


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    level, flat = ann.build_graph(ids, x)
    node, _ = ann.search(x[::20], x, level, flat)
    exact = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) for a, b in zip(exact, node)]) >= 18


def test_one_vector_and_none(spark, tmp_path):
    assert QUERIES["op3_ann"](spark, tables(spark, tmp_path / "a")).collect() == []
    assert QUERIES["op3_ann"](spark, tables(spark, tmp_path / "b", vectors=[(20, [1.0, 2.0])])).collect() == []


# ----------------------------------------------------------------- classifiers

# of the held-out rows of class 1 and of class 0, the least share predicted right
@pytest.mark.parametrize("name, target, one, zero", [("op6_quality", "quality", 0.95, 0.8), ("op7_toxicity", "toxic", 0.7, 0.95)])
def test_held_out_recall_and_false_alarms(spark, name, target, one, zero):
    label = {r.doc_id: r[target] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    for y, least in ((1, one), (0, zero)):
        test = [r for r in rows if r.held_out and label.get(r.doc_id) == y]
        assert len(test) > 50 and sum(r.predicted == y for r in test) >= least * len(test)


def brute_score(text, model):
    """Score by the definition: one word, one n-gram at a time."""
    c, size = model.config, 1 << model.config.buckets_log2
    data = (text or "").encode()
    data = bytes(b + 32 if c.lower and 65 <= b <= 90 else b for b in data)
    split = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]

    def hashed(span):
        return int(subword.Rolling(np.frombuffer(span, np.uint8)).span(np.array([0]), np.array([len(span)]))[0])

    def mixed(x):
        return int(subword.mix(np.array([x % 2**64], np.uint64))[0])

    logits, step = [], c.passage or max(len(split), 1)
    for at in range(0, len(split), step):
        total = []
        for k, w in enumerate(split[at:at + step], at):
            m = b"\x01" + w + b"\x01"
            total.append(hashed(m) % size)
            if c.pairs and k:
                a, b = hashed(b"\x01" + split[k - 1] + b"\x01"), hashed(m)
                total.append(mixed(1 if a == b else mixed(a * 3 + b)) % size)
            total += [(hashed(m[i:i + n]) * (2 * n + 1)) % 2**64 >> (64 - c.buckets_log2) for n in c.ngrams
                      for i in range(len(m) - n + 1) if m[i] & 0xC0 != 0x80]
        logits.append(float(np.mean(model.weights[total])) + model.bias)
    return 1 / (1 + np.exp(-max(logits, default=model.bias)))


@pytest.mark.parametrize("config", [subword.Config(buckets_log2=10, lower=False, pairs=True), subword.Config(buckets_log2=10, passage=3)])
def test_query_scores_against_brute_force(spark, config):
    texts = ["good text here and here here", "BAD bad awful Bad", None, "", " \n\t", "é ü 你好 good", "x", "a b c d e f g bad", "word " * 40]
    docs = spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("ad" in (t or ""))) for i, t in enumerate(texts * 4)], "doc_id long, toxic int")
    model = subword.fit(docs, labels, "toxic", config)
    assert len(set(np.round(model.weights, 9))) > 10 and model.weights.tolist() == subword.fit(docs, labels, "toxic", config).weights.tolist()
    for r in subword.score_documents(docs, model).collect():
        assert abs(r.score - brute_score(texts[r.doc_id % len(texts)], model)) < 1e-9


@pytest.mark.parametrize("name", ["op6_quality", "op7_toxicity"])
def test_awkward_documents(spark, tmp_path, name):
    docs = [(k, f"good text number {k} of many") for k in range(30)] + [(k, "bad bad awful " * 5) for k in range(30, 60)]
    docs += [(60, None), (61, ""), (62, " \n"), (63, "word " * 50000), (None, "good text"), (64, "你好")]
    labels = [(k, int(k < 30), int(k >= 30)) for k in range(60)] + [(None, 1, 1), (61, None, None), (999, 1, 0)]
    path = tables(spark, tmp_path, docs, labels=labels)
    rows = {r.doc_id: r for r in QUERIES[name](spark, path).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[None].held_out is False and rows[60].score == rows[61].score == rows[62].score


@pytest.mark.parametrize("name", ["op6_quality", "op7_toxicity"])
def test_without_labels(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path / "a")).collect() == []
    rows = QUERIES[name](spark, tables(spark, tmp_path / "b", [(1, "a"), (2, None)])).collect()
    assert [r.score for r in rows] == [0.5, 0.5]


def test_score_does_not_depend_on_neighbours():
    model = subword.train(["good text here", "bad bad bad", None, "x"], np.array([1, 0, 1, 0]),
                          subword.Config(passage=2, epochs=3, pairs=True))
    texts = ["good bad x y z", "", None, "bad", "é ü good"]
    together = subword.scores(*buffers(pa.array(texts)), model)
    alone = [subword.scores(*buffers(pa.array([t], pa.string())), model)[0] for t in texts]
    assert np.allclose(together, alone)


# ------------------------------------------------------------------ language ID

def test_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, SF01).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.98 * len(test)


def test_language_of_awkward_texts(spark, tmp_path):
    docs = [(k, "the house and the garden with the tree", "en") for k in range(8)]
    docs += [(k, "das Haus und der Garten mit dem Baum", "de") for k in range(8, 16)]
    docs += [(20, None), (21, ""), (22, "12 !? 。", None), (23, "THE HOUSE", None), (24, "x" * 5000, "de"),
             (None, "und das Haus", None), (25, "你", None)]
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, tables(spark, tmp_path, docs)).collect()}
    assert [rows[k].lang_pred for k in (20, 21, 22)] == ["und"] * 3 and rows[23].lang_pred == "en"
    assert rows[None].lang_pred == "de" and rows[25].lang_pred in ("de", "en")
    assert QUERIES["op10_language_id"](spark, tables(spark, tmp_path / "none", [(1, "a", None)])).first().lang_pred == "und"


def test_forward_sums_all_segmentations():
    vocab = lattice.Pieces((b" ", b"a", b"b", b" a", b"ab", b" ab"), (1, 2, 3, 4, 5, 6), (0,) * 256, 7)
    prob = np.array([[1e-6, .3, .2, .1, .15, .05, .2]])
    data, rolling, starts, lengths, _, _ = langid._words(pa.array(["ab"]))
    (which, size, arcs), = lattice.Lattice(vocab).blocks(data, rolling, starts, lengths)
    want = .3 * .2 * .1 + .3 * .05 + .15 * .1 + .2
    assert abs(langid._forward(arcs, size, 1, prob)[0][size][0, 0] - want) < 1e-12


# ----------------------------------------------------------------- segmentation

def brute_n_best(codec, text, n):
    data = b" " + text if text else b""
    best = [[(0.0, ())]] + [[] for _ in data]
    for j in range(1, len(data) + 1):
        ways = [(s + codec.score[k], p + (k,)) for i, k in codec.arcs_into(data, j) for s, p in best[i]]
        best[j] = sorted(ways, key=lambda w: -w[0])[:n]
    return best[-1]


def test_n_best():
    codec = sentencepiece_nbest.Codec(lattice.load_pieces(sentencepiece_nbest.VOCABULARY))
    texts = ["", "hello world", "the then thé  a\n b", "  lead\ttab ▁x", "1234 日本 ing", "a", " ", "\n\n",
             "unbelievable reconsiderations " * 3, "y" * 90 + " end", None]
    flat, at, score, scores, changes = codec.encode(*buffers(pa.array(texts)))
    for t, text in enumerate(texts):
        data = (text or "").encode()
        want = brute_n_best(codec, data, 4)
        ids = flat[at[t]:at[t + 1]].tolist()
        assert np.allclose(scores[t], [s for s, _ in want]) and abs(score[t] - want[0][0]) < 1e-9
        assert codec.decode(ids) == data and len(changes[t]) == len(want)


def test_a_star_is_in_order():
    codec = sentencepiece_nbest.Codec(lattice.load_pieces(sentencepiece_nbest.VOCABULARY))
    for word in (b" internationalization", b"abcabcabc", "über".encode()):
        found = codec.a_star(word, 12)
        want = brute_n_best(codec, word[1:], 12) if word[:1] == b" " else None
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        assert len({tuple(i) for _, i in found}) == len(found)
        if want:
            assert np.allclose([s for s, _ in found], [s for s, _ in want])


def test_round_trip(spark):
    encoded = QUERIES["op8_sentencepiece"](spark, SF01)
    rows = encoded.collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    back = {r.doc_id: r.text for r in sentencepiece_nbest.decode_documents(encoded).collect()}
    assert back == {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}


def test_all_segmentations(spark, tmp_path):
    """Ids of every rank: distinct, spelling the text, with the scores of brute force, and its ids where no score ties."""
    codec = sentencepiece_nbest.Codec(lattice.load_pieces(sentencepiece_nbest.VOCABULARY))
    texts = [None, "", "a", "hello world", "the then thé  a\n b", "1234 日本 ing", "the the the the the",
             "unbelievable reconsiderations " * 3, "internationalization " + "y" * 90 + " end"]
    encoded = QUERIES["op8_sentencepiece"](spark, tables(spark, tmp_path, list(enumerate(texts))))
    assert all(r.round_trip for r in encoded.collect())
    ranked = sentencepiece_nbest.segmentations(encoded)
    assert {(r.doc_id, r.text) for r in sentencepiece_nbest.decode_documents(ranked).collect()} \
        == {(t, text or "") for t, text in enumerate(texts)}
    got = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.doc_id, r.rank)):
        got.setdefault(r.doc_id, []).append((r.score, tuple(r.piece_ids)))
    for t, text in enumerate(texts):
        want = brute_n_best(codec, (text or "").encode(), 5)
        assert [s for s, _ in got[t]] == [s for s, _ in want[:4]]
        assert len({ids for _, ids in got[t]}) == len(got[t])
        assert all(s == sum(codec.score[k] for k in ids) for s, ids in got[t])
        scores = [s for s, _ in want]
        assert all(a == b for a, b in zip(got[t], want) if scores.count(a[0]) == 1)


def test_round_trip_checks_every_rank():
    codec = sentencepiece_nbest.Codec(lattice.load_pieces(sentencepiece_nbest.VOCABULARY))
    flat, _, _, _, changes = codec.encode(*buffers(pa.array(["hello world"])))
    assert codec.round_trip(b"hello world", flat.tolist(), changes[0])
    (start, length, ids), = changes[0][1]
    assert not codec.round_trip(b"hello world", flat.tolist(), [[], [(start, length, ids[:-1])]])


@pytest.mark.parametrize("name", ["op2_html_extract", "op8_sentencepiece", "op10_language_id"])
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path)).collect() == []


def test_clashing_columns_and_awkward_rows(spark, tmp_path):
    path = tables(spark, tmp_path, [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "w" * 70000), (4, "\u0000 ▁")],
                  pages=[(1, None, None), (2, "u", ""), (None, "u", "<article><p>x</p></article>"), (2, "u", "")])
    rows = QUERIES["op8_sentencepiece"](spark, path).collect()
    assert len(rows) == 6 and all(r.round_trip for r in rows)
    assert sorted(r.text for r in QUERIES["op2_html_extract"](spark, path).collect()) == ["", "", "", "x"]


def slow_log_likelihood(vocab, word, prob):
    """log of the sum over all segmentations of one word (with its leading space), per language."""
    piece = dict(zip(vocab.pieces, vocab.ids))
    longest = max(map(len, vocab.pieces))
    total = [np.zeros(len(prob))]
    for end in range(1, len(word) + 1):
        terms = [total[end - n] + np.log(prob[:, piece[word[end - n:end]]]) for n in range(1, min(longest, end) + 1)
                 if word[end - n:end] in piece]
        if word[end - 1:end] not in piece:
            terms.append(total[end - 1] + np.log(prob[:, vocab.byte_ids[word[end - 1]]]))
        total.append(np.logaddexp.reduce(terms, axis=0))
    return total[-1]


TEXTS = ["plain words of one kind", "\u6f22\u5b57\u306e\u9577\u3044\u5217 and more", "\u12a0\u121b\u122d\u129b" * 30, "z" * 700, "\u00e9t\u00e9 " * 40,
         "a" * 33 + " " + "\u00df" * 70, "\u6f22" * 400, "x", "123 456", "", None]


def test_language_scores_are_finite_and_sum_all_segmentations():
    """Fallback bytes as rare as in a corpus of 4e9 pieces, words of every length: equal to a plain
    recursion in logarithms, finite, and between 0 and 1."""
    vocab = langid.load_pieces(langid.VOCABULARY)
    rng = np.random.default_rng(1)
    prob = rng.dirichlet(np.full(vocab.size, .1), 3) + 1e-3 / 4e9
    prob[:, vocab.byte_ids] = 1e-3 / 4e9 * rng.uniform(1, 3, (3, len(vocab.byte_ids)))
    run = langid._predict(vocab, ["aa", "bb", "cc"], prob)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())})
    got = [r for out in run([batch]) for r in out.to_pylist()]
    for text, r in zip(TEXTS, got):
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        words = re.findall(rb"[a-zA-Z\x80-\xff]+", text.lower().encode())
        total = sum(slow_log_likelihood(vocab, b" " + w, prob) for w in words)
        share = np.exp(total - np.logaddexp.reduce(total))
        assert np.isfinite(total).all() and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ["aa", "bb", "cc"][int(share.argmax())]
        assert r["score"] == pytest.approx(share.max(), rel=1e-6)


def test_training_cuts_long_words_between_characters():
    texts = ["\u6f22" * 50, "\u00e9" * 90, "a" * 100, "\U00010400" * 21]
    led, _, starts, lengths, _, _ = langid._words(pa.array(texts), langid.MAX_TRAINING_WORD)
    parts = [led[a + 1:a + n].tobytes() for a, n in zip(starts, lengths)]
    assert all(len(p) <= langid.MAX_TRAINING_WORD for p in parts) and all(p.decode() for p in parts)


@pytest.mark.parametrize("html,text", [
    ("<article><p title=it's>one two three</p><p>four five</p><p>don't stop</p></article>", "one two three\nfour five\ndon't stop"),
    ("<article><!-- c --!><p>one two three</p><!--><p>four</p><!---><p>five six</p></article>", "one two three\nfour\nfive six"),
    ("<article><p title=\"a > b\" id='x>y'>one two three</p><p data-x=5\">four</p></article>", "one two three\nfour")])
def test_quotes_and_comments_as_browsers_read_them(html, text):
    assert "\n".join(html_extract.block_texts(html, html_extract.train(html_extract.LABELLED))) == text
