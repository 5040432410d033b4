"""Small tables with every awkward case, and brute-force versions of operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ("spans long, drops string, score string, w int, rep int, kept string, line string, text_a string, "
         "signature int, n_lines string, v int, held_out string, piece_ids string, class_id string, shard int")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
LABELS = "doc_id long, quality int, toxic int, text string"
PAGES = "page_id long, url string, html string, text string"
ITEMS = "item_id long, text string, doc_id string"
VECTORS = "vec_id long, embedding array<float>, label int, v int"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]) with extra columns of clashing names."""
    full = []
    for r in rows:
        doc, text, lang = (*r, "en")[:3]
        full.append((doc, text, lang, "src", None if text is None else len(text)) + (None,) * (EXTRA.count(",") + 1))
    return spark.createDataFrame(full, DOCUMENTS)


def tables(spark, folder, docs=None, labels=None, pages=None, items=None, vectors=None):
    """Write the tables an sf folder has; tables not given are empty."""
    docs = documents(spark, docs or [])
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, rows, schema in (("labels", labels, LABELS), ("pages", pages, PAGES), ("benchmark", items, ITEMS),
                               ("embeddings", vectors, VECTORS)):
        width = schema.count(",") + 1
        rows = [tuple(r) + (None,) * (width - len(r)) for r in rows or []]
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def brute_lines(docs):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holds = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holds[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holds.get(key(x), ())) < 2 or min(holds[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(docs, percent=85):
    """{doc_id: (set size, component)}"""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holds[x].append(d)
    for d, s in sets.items():
        for other, both in Counter(o for x in s for o in holds[x] if o < d).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute_contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, sorted item ids)}"""
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                found = windows.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def brute_repeats(docs, depth=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept bytes)}"""
    count = Counter()
    for _, t in docs:
        b = (t or "").encode()
        count.update(b[i:i + depth] for i in range(len(b) - depth + 1))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if count[b[i:i + depth]] > 1:
                gone[i:i + depth] = b"\x01" * depth
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out
