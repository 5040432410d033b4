"""Conversation repair against an exhaustive search, with awkward rows and a long conversation."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001
from tandem.llm import conversation_repair as CR
from tandem.llm.queries import QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, symbol int, copies int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by uniform-cost search over whole edit strings."""
    goal = re.compile(r"\A(s?(ua)+)?\Z")
    start = re.compile(r"\A(s?(ua)*u?)\Z")
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, k, initials, made = heapq.heappop(heap)
        if k == len(rows) and goal.match(initials):
            return cost, audit, made
        state = (k, initials[-1:])
        if (state, audit[-1:] == "I") in done:
            continue
        done.add((state, audit[-1:] == "I"))
        def put(c, letter, n, row=None):
            new = initials + (row[0][:1] if row else "")
            if row is None or row[0][:1] and start.match(new):
                heapq.heappush(heap, (cost + c, audit + letter, n, new, made + ([row] if row else [])))
        for role in ("user", "assistant"):
            put(2, "I", k, (role, ""))
        if k < len(rows):
            role, text, fault = rows[k]
            put(3, "D", k + 1)
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                put(extra, "K", k + 1, (role, text))
                for other in ("user", "assistant"):
                    put(2 + extra, "R", k + 1, (other, text))


def brute(rows):
    out = {}
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, judged = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, made = cheapest(judged)
        count = Counter(f for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def rows_of(seed=4, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "", " \t", "cut off", "What?", "Yes.", "é ß.", "a\nb.  \n", "half a"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "User"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(roles),
                         rng.choice(texts + [None, f"own {conv} {turn}."])))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 2, None, None)]
    rows += [(900, None, "user", "x.")] * 3
    return rows


def folder(spark, path, rows):
    full = [(*r, "clash", 7, 7) for r in rows]
    spark.createDataFrame(full, CONVERSATIONS).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def result(spark, path):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = QUERIES["op11_conversation_repair"](spark, path).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[n] for n in names) for r in got}


def test_every_awkward_conversation(spark, tmp_path):
    rows = rows_of()
    assert result(spark, folder(spark, tmp_path, rows)) == brute(rows)


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    assert result(spark, SF001) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert result(spark, folder(spark, tmp_path, [])) == {}


def test_long_conversation_in_many_pieces(spark, tmp_path, monkeypatch):
    """A conversation with a third of the rows is cut over tasks and pieces; same result."""
    monkeypatch.setattr(CR, "PIECE", 16)
    rng = random.Random(1)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"text {k}.", f"text {k}", ""])) for k in range(400)]
    rows += [(k, t, ("user", "assistant")[t % 2], f"t{t}.") for k in range(100, 180) for t in range(8)]
    assert result(spark, folder(spark, tmp_path, rows)) == brute(rows)


def test_repaired_rows(spark):
    rows = CR.damage(spark.read.parquet(f"{SF001}/conversations.parquet"))
    got = {}
    for r in sorted(CR.repair(rows).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append(r)
    assert all(re.match(r"\A(s?(ua)+)?\Z", "".join(r.role[0] for r in rs)) for rs in got.values())
    digest = result(spark, SF001)
    for conv, rs in got.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rs).encode()).hexdigest() == digest[conv][-1]
        assert "".join(r.edit for r in rs) == digest[conv][-2].replace("D", "")


def test_any_grammar_gives_the_same_audit():
    rng = np.random.default_rng(2)
    plain = CR.Grammar([])
    texts = [CR.symbol_text(rng.choice([3, 6, 4, 8, 0, 11], size=rng.integers(0, 40))) for _ in range(200)]
    grammar = CR.Grammar([])
    for _ in range(6):
        found = CR.pair_counts(grammar.encode(texts), np.ones(len(texts), np.int64))
        pair = max(found, key=found.get)
        grammar = CR.Grammar([*grammar.rules, (pair >> 20, pair & (1 << 20) - 1)])
    packed = grammar.encode(texts)
    assert sum(map(len, packed)) < sum(map(len, texts))
    assert [grammar.repair(t) for t in packed] == [plain.repair(t) for t in texts]


def test_pairs_of_a_run_are_disjoint():
    assert CR.pair_counts([CR.symbol_text(np.array([3, 3, 3, 3, 3]))], np.array([10])) == {(3 << 20) + 3: 20}
