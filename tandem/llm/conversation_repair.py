"""Conversation structure repair: a grammar-compressed dynamic program.

A conversation is the rows of one ``conv_id`` in the order of ``turn`` (nulls
first); rows of one turn stand in the order of role, then md5 of the text.  Its
repaired form has role initials ``(s?(ua)+)?`` and is reached by the cheapest
edits: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit of a
blank or duplicate row), Insert an empty user or assistant text 2; a truncated
row that stays adds 1.  Among cheapest edits the ASCII-least string of edit
initials, the *audit*, is taken.

* Each row becomes one of 12 symbols: role class (s, u, a, other) and fault
  (none, truncated, blank or duplicate).
* **Re-Pair**: over the distinct symbol sequences, weighted by how often they
  occur, every round counts the adjacent pairs and turns the most frequent ones
  into rules.  Rules only shorten the work: any grammar gives the same result,
  so their number (``RULES``, ``ROUNDS``) is a bound on memory.
* **One min-plus transfer matrix per rule**, over the four states of the
  pattern (start, after s, after u, after a), evaluated bottom-up from its two
  parts: least cost, the state in between, and the rank of the audit among
  those from the same state.  The state in between makes the audit a rope: it is
  spelled out only for the chosen path.  An audit fixes the states it passes and
  ends with a row's letter (inserts stand before a row, or at the very end), so
  no audit of a symbol is the beginning of another one of the same symbol: ranks
  of the parts decide every tie without comparing strings.
* A conversation is its symbols times these matrices.  Symbols are sorted over
  all tasks by range, in pieces, so a conversation holding a third of all rows
  is split like any other; only its symbols (one byte a row) meet in one place.
  Its text is streamed, never held, by the task that hashes it.

Defined results: null role and text are one space, a null ``turn`` is the
earliest; all rows with null ``conv_id`` are one conversation.  Empty texts are
blank.  Repeated rows are duplicates after the first.  Role and text are compared by
role and 128-bit hash of the text.  A conversation none of whose rows is left has
zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PIECE = 4096
RULES = 256
ROUNDS = 8
CANDIDATES = 64
MEMO = 65536
SPACE = " \t\n\x0b\x0c\r"
#: role classes and faults of a symbol: 3 * class + fault
CLASSES = "sua"
KEPT, TRUNCATED, GONE = 0, 1, 2
SYMBOLS = 12
#: states: start, after s, after u, after a
START, S, U, A = range(4)
NEVER = np.int64(1) << 40
FIRST_CHAR = 256


# ------------------------------------------------------------- min-plus algebra

def after(state: int, initial: str) -> int | None:
    """The state that a row with this role initial leads to, None if it may not stand there."""
    return {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}.get((state, initial))


def next_role(state: int) -> str:
    return "assistant" if state == U else "user"


def inserts(state: int) -> list[tuple[int, int]]:
    """(number of inserts, state) of the useful runs of inserts."""
    out = [(0, state)]
    while True:
        n, at = out[-1]
        to = after(at, next_role(at)[0])
        if to in [s for _, s in out]:
            return out
        out.append((n + 1, to))


def symbol_moves(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """{(state, state): (least cost, its ASCII-least audit)} of one row."""
    role, fault = (CLASSES + " ")[symbol // 3], symbol % 3
    best = {}
    for state in range(4):
        for n, at in inserts(state):
            edits = [(3, "D", at)]
            if fault != GONE:
                if after(at, role) is not None:
                    edits.append((fault, "K", after(at, role)))
                edits.append((2 + fault, "R", after(at, next_role(at)[0])))
            for cost, letter, to in edits:
                found = (2 * n + cost, "I" * n + letter)
                best[state, to] = min(best.get((state, to), found), found)
    return best


#: inserts after the last row, by state
ENDINGS = {START: "", S: "II", U: "I", A: ""}


class Grammar:
    """Rules ``(left, right)`` numbered from ``SYMBOLS`` on, and the matrix of every symbol."""

    def __init__(self, rules: list[tuple[int, int]]):
        self.rules = rules
        self.cost = np.full((SYMBOLS + len(rules), 4, 4), NEVER, np.int64)
        self.rank = np.full((SYMBOLS + len(rules), 4, 4), 4, np.int64)
        self.middle = np.zeros((SYMBOLS + len(rules), 4, 4), np.int64)
        self.leaf = [symbol_moves(s) for s in range(SYMBOLS)]
        self.spelled = {}
        for s, moves in enumerate(self.leaf):
            for (i, k), (cost, _) in moves.items():
                self.cost[s, i, k] = cost
            for i in range(4):
                for r, (_, k) in enumerate(sorted((text, k) for (j, k), (_, text) in moves.items() if j == i)):
                    self.rank[s, i, k] = r
        for n, (left, right) in enumerate(rules):
            self._multiply(SYMBOLS + n, left, right)
        self.moves = [[(i, k, int(self.cost[s, i, k]), int(self.rank[s, i, k]))
                       for i in range(4) for k in range(4) if self.cost[s, i, k] < NEVER]
                      for s in range(len(self.cost))]

    def _multiply(self, to: int, left: int, right: int):
        total = self.cost[left][:, :, None] + self.cost[right][None, :, :]
        # least cost, then the left part's rank: (cost, rank) as one number
        middle = (total * 8 + self.rank[left][:, :, None]).argmin(1)
        cost = np.take_along_axis(total, middle[:, None, :], 1)[:, 0]
        self.cost[to] = np.minimum(cost, NEVER)
        self.middle[to] = middle
        for i in range(4):
            reached = [k for k in range(4) if cost[i, k] < NEVER]
            reached.sort(key=lambda k: (self.rank[left, i, middle[i, k]], self.rank[right, middle[i, k], k]))
            for r, k in enumerate(reached):
                self.rank[to, i, k] = r

    def encode(self, texts: list[str]) -> list[str]:
        """Symbol strings with every rule applied, in the order of the rules."""
        joined = "\n".join(texts)
        for n, (left, right) in enumerate(self.rules):
            joined = joined.replace(chr(FIRST_CHAR + left) + chr(FIRST_CHAR + right), chr(FIRST_CHAR + SYMBOLS + n))
        return joined.split("\n")

    def spell(self, symbol: int, i: int, k: int) -> str:
        """The audit of one symbol from state i to state k."""
        if symbol < SYMBOLS:
            return self.leaf[symbol][i, k][1]
        if (symbol, i, k) not in self.spelled:
            left, right = self.rules[symbol - SYMBOLS]
            j = int(self.middle[symbol, i, k])
            self.spelled[symbol, i, k] = self.spell(left, i, j) + self.spell(right, j, k)
        return self.spelled[symbol, i, k]

    def repair(self, encoded: str) -> tuple[int, str]:
        """(least cost, audit) of an encoded conversation."""
        cost, rank = [0, NEVER, NEVER, NEVER], [0, 4, 4, 4]
        came = []
        for char in encoded:
            best = [(NEVER, 4, 4, 4)] * 4
            for i, k, c, r in self.moves[ord(char) - FIRST_CHAR]:
                found = (cost[i] + c, rank[i], r, i)
                if found < best[k]:
                    best[k] = found
            cost = [b[0] for b in best]
            came.append([b[3] for b in best])
            rank = [4] * 4
            for r, k in enumerate(sorted(range(4), key=lambda k: best[k][1:3])):
                rank[k] = r
        state = min(range(4), key=lambda k: (cost[k] + 2 * len(ENDINGS[k]), rank[k]))
        total = int(cost[state]) + 2 * len(ENDINGS[state])
        parts = [ENDINGS[state]]
        for char, back in zip(reversed(encoded), reversed(came)):
            parts.append(self.spell(ord(char) - FIRST_CHAR, back[state], state))
            state = back[state]
        return total, "".join(reversed(parts))


def symbol_text(symbols: np.ndarray) -> str:
    return (symbols.astype(np.uint32) + FIRST_CHAR).astype("<u4").tobytes().decode("utf-32-le")


def pair_counts(encoded: list[str], weights: np.ndarray) -> dict[int, int]:
    """Weighted number of disjoint occurrences of every adjacent pair, as left * 2**20 + right."""
    lengths = np.array([len(e) for e in encoded])
    chars = np.frombuffer("".join(encoded).encode("utf-32-le"), np.uint32).astype(np.int64) - FIRST_CHAR
    if len(chars) < 2:
        return {}
    owner = np.repeat(np.arange(len(encoded)), lengths)
    inside = owner[1:] == owner[:-1]
    same = inside & (chars[1:] == chars[:-1])
    # in a run of one symbol every other pair counts
    breaks = np.flatnonzero(~same)
    before = np.concatenate([[-1], breaks])[np.searchsorted(breaks, np.arange(len(same)))]
    use = inside & ~(same & ((np.arange(len(same)) - before) % 2 == 0))
    pairs = (chars[:-1] << 20 | chars[1:])[use]
    kinds, which = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, which, weights[owner[:-1][use]])
    return dict(zip(kinds.tolist(), total.tolist()))


def learn_grammar(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over ``sequences`` (symbols binary, weight long)."""
    grammar = Grammar([])
    for _ in range(rounds):
        def count(batches, grammar=grammar):
            for batch in batches:
                texts = [symbol_text(np.frombuffer(s, np.uint8)) for s in batch.column("symbols").to_pylist()]
                found = pair_counts(grammar.encode(texts), batch.column("weight").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"pair": pa.array(list(found), pa.int64()),
                                                  "n": pa.array(list(found.values()), pa.int64())})

        top = sequences.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")) \
            .where("n >= 2").orderBy(F.desc("n"), "pair").limit(CANDIDATES).collect()
        used, new = set(), []
        for row in top:
            pair = row["pair"] >> 20, row["pair"] & (1 << 20) - 1
            if not used & set(pair) and len(grammar.rules) + len(new) < rules:
                used |= set(pair)
                new.append(pair)
        if not new:
            break
        grammar = Grammar(grammar.rules + new)
    return grammar


# --------------------------------------------------------------------- on Spark

def _trimmed(text):
    return F.rtrim(text, F.lit(SPACE))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``turns`` damaged by crc32(``conv_id:turn``) % 20."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    rows = turns(conversations).withColumn("__kind", kind).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")) \
        .otherwise(F.col("text"))
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), number, symbol, fault flags: the rows
    without their texts.  Written once, since ``number`` names a row."""
    trimmed = _trimmed(F.col("text"))
    slim = written(rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("number"),
        (F.length(trimmed) == 0).alias("blank"),
        (F.length(trimmed) > 0).__and__(~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("unfinished")), "turns")
    # the first row of every text seen again; rows join it only where there is one
    seen = ["conv_id", "role", "digest"]
    first = slim.where("not blank").groupBy(*seen).agg(
        F.count("*").alias("n"), F.min(F.struct("turn", "number")).alias("first")).where("n > 1") \
        .select(*[F.col(c).alias(f"__{c}") for c in seen], F.col("first.number").alias("__number"))
    same = F.lit(True)
    for c in seen:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = slim.join(first, same & ~F.col("blank"), "left")
    duplicate = F.col("__number").isNotNull() & (F.col("number") != F.col("__number"))
    truncated = F.col("unfinished") & ~duplicate
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9)
    fault = F.when(F.col("blank") | duplicate, GONE).when(truncated, TRUNCATED).otherwise(KEPT)
    return found.select("conv_id", "turn", "role", "digest", "number", "blank", duplicate.alias("duplicate"),
                        truncated.alias("truncated"), (role + fault).cast("int").alias("symbol"))


def _pieces(batches):
    part = TaskContext.get().partitionId()
    held, start, seq = None, [], 0

    def out(conv, symbols):
        nonlocal seq
        seq += 1
        return pa.RecordBatch.from_pydict({
            "conv_id": pa.array([conv], pa.int64()), "part": pa.array([part], pa.int32()),
            "seq": pa.array([seq], pa.int64()), "symbols": pa.array([symbols], pa.binary())})

    ready = []
    for batch in batches:
        conv = batch.column("conv_id")
        symbols = batch.column("symbol").to_numpy(zero_copy_only=False).astype(np.uint8)
        ids, nulls = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            who = None if nulls[a] else int(ids[a])
            if start and who != held:
                ready.append(out(held, b"".join(start)))
                start = []
            held = who
            rest = b"".join(start) + symbols[a:b].tobytes()
            while len(rest) >= PIECE:
                ready.append(out(held, rest[:PIECE]))
                rest = rest[PIECE:]
            start = [rest] if rest else []
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready = []
    if start:
        yield out(held, b"".join(start))


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, part, seq, symbols: every conversation's symbols in order, in pieces of at most ``PIECE``."""
    order = ["conv_id", "turn", "role", "digest", "number"]
    return written(rows.select(*order, "symbol").repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_pieces, "conv_id long, part int, seq long, symbols binary"), "pieces")


def illegal_pairs(symbols: np.ndarray) -> int:
    pair = symbols[:-1] // 3 * 4 + symbols[1:] // 3
    return int((~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())


def _audits(grammar: Grammar):
    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.large_string())])

    def answer(whole, memo):
        names = [symbols for _, symbols in whole]
        new = list(dict.fromkeys(s for s in names if s not in memo))
        arrays = [np.frombuffer(s, np.uint8) for s in new]
        for s, a, encoded in zip(new, arrays, grammar.encode([symbol_text(a) for a in arrays])):
            memo[s] = (illegal_pairs(a.astype(np.int64)), *grammar.repair(encoded))
        rows = [(conv, *memo[s]) for conv, s in whole]
        if len(memo) > MEMO:
            memo.clear()
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    def run(batches):
        memo, whole, held, parts = {}, [], None, []
        for batch in batches:
            for conv, symbols in zip(batch.column("conv_id").to_pylist(), batch.column("symbols").to_pylist()):
                if parts and conv != held:
                    whole.append((held, b"".join(parts)))
                    parts = []
                held = conv
                parts.append(symbols)
            if whole:
                yield answer(whole, memo)
                whole = []
        if parts:
            yield answer([(held, b"".join(parts))], memo)

    return run


def audits(found: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of every conversation of ``pieces``."""
    sequences = written(found.groupBy("symbols").agg(F.count("*").alias("weight")), "sequences")
    grammar = learn_grammar(sequences)
    return written(found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
                   .select("conv_id", "symbols").mapInArrow(_audits(grammar), "conv_id long, illegal long, cost long, audit string"),
                   "audits")


def _edited(batches):
    """(conv_id, edit, turn, role, text) of every edit, streamed; rows come behind their audit."""
    audit, at, state, conv = "", 0, START, None

    def insert():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next_role(state)
            state = after(state, role[0])
            at += 1
            yield conv, "I", None, role, ""

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "audit", "turn", "role", "text")]
        for who, new, turn, role, text in zip(*columns):
            if new is not None:
                yield from insert()
                audit, at, state, conv = new, 0, START, who
                yield conv, "", None, None, None
                continue
            yield from insert()
            letter = audit[at]
            at += 1
            if letter == "R":
                role = next_role(state)
            if letter != "D":
                state = after(state, role[:1])
            yield conv, letter, turn, role, text
    yield from insert()


def _digests(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    ready, held, digest, first = [], None, None, True

    def flush(rows):
        return pa.RecordBatch.from_pydict({"conv_id": [r[0] for r in rows], "repaired_sha256": [r[1] for r in rows]},
                                          schema=schema)

    for conv, letter, _, role, text in _edited(batches):
        if not letter:
            if digest is not None:
                ready.append((held, digest.hexdigest()))
            held, digest, first = conv, hashlib.sha256(), True
            if len(ready) >= 4096:
                yield flush(ready)
                ready = []
        elif letter != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
    if digest is not None:
        ready.append((held, digest.hexdigest()))
    if ready:
        yield flush(ready)


def _repaired(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                        ("text", pa.large_string()), ("edit", pa.string())])
    ready, position, size = [], 0, 0
    for conv, letter, turn, role, text in _edited(batches):
        if not letter:
            position = 0
        elif letter != "D":
            ready.append((conv, position, turn, role, text, letter))
            position, size = position + 1, size + len(text)
        if len(ready) >= 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in ready] for i, n in enumerate(schema.names)}, schema=schema)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in ready] for i, n in enumerate(schema.names)}, schema=schema)


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order."""
    heads = found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), F.lit("").alias("digest"))
    body = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", F.lit(1).alias("kind"),
                       F.md5("text").alias("digest"))
    return heads.unionByName(body).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest") \
        .select("conv_id", "audit", "turn", "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, text, edit: the repaired conversations of ``turns`` rows
    (edit is K, R or I; turn is null where a row was inserted)."""
    found = audits(pieces(marked(rows)))
    return _streamed(rows, found).mapInArrow(
        _repaired, "conv_id long, position long, turn long, role string, text string, edit string")


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``: faults, cost, audit and hash of the repaired ``rows``."""
    flags = marked(rows)
    found = audits(pieces(flags))
    counts = flags.groupBy("conv_id").agg(
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    digests = _streamed(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for name, side in (("c", counts), ("f", found), ("d", digests)):
        side = side.withColumnRenamed("conv_id", f"__{name}")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damage(conversations), conversations)


SQL = r"""
WITH RECURSIVE
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- crc32, bit by bit: a character is xor-ed in, then eight shifts (-1)
coded AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1),
        lambda i: [ascii(substr(name, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END),
    4294967295::BIGINT) % 20 AS kind FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) AS copies(c) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM placed),
judged AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         n > 1 AND prior || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
-- states: 0 start, 1 after s, 2 after u, 3 after a; useful runs of inserts from a to b
inserted(a, b, n, letters, lines) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 1, 'I', chr(10) || 'user:'), (0, 3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 1, 'I', chr(10) || 'user:'), (1, 3, 2, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 1, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 1, 'I', chr(10) || 'user:')),
step(b, c, initial, role) AS (VALUES (0, 1, 's', ''), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'),
                                     (2, 3, 'a', 'assistant')),
edit AS (
  SELECT conv_id, j.n, i.a, i.b AS c, 2 * i.n + 3 AS cost, i.letters || 'D' AS letters, i.lines
  FROM judged j, inserted i
  UNION ALL
  SELECT conv_id, j.n, i.a, s.c, 2 * i.n + (fault = 'truncated')::INT, i.letters || 'K', i.lines || chr(10) || j.role || ':' || text
  FROM judged j, inserted i JOIN step s ON s.b = i.b WHERE fault IN ('', 'truncated') AND s.initial = j.initial
  UNION ALL
  SELECT conv_id, j.n, i.a, s.c, 2 * i.n + 2 + (fault = 'truncated')::INT, i.letters || 'R', i.lines || chr(10) || s.role || ':' || text
  FROM judged j, inserted i JOIN step s ON s.b = i.b WHERE fault IN ('', 'truncated') AND s.role <> ''),
path(conv_id, n, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'lines': ''} FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL
  SELECT p.conv_id, p.n + 1, e.c,
         min({'cost': p.best.cost + e.cost, 'audit': p.best.audit || e.letters, 'lines': p.best.lines || e.lines})
  FROM path p JOIN edit e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n + 1 AND e.a = p.state
  GROUP BY p.conv_id, p.n + 1, e.c),
total AS (
  SELECT conv_id, max(n) AS n, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate,
         sum((fault = 'truncated')::INT) AS truncated, sum(illegal::INT) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM judged GROUP BY conv_id),
done AS (
  SELECT p.conv_id, min({'cost': best.cost + 2 * i.n, 'audit': best.audit || i.letters, 'lines': best.lines || i.lines}) AS best
  FROM path p JOIN total t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p.n
  JOIN inserted i ON i.a = p.state AND (i.b = 3 OR i.b = 0) GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN total t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
