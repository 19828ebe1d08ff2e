"""Conversation structure repair: grammar-compressed dynamic programming.

A conversation is a sequence of symbols, each the initial of a role with the first fault
of its row. States are the last role put out: none, system, user, assistant. A symbol is
a 4 x 4 matrix over (cost, audit) with the sum of costs and the joined audits as product
and the least as sum. Re-Pair gives the pairs of symbols that recur most over all
conversations a symbol of their own; the matrix of such a rule is the product of its two
parts, made once, bottom-up, for all conversations, and its audits are ropes: pairs of
the parts' audits, written out only to settle ties. A conversation then costs one step
for each symbol that is left of it.

Ties are settled soundly part by part: of two audits with one cost, one start and one end
none begins with the other, as what is more in it would be inserted rows at 5 each.

Large conversations: rows are ordered by ranges over (conversation, turn, role, text), so
one conversation may span many tasks; these cut it into segments of at most ``SEGMENT``
rows, and the grammar is learnt from the segments. A row repeated with its turn is one
row with a count. The last step reads the segments and then the rows of a conversation
as a sorted stream, because one SHA-256 over its whole text has to be worked out in
order; it holds four audits, whose common beginning is set aside after each segment.

Defined results: a null conv_id is a conversation of its own; null roles and texts are
one space; rows of one turn are ordered by role, then by the SHA-256 of role and text;
empty and very long texts are taken whole; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgauge.session import settle

SEGMENT = 4_096
#: Rules of the grammar and rounds to find them, at most; fewer only cost time.
RULES, ROUNDS = 512, 16
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_FAR = 1 << 60
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_INITIALS = "sua"
#: Letters of the symbols: four faults (none, blank, duplicate, truncated) for each initial.
_FIRST = ord("A")
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
_KEYS = ["_none", "_id"]
_ORDER = ["turn", "role", "_content"]
_WHITE = " \t\n\x0b\f\r"

Rope = str | tuple
Entry = tuple[int, Rope]
Matrix = list[list[Entry]]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with a planted fault each; 0 copies of a dropped one."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    conv, turn, role, text = named
    draw = F.crc32(F.concat_ws(":", conv, turn)) % 20
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(draw == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(draw < 2, F.lit("")).when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a key without nulls and 128 bits that stand for role and text."""
    content = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).alias("_id"),
        "turn", "role", "text", "copies", F.unhex(F.substring(content, 1, 32)).alias("_content"),
    )


def _symbol(initial: Column, fault: Column) -> Column:
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (kind * 4 + fault).cast("int")


def fault_runs(keyed: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: the symbol of the first and that of the others, and their number."""
    end = F.substring(F.rtrim("text", F.lit(_WHITE)), -1, 1)
    runs = keyed.filter("copies > 0").select(
        *_KEYS, *_ORDER, "copies", (end == "").alias("_blank"), (~end.isin(".", "!", "?")).alias("_cut"),
    )
    runs = runs.groupBy(*_KEYS, *_ORDER, "_blank", "_cut").agg(F.sum("copies").alias("n"))
    # Contents that come in several turns; a missing turn is the earliest.
    place = F.struct(F.col("turn").isNotNull(), "turn")
    several = runs.groupBy(*_KEYS, "_content").agg(F.min(place).alias("_first"), F.count("*").alias("_turns"))
    several = several.filter("_turns > 1").select(*_KEYS, "_content", "_first")
    marked = runs.join(several, [*_KEYS, "_content"], "left")
    again = F.coalesce(place > F.col("_first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    first = F.when(F.col("_blank"), _BLANK).when(again, _DUPLICATE).when(F.col("_cut"), _CUT).otherwise(0)
    return marked.select(
        *_KEYS, *_ORDER, "n", _symbol(initial, first).alias("first"),
        _symbol(initial, F.when(F.col("_blank"), _BLANK).otherwise(_DUPLICATE)).alias("rest"),
    )


def segments(runs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Symbols of at most ``size`` neighbouring rows, with the order of their first row."""
    schema = "_none boolean, _id long, turn long, role string, _content binary, piece long, symbols string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none, ids, first, rest, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_none", "_id", "first", "rest", "n"))
            if not len(n):
                continue
            new = np.r_[True, (none[1:] != none[:-1]) | (ids[1:] != ids[:-1])]
            at, piece, found, start = [], [], [], 0
            ends = np.cumsum(n)
            while start < len(n):
                # As many rows of one conversation as fit; a long run of equal rows goes alone.
                done = ends[start] - n[start]
                stop = int(np.searchsorted(ends, done + size, "right"))
                stop = max(stop, start + 1)
                fresh = np.flatnonzero(new[start + 1 : stop])
                stop = start + 1 + int(fresh[0]) if len(fresh) else stop
                if n[start] > size:
                    for k in range(0, int(n[start]), size):
                        length = min(size, int(n[start]) - k)
                        row = np.full(length, rest[start])
                        row[0] = first[start] if k == 0 else rest[start]
                        at.append(start), piece.append(k), found.append(row)
                    stop = start + 1
                else:
                    counts = n[start:stop].astype(np.int64)
                    row = np.repeat(rest[start:stop], counts)
                    row[np.cumsum(counts) - counts] = first[start:stop]
                    at.append(start), piece.append(0), found.append(row)
                start = stop
            texts = [(row + _FIRST).astype(np.uint8).tobytes().decode("ascii") for row in found]
            order = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at)) for c in (*_KEYS, *_ORDER)]
            yield pa.RecordBatch.from_arrays([*order, pa.array(piece, pa.int64()), pa.array(texts)], [*_KEYS, *_ORDER, "piece", "symbols"])

    ordered = runs.repartitionByRange(*_KEYS, *_ORDER).sortWithinPartitions(*_KEYS, *_ORDER)
    return ordered.mapInArrow(run, schema)


def written(rope: Rope) -> str:
    """The text of a rope."""
    if isinstance(rope, str):
        return rope
    out, stack = [], [rope]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack += (part[1], part[0])
    return "".join(out)


def _least(found: list[Entry]) -> Entry:
    """The cheapest entry, of equally cheap ones that with the least audit."""
    cost = min((c for c, _ in found), default=_FAR)
    if cost >= _FAR:
        return _FAR, ""
    ropes = [rope for c, rope in found if c == cost]
    return cost, ropes[0] if len(ropes) == 1 else min(map(written, ropes))


def _joined(a: Rope, b: Rope) -> Rope:
    return b if a == "" else a if b == "" else (a, b)


def product(a: Matrix, b: Matrix) -> Matrix:
    return [
        [
            _least([(a[i][k][0] + b[k][j][0], _joined(a[i][k][1], b[k][j][1])) for k in _STATES if a[i][k][0] + b[k][j][0] < _FAR])
            for j in _STATES
        ]
        for i in _STATES
    ]


def _matrix(moves: list[tuple[int, int, int, str]]) -> Matrix:
    """Least entries of (from, to, cost, audit)."""
    return [[_least([(c, audit) for a, b, c, audit in moves if (a, b) == (i, j)]) for j in _STATES] for i in _STATES]


_TO_USER = [(_NONE, _USER), (_SYSTEM, _USER), (_ASSISTANT, _USER)]
_TO_ASSISTANT = [(_USER, _ASSISTANT)]
_INSERTS = _matrix(
    [(s, s, 0, "") for s in _STATES]
    + [(a, b, INSERT, "I") for a, b in _TO_USER + _TO_ASSISTANT]
    + [(s, _ASSISTANT, 2 * INSERT, "II") for s in (_NONE, _SYSTEM)]
)


def symbol_matrix(letter: str) -> Matrix:
    """Inserts, if any, and then one edit of a row with this symbol."""
    kind, fault = divmod(ord(letter) - _FIRST, 4)
    moves = [(s, s, DELETE, "D") for s in _STATES]
    if fault in (0, _CUT):
        more = TRUNCATED if fault else 0
        moves += [(a, b, REROLE + more, "R") for a, b in _TO_USER + _TO_ASSISTANT]
        moves += [(a, b, more, "K") for a, b in [[(_NONE, _SYSTEM)], _TO_USER, _TO_ASSISTANT, []][kind]]
    return product(_INSERTS, _matrix(moves))


class Grammar:
    """Re-Pair rules, in the order they were found, and the matrix of every symbol."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrices = {chr(_FIRST + s): symbol_matrix(chr(_FIRST + s)) for s in range(16)}
        for pair, symbol in rules:
            self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            if len(symbols) < 2:
                break
            symbols = symbols.replace(pair, symbol)
        return symbols


def learn_grammar(found: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """The pairs that recur most over all ``found`` (symbols, n), several apart ones a round."""
    grammar, spark = Grammar([]), found.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(grammar)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = shared.value.compress(text)
                    for a, b in set(zip(text, text[1:])):
                        counts[a + b] += n * text.count(a + b)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

        pairs = found.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        taken: set[str] = set()
        learnt = list(grammar.rules)
        for pair, _ in pairs.filter("n > 1").orderBy(F.desc("n"), "pair").limit(rules).collect():
            if len(learnt) < rules and not taken & set(pair):
                taken |= set(pair)
                learnt.append((pair, chr(0x100 + len(learnt))))
        if len(learnt) == len(grammar.rules):
            break
        grammar = Grammar(learnt)
    return grammar


class Repair:
    """Cheapest edits of one conversation, fed segment by segment."""

    def __init__(self, grammar: Grammar, known: dict[str, str]):
        self.grammar, self.known = grammar, known
        self.vector: list[Entry] = [(0, "") if s == _NONE else (_FAR, "") for s in _STATES]
        self.settled: list[str] = []
        self.faults = [0, 0, 0, 0]

    def feed(self, symbols: str) -> None:
        for letter, n in Counter(symbols).items():
            self.faults[(ord(letter) - _FIRST) % 4] += n
        short = self.known.get(symbols)
        if short is None:
            if len(self.known) > 50_000:
                self.known.clear()
            short = self.known[symbols] = self.grammar.compress(symbols)
        for symbol in short:
            self._step(self.grammar.matrices[symbol])
        self._set_aside()

    def _step(self, matrix: Matrix) -> None:
        self.vector = [
            _least([(c + matrix[i][j][0], _joined(rope, matrix[i][j][1])) for i, (c, rope) in enumerate(self.vector) if c + matrix[i][j][0] < _FAR])
            for j in _STATES
        ]

    def _set_aside(self) -> None:
        """Write out what all four audits begin with."""
        live = [i for i in _STATES if self.vector[i][0] < _FAR]
        audits = [written(self.vector[i][1]) for i in live]
        low, high = min(audits), max(audits)
        same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        self.settled.append(low[:same])
        for i, audit in zip(live, audits, strict=True):
            self.vector[i] = self.vector[i][0], audit[same:]

    def result(self) -> tuple[int, str]:
        nothing = self.vector[_NONE]
        self._step(_INSERTS)
        cost, rope = _least([e for e in (nothing, self.vector[_ASSISTANT]) if e[0] < _FAR])
        return cost, "".join(self.settled) + written(rope)


class Rebuilt:
    """The repaired conversation as a stream into one hash, with facts of the rows passed."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _NONE
        self.digest, self.begun = hashlib.sha256(), False
        self.turns, self.least, self.most = 0, None, None
        self.illegal, self.last = 0, None

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode("utf-8", "replace"))
        self.begun = True
        self.state = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[role[0]]

    def _next_role(self) -> str:
        return "assistant" if self.state == _USER else "user"

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._next_role(), "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        for _ in range(copies):
            if self.last is not None:
                self.illegal += self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._put(role if edit == "K" else self._next_role(), text)

    def facts(self) -> tuple[int, int, str]:
        """Gaps, illegal neighbours and the hash."""
        self._inserts()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.illegal, self.digest.hexdigest()


_RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits and the hash of the repaired text.

    ``rows`` is (conv_id, turn, role, text, copies) as ``damage`` gives it; a row with 0
    copies only names its conversation.
    """
    keyed = _keyed(rows)
    cut = settle(segments(fault_runs(keyed), segment))
    grammar = learn_grammar(settle(cut.groupBy("symbols").agg(F.count("*").alias("n"))))
    shared = rows.sparkSession.sparkContext.broadcast(grammar)
    empty = F.lit(None)
    stream = cut.select(*_KEYS, F.lit(0).alias("kind"), *_ORDER, "piece", "symbols", empty.cast("string").alias("text"), F.lit(0).alias("copies"))
    stream = stream.unionByName(
        keyed.select(*_KEYS, F.lit(1).alias("kind"), *_ORDER, F.lit(0).cast("long").alias("piece"), empty.cast("string").alias("symbols"), "text", "copies")
    )
    stream = stream.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind", *_ORDER, "piece")
    stream = stream.select(*_KEYS, "kind", "turn", "role", "symbols", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known, done = shared.value, {}, []
        key = edits = rebuilt = None
        price = 0

        def close() -> None:
            nonlocal rebuilt, price
            if rebuilt is None:
                price, audit = edits.result()
                rebuilt = Rebuilt(audit)
            gaps, illegal, digest = rebuilt.facts()
            _, blank, duplicate, truncated = edits.faults
            done.append((None if key[0] else key[1], gaps, blank, duplicate, truncated, illegal, price, rebuilt.audit, digest))

        def taken() -> pa.RecordBatch:
            names = [part.split()[0] for part in _RESULT.split(", ")]
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            for none, own, kind, turn, role, symbols, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (none, own):
                    if key is not None:
                        close()
                    key, edits, rebuilt = (none, own), Repair(grammar, known), None
                if kind == 0:
                    edits.feed(symbols)
                    continue
                if rebuilt is None:
                    price, audit = edits.result()
                    rebuilt = Rebuilt(audit)
                if copies:
                    rebuilt.row(turn, role, text, copies)
            yield taken()
        if key is not None:
            close()
            yield taken()

    return stream.mapInArrow(run, _RESULT)
