"""Repair of the order of roles in conversations by generalised LR parsing with weighted edits.

A grammar of roles is turned into its LR table. A conversation's rows are read from left to right by a
graph-structured stack: a node is an LR state on the node below it, and all ways of reading the rows so far
(kept, given another role, deleted, with rows put in between) share their nodes. Nodes with equal tops are merged
into the one of smallest (cost, audit). That loses nothing here: what can follow depends on the top state
alone (``Table`` checks it), and of two ways that have read the same rows at the same cost neither audit is
the beginning of the other, since an insertion costs.

Conversations are not gathered. Rows are dealt in ranges of (conversation, place) and read as sorted streams,
in chunks of bounded size. A conversation that ends inside its task is done there. A longer one leaves, for
every chunk, a map from each top state before it to the best way to each top state after it; these maps compose
in order, so that the parsing of a conversation of any length is shared by many tasks, and only its composition
and its hash, which has to see the repaired text in order, run in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.llm.common import stow

#: Roles by the initials that the grammar is written in, and the grammar: an optional s, then one or more u a.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
#: Roles that a row may be given or that may be put in, and the price of each edit.
FREE = "ua"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a chunk.
CHUNK_ROWS, CHUNK_TEXT = 1024, 1 << 21

SOLID, STOPPED = "[^\\x20\\x09-\\x0D]", "[.!?][\\x20\\x09-\\x0D]*\\z"


# ------------------------------------------------------------------ the grammar's table


class Table:
    """LR(0) states of a grammar with the tokens that may follow each symbol (SLR)."""

    def __init__(self, grammar=GRAMMAR, start: str = "C"):
        rules = (("^", start), *grammar)
        heads = {h for h, _ in rules}

        def closed(items):
            out, todo = set(items), list(items)
            while todo:
                r, at = todo.pop()
                want = rules[r][1][at : at + 1]
                for i, (h, _) in enumerate(rules):
                    if h == want and (i, 0) not in out:
                        out.add((i, 0))
                        todo.append((i, 0))
            return frozenset(out)

        states, self.go = [closed({(0, 0)})], {}
        for i, state in enumerate(states):
            for symbol in sorted({rules[r][1][at] for r, at in state if at < len(rules[r][1])}):
                nxt = closed({(r, at + 1) for r, at in state if rules[r][1][at : at + 1] == symbol})
                if nxt not in states:
                    states.append(nxt)
                self.go[i, symbol] = states.index(nxt)
        empty = {h for h, body in rules if not body}
        first = {s: set() if s in heads else {s} for s in heads.union(*(body for _, body in rules))}
        follow = {h: {"$"} if h in "^" else set() for h in heads}
        for _ in range(len(rules) ** 2):
            for h, body in rules:
                tail = set(follow[h])
                for s in reversed(body):
                    if s in heads:
                        follow[s] |= tail
                    tail = first[s] | (tail if s in empty else set())
                for s in body:
                    first[h] |= first[s]
                    if s not in empty:
                        break
        self.tokens = sorted(s for s in first if s not in heads)
        self.reduce: dict[tuple[int, str], tuple[str, int]] = {}
        for i, state in enumerate(states):
            for r, at in state:
                if r and at == len(rules[r][1]):
                    for t in follow[rules[r][0]]:
                        if (i, t) in self.reduce or (i, t) in self.go:
                            raise ValueError("the grammar is not SLR(1)")
                        self.reduce[i, t] = (rules[r][0], at)
        self.accept = self.go[0, start]
        self._settle()

    def read(self, node, token: str):
        """The stack (state, node below) after ``token``, or None; ``$`` gives the stack if the text may end here."""
        while (node[0], token) in self.reduce:
            head, n = self.reduce[node[0], token]
            for _ in range(n):
                node = node[1]
            node = (self.go[node[0], head], node)
        if token == "$":
            return node if node[0] == self.accept else None
        to = self.go.get((node[0], token))
        return None if to is None else self._ripe((to, node))

    def _ripe(self, node):
        """Reductions that every token, or the end, would make are made at once, so that equal readings have equal tops."""
        while True:
            acts = {self.reduce.get((node[0], t)) for t in (*self.tokens, "$")} - {None}
            shifts = any((node[0], t) in self.go for t in self.tokens)
            if len(acts) != 1 or shifts:
                return node
            head, n = acts.pop()
            if node[0] == 0 or not n:
                return node
            for _ in range(n):
                node = node[1]
            node = (self.go[node[0], head], node)

    def _settle(self) -> None:
        """A stack for every top state; stacks with equal tops must have equal futures, or merging them would be wrong."""
        nodes, arcs = [(0, None)], {}
        for node in nodes:
            arcs[node] = {t: self.read(node, t) for t in self.tokens}
            nodes += [to for to in dict.fromkeys(arcs[node].values()) if to and to not in nodes]
            if len(nodes) > 1000:
                raise ValueError("the grammar's stacks have no bound")
        future = {n: int(self.read(n, "$") is not None) for n in nodes}
        for _ in nodes:
            seen: dict[tuple, int] = {}
            future = {n: seen.setdefault((future[n], *(future.get(arcs[n][t]) for t in self.tokens)), len(seen)) for n in nodes}
        self.stack: dict[int, tuple] = {}
        for node in nodes:
            if future[self.stack.setdefault(node[0], node)] != future[node]:
                raise ValueError("equal stack tops with different futures")
        self.shift = {(q, t): to[0] for q, node in self.stack.items() for t, to in arcs[node].items() if to}
        self.ends = {q for q, node in self.stack.items() if self.read(node, "$")}


TABLE = Table()


# ------------------------------------------------------------------ the graph-structured stack


@dataclass(frozen=True)
class Row:
    """A row of a conversation, or ``copies`` equal ones in a row of which all but the first are duplicates."""

    initial: str
    must_go: bool
    truncated: bool
    copies: int = 1


Ways = dict[int, tuple[int, str, tuple]]


def _offer(heads: Ways, cost: int, audit: str, node: tuple) -> bool:
    """Add a way; of equal tops the one of smallest (cost, audit) stays."""
    old = heads.get(node[0])
    if old is None or (cost, audit) < old[:2]:
        heads[node[0]] = (cost, audit, node)
        return True
    return False


def _insertions(table: Table, heads: Ways) -> Ways:
    """``heads`` and all that insertions lead to, cheapest first; a price above 0 ends the search."""
    heads = dict(heads)
    todo = sorted(heads, key=lambda q: heads[q][:2])
    while todo:
        cost, audit, node = heads[todo.pop(0)]
        for role in FREE:
            to = table.read(node, role)
            if to and _offer(heads, cost + INSERT, audit + "I", to):
                todo = sorted({*todo, to[0]}, key=lambda q: heads[q][:2])
    return heads


def repair(rows: list[Row], top: int = 0, table: Table = TABLE) -> Ways:
    """The best way from a stack with this top state to every top state that can follow ``rows``.

    Edits stand in the audit by their initials: Keep, Rerole, Delete, Insert.
    """
    heads: Ways = {top: (0, "", table.stack[top])}
    for row in rows:
        heads, before = {}, _insertions(table, heads)
        extra = TRUNCATED if row.truncated else 0
        for cost, audit, node in before.values():
            more = (row.copies - 1) * DELETE
            tail = "D" * (row.copies - 1)
            _offer(heads, cost + DELETE + more, audit + "D" + tail, node)
            if row.must_go:
                continue
            kept = table.read(node, row.initial) if row.initial in table.tokens else None
            if kept:
                _offer(heads, cost + extra + more, audit + "K" + tail, kept)
            for role in FREE:
                to = table.read(node, role) if role != row.initial else None
                if to:
                    _offer(heads, cost + REROLE + extra + more, audit + "R" + tail, to)
    return _insertions(table, heads)


def _free_role(table: Table, top: int) -> str:
    return next(t for t in FREE if (top, t) in table.shift)


def apply_audit(audit: str, texts: list[tuple[str, str]], top: int = 0, table: Table = TABLE) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of rows with one entry a copy, and at last the top state is reached that ``repair`` gave."""
    at = iter(texts)
    for edit in audit:
        if edit == "D":
            next(at)
            continue
        if edit == "I":
            initial = _free_role(table, top)
            yield ROLES[initial], ""
        else:
            role, text = next(at)
            initial = role[:1] if edit == "K" else _free_role(table, top)
            yield (role if edit == "K" else ROLES[initial]), text
        top = table.shift[top, initial]


# ------------------------------------------------------------------ damage


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after every row's own damage, which ``conv_id`` and ``turn`` decide; nulls become one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(say("text"), "[.!?]", "")).otherwise(say("text"))
    rows = conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(say("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times")
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


# ------------------------------------------------------------------ streams of rows


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies`` and ``fault``: blank, duplicate (of an earlier row), truncated or none."""
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("late"), F.coalesce("turn", F.lit(0)).alias("turn"))
    own = stow(own.withColumn("said", _digest(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")))).withColumn("place", place), "rows")
    again = own.groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = own.alias("r").join(again.alias("g"), F.col("r.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("r.said") == F.col("g.said")), "left")
    fault = (
        F.when(~F.col("text").rlike(SOLID), "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.col("text").rlike(STOPPED), "truncated")
    )
    return met.select("r.conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_FACTS = "conv_id long, part int, chunk int, open boolean, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, first string, last string"
_SCHEMA = _FACTS + ", cost long, audit string, sha string, maps array<struct<a:int,b:int,cost:long,audit:string>>, said array<struct<role:string,text:string,copies:long>>"
_NAMES = [f.split()[0] for f in _FACTS.split(", ")] + ["cost", "audit", "sha", "maps", "said"]
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    """Rows of one conversation, next to each other in a task's stream."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.rows, self.said, self.size = conv, number, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.lo = self.hi = self.first = self.last = None

    def add(self, turn, role: str, text: str, copies: int, fault: str | None) -> None:
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.illegal += (copies - 1) * (initial * 2 not in _LEGAL)
        self.last = initial
        if fault == "blank":
            self.blank += copies
        else:
            self.duplicate += copies - (fault != "duplicate")
            self.truncated += fault == "truncated"
        if turn is not None:
            self.turns += turn != self.hi
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        self.rows.append(Row(initial, fault in ("blank", "duplicate"), fault == "truncated", copies))
        self.said.append((role, text, copies))
        self.size += len(text) + len(role)

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.size >= CHUNK_TEXT

    def facts(self, part: int, open_: bool) -> tuple:
        return (self.conv, part, self.number, open_, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.lo, self.hi, self.first, self.last)

    def done(self, part: int) -> tuple:
        ways = repair(self.rows)
        cost, audit = min(ways[q][:2] for q in TABLE.ends if q in ways)
        each = [(r, t) for r, t, n in self.said for _ in range(n)]
        text = "\n".join(f"{r}:{t}" for r, t in apply_audit(audit, each))
        return (*self.facts(part, False), cost, audit, hashlib.sha256(text.encode()).hexdigest(), None, None)

    def opened(self, part: int) -> tuple:
        maps = [{"a": a, "b": b, "cost": c, "audit": s} for a in TABLE.stack for b, (c, s, _) in repair(self.rows, a).items()]
        return (*self.facts(part, True), None, None, None, maps, [{"role": r, "text": t, "copies": n} for r, t, n in self.said])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=schema)


def _arrow_schema() -> pa.Schema:
    way = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    said = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())])
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    facts = [(f.split()[0], kinds[f.split()[1]]) for f in _FACTS.split(", ")]
    return pa.schema([*facts, ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("maps", pa.list_(way)), ("said", pa.list_(said))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a sorted range of rows: done where a conversation lies inside the range, open at its ends or beyond a chunk."""
    schema, out, held = _arrow_schema(), [], 0
    now: _Chunk | None = None
    inside = False  # whether the conversation began after another one in this range
    part = 0
    for batch in batches:
        for conv, turn, role, text, copies, fault, part in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.done(part) if inside and now.number == 0 else now.opened(part))
                    inside = True
                now = _Chunk(conv, 0)
            elif now.full():
                out.append(now.opened(part))
                held += now.size
                now = _Chunk(conv, now.number + 1)
            now.add(turn, role, text, copies, fault)
            if len(out) >= 4096 or held >= CHUNK_TEXT:
                yield _table(out, schema)
                out, held = [], 0
    if now is not None:
        out.append(now.opened(part))
    if out:
        yield _table(out, schema)


_RESULT = "conv_id long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, cost long, audit string, sha string"


class _Joined:
    """Composition of the chunks of one conversation, in order: a way, with the hash of its repaired text, per top state."""

    def __init__(self, conv):
        self.conv, self.last, self.lo, self.hi = conv, None, None, None
        self.counts = [0, 0, 0, 0, 0]
        self.ways = {0: (0, (), hashlib.sha256(), False)}

    def add(self, c: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal", "turns")):
            self.counts[i] += c[name]
        if self.last is not None:
            self.counts[3] += self.last + c["first"] not in _LEGAL
        self.last = c["last"]
        if c["lo"] is not None:
            self.counts[4] -= self.hi == c["lo"]
            self.lo = c["lo"] if self.lo is None else self.lo
            self.hi = c["hi"]
        best: dict[int, tuple] = {}
        for m in c["maps"]:
            if m["a"] in self.ways:
                cost, audits, _, _ = self.ways[m["a"]]
                way = (cost + m["cost"], (*audits, m["audit"]), m["a"])
                old = best.get(m["b"])
                if old is None or (way[0], "".join(way[1])) < (old[0], "".join(old[1])):
                    best[m["b"]] = way
        each = [(s["role"], s["text"]) for s in c["said"] for _ in range(s["copies"])]
        new = {}
        for b, (cost, audits, a) in best.items():
            _, _, sha, begun = self.ways[a]
            sha = sha.copy()
            for role, text in apply_audit(audits[-1], each, a):
                sha.update(f"{'\n' if begun else ''}{role}:{text}".encode())
                begun = True
            new[b] = (cost, ("".join(audits),), sha, begun)
        self.ways = new

    def row(self) -> dict:
        cost, audits, sha = min((self.ways[q][:3] for q in TABLE.ends if q in self.ways), key=lambda w: (w[0], "".join(w[1])))
        return dict(zip([f.split()[0] for f in _RESULT.split(", ")], (self.conv, *self.counts, self.lo, self.hi, cost, "".join(audits), sha.hexdigest())))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _RESULT.split(", ")])
    now: _Joined | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            if now is None or chunk["conv_id"] != now.conv:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=schema)
                now = _Joined(chunk["conv_id"])
            now.add(chunk)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema=schema)


def repair_roles(rows: DataFrame) -> DataFrame:
    """Repaired conversations of ``conv_id, turn, role, text``: counts, ``cost``, ``audit``, ``sha`` and bounds of the turns.

    Rows count by turn, nulls first; rows of one turn by role, then text. No role and no text may be null.
    """
    order = ["conv_id", "turn", "role", "text"]
    flawed = faults(rows)
    ranged = flawed.repartitionByRange(*order).sortWithinPartitions(*order)
    read = ranged.select(*order, "copies", "fault", F.spark_partition_id().alias("part"))
    chunks = stow(read.mapInArrow(_read, _SCHEMA), "chunks")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    done = chunks.where("not open").select(*names)
    opened = chunks.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return done.unionByName(opened.mapInArrow(_compose, _RESULT))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for every ``conv_id``: what the damage of its rows is and how the order of roles is repaired.

    ``gaps`` counts turns that lie between the first and the last and have no row; ``blank``, ``duplicate``
    and ``truncated`` count rows by their first fault, ``illegal`` adjacent roles that do not follow each
    other; ``cost``, ``audit`` and ``repaired_sha256`` are those of the cheapest repair. A null id is a
    conversation like others; null roles and texts are one space, null turns come first. Rows of one turn
    count in the order of role and text. A conversation without rows after the damage has zeros, an empty
    audit and the hash of the empty text. Roles other than the grammar's, empty ones too, can only be given
    another role or deleted. Repeated rows are duplicates. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    table = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    fixed = repair_roles(damage(table))
    ids = table.select("conv_id").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    met = ids.alias("i").join(fixed.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c)
    gaps = F.when(F.col("f.lo").isNull(), 0).otherwise(F.col("f.hi") - F.col("f.lo") + 1 - F.col("f.turns"))
    return met.select(
        "i.conv_id",
        gaps.cast("long").alias("gaps"),
        zero("blank"),
        zero("duplicate"),
        zero("truncated"),
        zero("illegal"),
        zero("cost"),
        F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("f.sha", F.lit(nothing)).alias("repaired_sha256"),
    )
