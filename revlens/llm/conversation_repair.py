"""Repair of conversation structure: generalised LR parsing over the role grammar with weighted edits.

A well-formed conversation is empty, or an optional system turn and one or more
pairs of a user and an assistant turn. The grammar's LR automaton is built from its
productions; a repair is a cheapest way of reading a conversation's role initials
with edits: keep a turn, rerole it, delete it, insert an empty turn. All ways
are followed at once on a graph-structured stack: stacks share their tails, equal
tops are one node, and a node keeps only its least (cost, audit), so that a turn costs
a bounded number of steps however many repairs there are.

A conversation may be long: the parser reads its turns as a stream, in order, and holds a
few stack tops with their audits (a byte a turn, shared between tops). Texts do not
enter the parser; they meet the audit in a second pass over sorted rows, which
holds one batch of rows and one audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require

#: Initials: s system, u user, a assistant. The last production's ``ua`` is one exchange.
GRAMMAR = [("C", ""), ("C", "sP"), ("C", "P"), ("P", "T"), ("P", "PT"), ("T", "ua")]
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


# ------------------------------------------------------------------ the LR automaton

class Automaton:
    """SLR automaton of a grammar of one-letter symbols: ``shift`` and ``goto`` by (state, symbol), ``reduce`` by
    (state, lookahead), end of input as ``$``. Conflicts stay: the stack follows every action."""

    def __init__(self, grammar: list[tuple[str, str]]):
        start = grammar[0][0]
        self.rules = [("^", start), *grammar]
        heads = {lhs for lhs, _ in grammar}
        follow = self._follow(heads)
        kernels = [self._closure({(0, 0)}, heads)]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], list[tuple[str, int]]] = {}
        for state, items in enumerate(kernels):
            moves: dict[str, set] = {}
            for rule, dot in items:
                lhs, rhs = self.rules[rule]
                if dot < len(rhs):
                    moves.setdefault(rhs[dot], set()).add((rule, dot + 1))
                elif rule:
                    for ahead in sorted(follow[lhs]):
                        self.reduce.setdefault((state, ahead), []).append((lhs, len(rhs)))
            for symbol, kernel in sorted(moves.items()):
                items = self._closure(kernel, heads)
                if items not in kernels:
                    kernels.append(items)
                self.goto[state, symbol] = kernels.index(items)
        self.accept = self.goto[0, start]
        #: States that hold one finished rule and nothing else: they are reduced at once, whatever follows.
        self.default = {state: (self.rules[rule][0], dot) for state, items in enumerate(kernels)
                        for rule, dot in items if len(items) == 1 and rule and dot == len(self.rules[rule][1])}

    def _closure(self, kernel: set, heads: set) -> frozenset:
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            rhs = self.rules[rule][1]
            if dot < len(rhs) and rhs[dot] in heads:
                new = {(r, 0) for r, (lhs, _) in enumerate(self.rules) if lhs == rhs[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def _follow(self, heads: set) -> dict[str, set]:
        empty, first = set(), {h: set() for h in heads}
        follow: dict[str, set] = {h: set() for h in heads} | {"^": {"$"}}
        changed = True
        while changed:
            before = (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
            for lhs, rhs in self.rules:
                if all(x in empty for x in rhs):
                    empty.add(lhs)
                for x in rhs:
                    if lhs in first:
                        first[lhs] |= first.get(x, {x})
                    if x not in empty:
                        break
                ahead = set(follow[lhs])
                for x in reversed(rhs):
                    if x in heads:
                        follow[x] |= ahead
                        ahead = ahead | first[x] if x in empty else set(first[x])
                    else:
                        ahead = {x}
            changed = before != (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))
        return follow


class Stacks:
    """Graph-structured stack: nodes (state, node below), each made once, so that stacks share their tails.

    ``after(top, symbol)`` are the tops when ``symbol`` has been shifted after all reductions that it allows;
    ``accepts(top)`` tells whether the input may end there.
    """

    def __init__(self, automaton: Automaton):
        self.lr = automaton
        self.nodes: dict[tuple[int, int | None], int] = {}
        self.state: list[int] = []
        self.below: list[int | None] = []
        self.start = self.node(0, None)
        self._after: dict[tuple[int, str], tuple[int, ...]] = {}

    def node(self, state: int, below: int | None) -> int:
        at = self.nodes.get((state, below))
        if at is None:
            at = self.nodes[state, below] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return at

    def reduced(self, top: int, ahead: str) -> list[int]:
        """The top and every top that reductions under this lookahead lead to."""
        tops, i = [top], 0
        while i < len(tops):
            for lhs, n in self.lr.reduce.get((self.state[tops[i]], ahead), ()):
                base = tops[i]
                for _ in range(n):
                    base = self.below[base]
                to = self.node(self.lr.goto[self.state[base], lhs], base)
                if to not in tops:
                    tops.append(to)
            i += 1
        return tops

    def after(self, top: int, symbol: str) -> tuple[int, ...]:
        found = self._after.get((top, symbol))
        if found is None:
            shifts = [(t, self.lr.goto.get((self.state[t], symbol))) for t in self.reduced(top, symbol)]
            found = self._after[top, symbol] = tuple(sorted({self.settled(self.node(s, t)) for t, s in shifts if s is not None}))
        return found

    def settled(self, top: int) -> int:
        """The top after the reductions that its states leave no choice about, so that equal futures are one top."""
        while self.state[top] in self.lr.default:
            lhs, n = self.lr.default[self.state[top]]
            for _ in range(n):
                top = self.below[top]
            top = self.node(self.lr.goto[self.state[top], lhs], top)
        return top

    def accepts(self, top: int) -> bool:
        return any(self.state[t] == self.lr.accept for t in self.reduced(top, "$"))


STACKS = Stacks(Automaton(GRAMMAR))


# ------------------------------------------------------------------ the weighted parse

class Audit:
    """A growing string that shares its beginning with others: finished chunks in a chain, then a short tail."""

    __slots__ = ("chain", "tail")
    CHUNK = 1024

    def __init__(self, chain=None, tail: str = ""):
        self.chain, self.tail = chain, tail

    def plus(self, letters: str) -> Audit:
        tail = self.tail + letters
        return Audit((self.chain, tail)) if len(tail) >= self.CHUNK else Audit(self.chain, tail)

    def __str__(self) -> str:
        parts, chain = [self.tail], self.chain
        while chain is not None:
            chain, part = chain
            parts.append(part)
        return "".join(reversed(parts))


class Repair:
    """The cheapest repairs of the turns read so far, by stack top.

    Two repairs of the same turns at the same cost differ before either ends (past the common
    part the longer one could only insert, which costs), so that their order never changes
    later: after each turn the audits kept are ranked, and the next comparison needs ranks and
    the letters since.
    """

    def __init__(self, costs: Costs = Costs(), stacks: Stacks = STACKS):
        self.costs, self.stacks = costs, stacks
        #: top -> (cost, rank, letters since the ranking, audit at the ranking)
        self.tops: dict[int, tuple] = {stacks.start: (0, 0, "", Audit())}
        self._insert()

    def _offer(self, tops: dict, top: int, value: tuple) -> bool:
        held = tops.get(top)
        if held is None or value[:3] < held[:3]:
            tops[top] = value
            return True
        return False

    def _insert(self) -> None:
        """Inserted turns: until no top gets a smaller (cost, audit)."""
        todo = list(self.tops)
        while todo:
            top = todo.pop()
            cost, rank, letters, audit = self.tops[top]
            value = (cost + self.costs.insert, rank, letters + INSERT, audit)
            for symbol in ROLES:
                todo += [to for to in self.stacks.after(top, symbol) if self._offer(self.tops, to, value)]

    def read(self, initial: str, fault: str | None) -> None:
        """One more turn, by its role's initial and its fault."""
        tops: dict[int, tuple] = {}
        stay = self.costs.truncated if fault == TRUNCATED else 0
        for top, (cost, rank, letters, audit) in self.tops.items():
            self._offer(tops, top, (cost + self.costs.delete, rank, letters + DELETE, audit))
            if fault in (BLANK, DUPLICATE):
                continue
            for to in self.stacks.after(top, initial):
                self._offer(tops, to, (cost + stay, rank, letters + KEEP, audit))
            for symbol in ROLES:
                for to in self.stacks.after(top, symbol):
                    self._offer(tops, to, (cost + self.costs.rerole + stay, rank, letters + REROLE, audit))
        order = {key: i for i, key in enumerate(sorted({v[1:3] for v in tops.values()}))}
        # Tops whose best repair is the same share one audit object.
        grown: dict[tuple, Audit] = {}
        for v in tops.values():
            if v[1:3] not in grown:
                grown[v[1:3]] = v[3].plus(v[2])
        self.tops = {top: (v[0], order[v[1:3]], "", grown[v[1:3]]) for top, v in tops.items()}
        self._insert()

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the best whole repair."""
        cost, _, letters, audit = min((v for top, v in self.tops.items() if self.stacks.accepts(top)), key=lambda v: v[:3])
        return cost, str(audit) + letters


def apply_audit(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role that it gives or None) of each letter; a kept or deleted turn has no new role.

    The roles follow from the grammar: after an optional kept system turn, user and assistant take turns.
    A kept letter's own initial is known to the caller, which sends it in.
    """
    turn = "u"
    for letter in audit:
        if letter == DELETE:
            yield letter, None
        elif letter == KEEP:
            initial = yield letter, None
            turn = "a" if initial == "u" else "u"
        else:
            yield letter, ROLES[turn]
            turn = "a" if turn == "u" else "u"


# ------------------------------------------------------------------ over Spark

def fault_of(text: Column, repeats: Column) -> Column:
    """The first fault of a turn: blank, duplicate (``repeats``), truncated; NULL for none."""
    last = F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1)
    return (F.when(last == "", F.lit(BLANK)).when(repeats, F.lit(DUPLICATE))
            .when(~last.isin(".", "!", "?"), F.lit(TRUNCATED)))


def _turns(rows: DataFrame, id_col: str) -> DataFrame:
    """(conv, turn, role, text, head, digest): NULL role or text read as one space. Rows are ordered by turn (NULL
    first), ties by role, then text (its first 64 code points, then its digest). The id is carried as text, so that
    neither it nor a NULL beside it changes on the way through Python."""
    require(rows, id_col, "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(F.col(id_col).cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                       text.alias("text"), F.substring(text, 1, 64).alias("head"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _order(*more: str) -> list:
    return ["conv", *more, F.col("turn").asc_nulls_first(), "role", "head", "digest"]


REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
REPORT_COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
LEGAL = {"su", "ua", "au"}


def diagnose(rows: DataFrame, id_col: str = "conv_id", costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: (``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit).

    ``audit`` has one letter for each edit of the cheapest repair, in order (of equally
    cheap ones the least in ASCII order). Rows with a NULL id are one conversation. Only role,
    turn and digests are shuffled, not texts.
    """
    id_type = dict(rows.dtypes)[id_col]
    turns = _turns(rows, id_col)
    # The last character that is not white space decides; it travels instead of the text.
    marks = turns.select("conv", "turn", "role", "head", "digest", fault_of(F.col("text"), F.lit(False)).alias("own"))
    seen = Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = (marks.repartition("conv").withColumn("repeat", F.row_number().over(seen) > 1)
              .withColumn("fault", F.when(F.col("own") == BLANK, F.col("own")).when(F.col("repeat"), F.lit(DUPLICATE)).otherwise(F.col("own")))
              .sortWithinPartitions(*_order(), "repeat")
              .select("conv", F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: _Conversation | None = None
        for batch in batches:
            out = []
            for conv, turn, initial, fault in zip(batch["conv"], batch["turn"], batch["initial"], batch["fault"]):
                if state is None or conv != state.conv:
                    if state is not None:
                        out.append(state.row())
                    state = _Conversation(conv, costs)
                state.read(None if turn is None else int(turn), initial, fault)
            if out:
                yield _report(out)
        if state is not None:
            yield _report([state.row()])

    def _report(out):
        return pd.DataFrame(out, columns=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    found = marked.mapInPandas(parse, f"conv string, {REPORT}")
    return found.select(F.col("conv").cast(id_type).alias(id_col), *REPORT_COLUMNS)


class _Conversation:
    """The running report of one conversation."""

    def __init__(self, conv, costs: Costs):
        self.conv, self.repair = conv, Repair(costs)
        self.low = self.high = self.before = None
        self.distinct, self.illegal = 0, 0
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}

    def read(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        if fault is not None:
            self.faults[fault] += 1
        self.repair.read(initial, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.faults.values(), self.illegal, *self.repair.result())


def repaired(rows: DataFrame, report: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The edit script with its texts: (``id_col``, step, edit, turn, role, text), one row per letter of the audits.

    Kept, reroled and deleted rows carry their text (deleted ones their old role), inserted
    ones an empty text and no turn; the repaired conversation is the rows whose edit is not ``D``, by
    ``step``. Rows are shuffled once; a conversation's audit arrives before its rows.
    """
    id_type = dict(rows.dtypes)[id_col]
    none = F.lit(None).cast("string")
    audits = report.select(F.col(id_col).cast("string").alias("conv"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"),
                           none.alias("head"), F.lit(None).cast("binary").alias("digest"), "audit", F.lit(0).alias("kind"))
    texts = _turns(rows, id_col).withColumns({"audit": none, "kind": F.lit(1)})
    both = (audits.union(texts).repartition("conv").sortWithinPartitions(*_order("kind"))
            .select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "audit", "kind"))

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv = script = None
        step, out = 0, []

        def until_turn():
            """Inserted turns up to the next letter that takes a row; the letter and its new role."""
            nonlocal step, ahead
            while ahead is not None and ahead[0] == INSERT:
                out.append((conv, step, INSERT, None, ahead[1], ""))
                step += 1
                ahead = next(script, None)
            return ahead

        ahead = None
        for batch in batches:
            for c, turn, role, text, audit, kind in zip(*(batch[n] for n in ("conv", "turn", "role", "text", "audit", "kind"))):
                if kind == 0:
                    until_turn()
                    conv, script, step = c, apply_audit(audit), 0
                    ahead = next(script, None)
                    continue
                letter, new = until_turn()
                out.append((conv, step, letter, turn, new or role, text))
                step += 1
                try:
                    ahead = script.send(role[:1]) if letter == KEEP else next(script, None)
                except StopIteration:
                    ahead = None
            if out:
                yield _script(out)
                out = []
        until_turn()
        if out:
            yield _script(out)

    def _script(out):
        return pd.DataFrame(out, columns=["conv", "step", "edit", "turn", "role", "text"], dtype=object).astype({"step": "int64"})

    found = both.mapInPandas(edit, "conv string, step long, edit string, turn string, role string, text string")
    return found.select(F.col("conv").cast(id_type).alias(id_col), "step", "edit", F.col("turn").cast("long").alias("turn"), "role", "text")


def script_digest(script: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(``id_col``, repaired_sha256): SHA-256 of the repaired ``role:text`` lines, newline-joined.

    Takes the rows as ``repaired`` leaves them: a conversation's in one task, in order. They pass one
    by one, as the digest demands; a conversation without rows is not in it.
    """
    id_type = dict(script.dtypes)[id_col]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sha, any_line = None, None, False
        for batch in batches:
            out = []
            for c, step, letter, role, text in zip(*(batch[n] for n in ("conv", "step", "edit", "role", "text"))):
                if sha is None or c != conv or step == 0:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, any_line = c, hashlib.sha256(), False
                if letter != DELETE:
                    sha.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                    any_line = True
            if out:
                yield pd.DataFrame(out, columns=["conv", "sha"])
        if sha is not None:
            yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "sha"])

    found = (script.select(F.col(id_col).cast("string").alias("conv"), "step", "edit", "role", "text")
             .mapInPandas(digest, "conv string, sha string"))
    return found.select(F.col("conv").cast(id_type).alias(id_col), F.col("sha").alias("repaired_sha256"))


# ------------------------------------------------------------------ damage, for trials

def damage(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows damaged by crc32 of ``id:turn`` modulo 20 (a NULL reads as one space): 0 drops the row, 1 empties its
    text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, "turn")])
    kind = F.crc32(key) % 20
    hurt = rows.select(
        F.col(id_col), F.col("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return hurt.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def repair_report(originals: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The report of ``diagnose`` with ``repaired_sha256`` for every id of ``originals``.

    An id without rows: zeros, an empty audit and the digest of the empty string.
    """
    report = materialize(diagnose(rows, id_col), "repair-report")
    digests = script_digest(repaired(rows, report, id_col), id_col).withColumnRenamed(id_col, "digest_of")
    ids = originals.select(F.col(id_col).alias("own")).distinct()
    found = report.withColumnRenamed(id_col, "report_of")
    out = (ids.join(found, F.col("own").eqNullSafe(F.col("report_of")), "left")
           .join(digests, F.col("own").eqNullSafe(F.col("digest_of")), "left"))
    zero, nothing = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    return out.select(F.col("own").alias(id_col), *[F.coalesce(c, zero).alias(c) for c in REPORT_COLUMNS if c != "audit"],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
