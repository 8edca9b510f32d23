"""Conversation structure repair: generalised LR parsing with weighted edits.

A conversation's role initials must be of the language of the grammar below. Its rows are
read from left to right by an LR(0) automaton of that grammar, all possible edits at
once: keep a row, give it another role, delete it, or insert a row without text. Stacks of
the automaton share what lies below as nodes of one graph; equal stack tops merge into the
cheaper of (cost, audit), where the audit spells the edits' initials. Costs depend on the
audit alone and every edit but an insertion takes one row, so what is cheaper at a top
stays so whatever follows. The grammar recurses to the left: there are few different stacks.

Nothing depends on a conversation fitting one task until its digest is made. Faults come
from counts of equal rows. Narrow rows (no text) are range-partitioned in order and cut
into segments of at most ``SEGMENT`` rows; where a segment does not begin a conversation
it is read from every possible stack. Segments are then joined in order, an audit being
one character a row. Texts move once, to their conversation, and are streamed past the
audit in order: a digest over a conversation is sequential, but holds no text.

Defined results: rows go by turn (missing turns first), then role, then digest of the
text. A missing role or text is one space. A missing conversation id is one conversation.
Repeated rows are duplicates of the first. A role counts by its first character; one
without any fits nowhere. Conversations without rows get an empty audit and no cost;
an empty table gives an empty result. Numbers beyond 64 bits are held at the largest.
Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelaudit.llm.frames import slices
from labelaudit.operators.assemble import salted_join
from labelaudit.session import store

SEGMENT = 4096
SHORT = 64  # conversations up to this length are remembered by their shape
#: The roles' initials, what each edit costs, and what a cut-off row adds unless it is deleted.
GRAMMAR = (
    ("all", ("whole",)),
    ("whole", ()),
    ("whole", ("pairs",)),
    ("whole", ("s", "pairs")),
    ("pairs", ("pair",)),
    ("pairs", ("pairs", "pair")),
    ("pair", ("u", "a")),
)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
_TERMINALS = frozenset("sua")
_MOST = (1 << 63) - 1

Weight = tuple[int, str]


class Node:
    """A stack: the automaton's state, and the stack below it. Equal stacks are one node."""

    __slots__ = ("items", "below", "above", "shifts", "after")

    def __init__(self, items: frozenset[tuple[int, int]], below: Node | None):
        self.items, self.below = items, below
        self.above: dict[str, Node | None] = {}  # by symbol pushed
        self.shifts: dict[str, tuple[Node, ...]] = {}
        self.after: tuple[Node, ...] | None = None  # what its reductions lead to


class Automaton:
    """LR(0) states of the grammar, made as they are met, and the graph of stacks."""

    def __init__(self, grammar: tuple[tuple[str, tuple[str, ...]], ...]):
        self.grammar = grammar
        self.bottom = Node(self._closed({(0, 0)}), None)
        self.nodes = self._all()

    def _closed(self, items: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        found = set(items)
        queue = list(found)
        while queue:
            rule, dot = queue.pop()
            right = self.grammar[rule][1]
            if dot < len(right):
                new = {(i, 0) for i, (left, _) in enumerate(self.grammar) if left == right[dot]} - found
                found |= new
                queue += new
        return frozenset(found)

    def push(self, node: Node, symbol: str) -> Node | None:
        if symbol not in node.above:
            moved = {(r, d + 1) for r, d in node.items if self.grammar[r][1][d : d + 1] == (symbol,)}
            node.above[symbol] = Node(self._closed(moved), node) if moved else None
        return node.above[symbol]

    def reduced(self, node: Node) -> tuple[Node, ...]:
        """The node and all that reductions make of it."""
        if node.after is None:
            found = [node]
            for top in found:
                for rule, dot in sorted(top.items):
                    left, right = self.grammar[rule]
                    if rule and dot == len(right):
                        under = top
                        for _ in right:
                            under = under.below
                        new = self.push(under, left)
                        if new is not None and new not in found:
                            found.append(new)
            node.after = tuple(found)
        return node.after

    def waits(self, node: Node) -> bool:
        """Whether a row could be shifted onto this stack."""
        return any(self.push(node, t) is not None for t in _TERMINALS)

    def accepts(self, node: Node) -> bool:
        return any((0, 1) in top.items for top in self.reduced(node))

    def shift(self, node: Node, symbol: str) -> tuple[Node, ...]:
        """The stacks that wait for more after ``symbol``."""
        if symbol not in node.shifts:
            top = self.push(node, symbol)
            node.shifts[symbol] = () if top is None else tuple(n for n in self.reduced(top) if self.waits(n))
        return node.shifts[symbol]

    def _all(self) -> list[Node]:
        found = [n for n in self.reduced(self.bottom) if self.waits(n)]
        for node in found:
            for symbol in sorted(_TERMINALS):
                found += [n for n in self.shift(node, symbol) if n not in found]
        return found


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton(GRAMMAR)


def _merge(tops: dict[Node, Weight], node: Node, weight: Weight) -> bool:
    old = tops.get(node)
    if old is None or weight < old:
        tops[node] = weight
        return True
    return False


def _inserted(machine: Automaton, tops: dict[Node, Weight]) -> dict[Node, Weight]:
    """The tops after any number of insertions."""
    queue = list(tops)
    while queue:
        node = queue.pop()
        cost, audit = tops[node]
        for symbol in ROLES:
            for new in machine.shift(node, symbol):
                if _merge(tops, new, (cost + INSERT, audit + "I")):
                    queue.append(new)
    return tops


def read(tops: dict[Node, Weight], rows: str) -> dict[Node, Weight]:
    """Tops after ``rows``: a character each, d where it must go, else its initial or x, in capitals where cut off."""
    machine = automaton()
    tops = _inserted(machine, dict(tops))
    for row in rows:
        after: dict[Node, Weight] = {}
        own, more = row.lower(), TRUNCATED if row.isupper() else 0
        for node, (cost, audit) in tops.items():
            _merge(after, node, (cost + DELETE, audit + "D"))
            if own == "d":
                continue
            if own in _TERMINALS:
                for new in machine.shift(node, own):
                    _merge(after, new, (cost + more, audit + "K"))
            for symbol in ROLES:
                for new in machine.shift(node, symbol):
                    _merge(after, new, (cost + REROLE + more, audit + "R"))
        tops = _inserted(machine, after)
    return tops


def best(tops: dict[Node, Weight]) -> Weight:
    machine = automaton()
    return min(weight for node, weight in tops.items() if machine.accepts(node))


@lru_cache(maxsize=1 << 15)
def _from_start(rows: str) -> tuple[tuple[int, int, int, str], ...]:
    return _transfer(rows, False)


def _transfer(rows: str, anywhere: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(place of the first stack, place of the last one, cost, audit), from the bottom or from every stack."""
    nodes = automaton().nodes
    place = {n: i for i, n in enumerate(nodes)}
    return tuple(
        (place[start], place[end], cost, audit)
        for start in (nodes if anywhere else nodes[:1])
        for end, (cost, audit) in read({start: (0, "")}, rows).items()
    )


# --- rows in order, cut into segments -----------------------------------------------------

_SEGMENT = (
    "part int, number long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, rows long, paths array<struct<start:int,end:int,cost:long,audit:string>>"
)


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _given(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("h", F.md5(F.col("text").cast("binary")))


def _narrow(given: DataFrame, everyone: DataFrame) -> DataFrame:
    """Distinct rows without their text: how often each comes, and its faults. Conversations without rows have one that never comes."""
    last = F.substring(_trimmed(F.col("text")), -1, 1)
    rows = given.select(
        "conv", "turn", "role", "h", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.lit(1).alias("n")
    )
    none = everyone.select("conv", F.lit(None).cast("long"), F.lit(""), F.lit(""), F.lit(True), F.lit(False), F.lit(0)).distinct()
    one = F.md5(F.concat_ws("\x00", F.coalesce(F.col("conv").cast("string"), F.lit("\x01")), "role", "h"))
    counted = (
        rows.union(none).groupBy("conv", "turn", "role", "h", "blank", "cut").agg(F.sum("n").alias("copies"))
        .withColumn("_k", one)
    )
    counted = store(counted, "turns")
    real = counted.where("copies > 0 AND NOT blank")
    several = real.groupBy("_k").agg(
        F.count("*").alias("_n"), F.max(F.col("turn").isNull()).alias("_early"), F.min("turn").alias("_first")
    )
    seen = salted_join(counted, several.where("_n > 1").select("_k", "_early", "_first"), "_k", "turn", "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("_early") | (F.col("turn") > F.col("_first"))), F.lit(False))
    initial = F.substring("role", 1, 1)
    own = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return seen.withColumn("again", again).select(
        "conv", "turn", "role", "h", "copies", "blank", "again", "cut", initial.alias("initial"),
        F.when(F.col("blank") | F.col("again"), "d").when(F.col("cut"), F.upper(own)).otherwise(own).alias("row"),
    )


class _Segment:
    """What is counted of consecutive rows of one conversation."""

    def __init__(self, conv, number: int, anywhere: bool):
        self.conv, self.number, self.anywhere = conv, number, anywhere
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.rows: list[str] = []

    def add(self, turn, initial: str, row: str, blank: bool, again: bool, cut: bool, copies: int, fresh: bool) -> None:
        """``copies`` equal rows, the first of all of them if ``fresh``."""
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a role never follows itself
        self.last = initial
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (fresh and not again)
            self.truncated += fresh and not again and cut
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append((row if fresh else "d") + "d" * (copies - 1))

    def out(self, part: int) -> tuple:
        rows = "".join(self.rows)
        paths = _from_start(rows) if not self.anywhere and len(rows) <= SHORT else _transfer(rows, self.anywhere)
        return (
            self.conv, part, self.number, self.blank, self.duplicate, self.truncated, self.illegal,
            self.first, self.last, self.low, self.high, self.turns, len(rows), list(paths),
        )


def _segments(narrow: DataFrame, length: int) -> DataFrame:
    order = ["conv", "turn", "role", "h"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ["conv", "turn", "initial", "row", "blank", "again", "cut", "copies"]
    conv_type = narrow.schema["conv"]
    schema = T.StructType([conv_type, *T.StructType.fromDDL(_SEGMENT).fields])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, segment, n, number = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            for conv, turn, initial, row, blank, again, cut, copies in zip(*[batch.column(c).to_pylist() for c in columns]):
                if segment is None or segment.conv != conv:
                    if segment is not None:
                        yield segment.out(part)
                        number += 1
                    # only the first conversation of a partition may have begun in an earlier one
                    segment, n = _Segment(conv, number, number == 0), 0
                left, fresh = copies, True
                while left:
                    if n >= length:
                        yield segment.out(part)
                        number += 1
                        segment, n = _Segment(conv, number, True), 0
                    some = min(left, length - n)
                    segment.add(turn, initial, row, blank, again, cut, some, fresh)
                    left, fresh, n = left - some, False, n + some
        if segment is not None:
            yield segment.out(part)

    return _map_rows(ordered.select(*columns), cut_up, schema)


def _map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: T.StructType, size: int = 512) -> DataFrame:
    """``mapInArrow`` with a function that yields rows, put together by ``size``."""
    structs = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = []
            for field, values in zip(arrow, zip(*rows)):
                if field.name in structs:
                    names = [f.name for f in field.type.value_type]
                    values = [[dict(zip(names, x)) for x in v] for v in values]
                columns.append(pa.array(values, field.type))
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        held: list[tuple] = []
        for row in fn(batches):
            held.append(row)
            if len(held) >= size:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


# --- segments joined ------------------------------------------------------------------------

_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Whole:
    """A conversation put together from its segments in order."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.low = self.high = None
        self.tops: dict[int, Weight] = {0: (0, "")}

    def add(self, s: dict) -> None:
        if not s["rows"]:
            return
        for name in self.counts:
            self.counts[name] += s[name]
        if self.last is not None and self.last + s["first"] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = s["last"]
        if s["low"] is not None:
            self.counts["turns"] -= s["low"] == self.high
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        after: dict[int, Weight] = {}
        for path in s["paths"]:
            if path["start"] in self.tops:
                cost, audit = self.tops[path["start"]]
                weight = cost + path["cost"], audit + path["audit"]
                if path["end"] not in after or weight < after[path["end"]]:
                    after[path["end"]] = weight
        self.tops = after

    def out(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        nodes = automaton().nodes
        cost, audit = best({nodes[i]: w for i, w in self.tops.items()})
        c = self.counts
        return min(gaps, _MOST), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit


def _joined(segments: DataFrame) -> DataFrame:
    schema = T.StructType([segments.schema["conv"], *T.StructType.fromDDL(_FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, whole = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.slice(i, 1).to_pylist()[0]
                if whole is None or s["conv"] != conv:
                    if whole is not None:
                        yield (conv, *whole.out())
                    conv, whole = s["conv"], _Whole()
                whole.add(s)
        if whole is not None:
            yield (conv, *whole.out())

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return _map_rows(ordered, run, schema)


def parse(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    everyone: DataFrame | None = None, segment: int = SEGMENT,
) -> DataFrame:
    """Per conversation (also those of ``everyone`` without rows): ``conv``, gaps, counts of faults, cost and audit."""
    given = _given(rows, conv, turn, role, text)
    ids = (rows if everyone is None else everyone).select(F.col(conv).alias("conv"))
    return _joined(store(_segments(_narrow(given, ids), segment), "segments"))


# --- texts past the audits --------------------------------------------------------------------


class _Writer:
    """Applies an audit to the rows of its conversation, in order; yields (edit, role, text) of rows that stay or are put in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        return "a" if self.last == "u" else "u"

    def _put_in(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.last = self._next()
            yield "insert", ROLES[self.last], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._put_in()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[0]
            yield "keep", role, text
        elif edit == "R":
            self.last = self._next()
            yield "rerole", ROLES[self.last], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._put_in()


def _streamed(given: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's findings, then its rows in order, within one partition."""
    names = [f.name for f in T.StructType.fromDDL(_FOUND).fields]
    head = found.select("conv", F.lit(0).alias("kind"), F.struct(*names).alias("found"))
    body = given.select("conv", F.lit(1).alias("kind"), "turn", "role", "h", "text")
    both = head.unionByName(body, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "h").drop("turn", "h")


def _written(streamed: DataFrame, begin: Callable, write: Callable, end: Callable, schema: T.StructType) -> DataFrame:
    """Rows that ``write`` makes of each repaired row, and ``end`` of each conversation; ``begin`` makes what they share."""
    columns = ["conv", "kind", "found", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        writer = state = None
        for batch in (part for whole in batches for part in slices(whole)):
            for conv, kind, found, role, text in zip(*[batch.column(c).to_pylist() for c in columns]):
                if kind == 0:
                    if writer is not None:
                        for row in writer.end():
                            yield from write(state, *row)
                        yield from end(state)
                    writer, state = _Writer(found["audit"]), begin(conv, found)
                else:
                    for row in writer.row(role, text):
                        yield from write(state, *row)
        if writer is not None:
            for row in writer.end():
                yield from write(state, *row)
            yield from end(state)

    return _map_rows(streamed.select(*columns), run, schema)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """The repaired conversations: id, number of the row from 0, role, text, and the edit (keep, rerole or insert)."""
    found = store(parse(rows, conv, turn, role, text, segment=segment), "audits")
    streamed = _streamed(_given(rows, conv, turn, role, text), found)
    schema = T.StructType([streamed.schema["conv"], *T.StructType.fromDDL("nr long, role string, text string, edit string").fields])

    def write(state: list, edit: str, own: str, words: str) -> Iterator[tuple]:
        state[1] += 1
        yield state[0], state[1] - 1, own, words, edit

    out = _written(streamed, lambda c, _: [c, 0], write, lambda _: (), schema)
    return out.toDF(conv, "nr", "role", "text", "edit")


def report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    everyone: DataFrame | None = None, segment: int = SEGMENT,
) -> DataFrame:
    """Per conversation: what :func:`parse` finds, and the digest of the repaired ``role:text`` lines."""
    found = store(parse(rows, conv, turn, role, text, everyone, segment), "audits")
    streamed = _streamed(_given(rows, conv, turn, role, text), found)
    fields = T.StructType.fromDDL(f"{_FOUND}, repaired_sha256 string").fields
    schema = T.StructType([streamed.schema["conv"], *fields])

    def begin(conv_id, what: dict) -> list:
        return [conv_id, what, hashlib.sha256(), False]

    def write(state: list, edit: str, own: str, words: str) -> Iterator[tuple]:
        state[2].update((("\n" if state[3] else "") + own + ":" + words).encode())
        state[3] = True
        return iter(())

    def end(state: list) -> Iterator[tuple]:
        yield (state[0], *state[1].values(), state[2].hexdigest())

    return _written(streamed, begin, write, end, schema).withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults put into rows by a checksum of id and turn, to measure what repair does: id, turn, role and text."""
    own, words = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.crc32(name.cast("binary")) % 20
    changed = rows.select(
        conv,
        turn,
        F.when(kind == 4, "user").otherwise(own).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.translate(words, ".!?", "")).otherwise(words).alias(text),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return changed.where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_i")
