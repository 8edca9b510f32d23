"""Chat formatting with declarative mappings chosen by schema fingerprints.

A record is JSON. The nested paths of its fields, with ``[]`` for the elements of a
list, are hashed to a fingerprint; the fingerprint selects the mapping, which says
where each turn's role and text lie. So prompt and completion pairs, instruction
records, message lists in several spellings and tables with a row per turn all become
the same canonical turns (group, turn, role, text).

A turn is written as

    <turn role>\n text \n</turn>\n

with a backslash before every backslash, ``<`` and ``#`` of a text, so no text
contains a mark and every text can be read back. The loss mask covers the text of
assistant turns. A conversation is kept as one segment per turn, in order: it is
formatted, and read back, by streaming over its sorted segments, so its length does
not matter, and a conversation with many turns is not collected anywhere.

Defined results: a missing text is empty, a missing role is "user"; a record whose
fields match no mapping is returned with the group alone by :func:`unmapped`; turns
are ordered by turn (missing ones first), then role and text; rows without a group
form one; an empty table gives an empty result. Columns beside the record are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where the turns of one layout lie.

    ``turns`` are (role, paths): the texts at the paths, joined by an empty line, are
    one turn. With ``each``, a list's path, role and text are paths in its elements. With
    ``row``, the record is one turn itself. ``optional`` fields may be absent.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    group: str = ""
    turn: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> frozenset[str]:
        inner = f"{self.each}[]." if self.each else ""
        own = {p for _, paths in self.turns for p in paths}
        own |= {inner + p for p in (self.role, self.text) if p}
        own |= {p for p in (self.group, self.turn) if p}
        return frozenset(own)

    def fingerprints(self) -> set[str]:
        """Of the layout with every choice of its optional fields."""
        need = self.paths() - set(self.optional)
        return {
            fingerprint(need | set(some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)
        }


def fingerprint(paths) -> str:
    return blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields that hold no further fields."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, at + "[]")} or {at + "[]"}
    return {at}


#: The layouts known without further declaration.
MAPPINGS = (
    Mapping("turn_rows", role="role", text="text", group="conv_id", turn="turn"),
    Mapping("messages", each="messages", role="role", text="content", group="id", optional=("id",)),
    Mapping("from_value", each="conversations", role="from", text="value", group="id", optional=("id",)),
    Mapping(
        "instruction",
        turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        group="id",
        optional=("id", "system", "input"),
    ),
    Mapping("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",))), group="id", optional=("id",)),
    Mapping("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",))), group="id", optional=("id",)),
    Mapping(
        "nested_chosen",
        turns=(("user", ("prompt.text",)), ("assistant", ("chosen.text",))),
        group="id",
        optional=("id", "rejected.text"),
    ),
)


def _index(mappings) -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in mappings:
        for f in m.fingerprints():
            if out.setdefault(f, m) is not m:
                raise ValueError(f"layouts {out[f].name} and {m.name} look alike")
    return out


def _at(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(value, names: dict[str, str] = ROLES) -> str:
    name = _text(value) or "user"
    return names.get(name, name)


def turns_of(record, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of a record."""
    if mapping.each:
        items = _at(record, mapping.each) or []
        return [(i, _role(_at(x, mapping.role)), _text(_at(x, mapping.text))) for i, x in enumerate(items)]
    if mapping.role:
        return [(_at(record, mapping.turn), _role(_at(record, mapping.role), {}), _text(_at(record, mapping.text)))]
    out = []
    for role, paths in mapping.turns:
        texts = [t for p in paths if (t := _text(_at(record, p)))]
        if texts or role == LOSS_ROLE:
            out.append((len(out), role, "\n\n".join(texts)))
    return out


def _read(line: str | None, key: str | None, index: dict[str, Mapping]) -> list[tuple]:
    """Rows of a record: layout, fingerprint, group, turn, role, text, and why it has no layout."""
    try:
        value = None if line is None else json.loads(line)
    except (ValueError, RecursionError):
        return [(None, None, key, None, None, None, "no JSON")]
    print_ = fingerprint(field_paths(value)) if isinstance(value, dict) else None
    mapping = index.get(print_)
    if mapping is None:
        return [(None, print_, key, None, None, None, "unknown layout")]
    group = _at(value, mapping.group) if mapping.group else None
    group = key if group is None else _text(group)
    turns = turns_of(value, mapping)
    if not all(t is None or type(t) is int and -(1 << 63) <= t < 1 << 63 for t, _, _ in turns):
        return [(None, print_, key, None, None, None, "turn is no whole number")]
    try:
        "".join([group or "", *(part for _, role, text in turns for part in (role, text))]).encode()
    except UnicodeEncodeError:
        return [(None, print_, key, None, None, None, "text is no Unicode")]
    return [(mapping.name, print_, group, t, role, text, None) for t, role, text in turns]


def canonical_turns(records: DataFrame, record: str = "record", key: Column | None = None, mappings=MAPPINGS) -> DataFrame:
    """Turns of JSON records: layout, group, turn, role, text.

    ``group`` is the field that the mapping names, else ``key`` (of the row), as text.
    Records of no known layout give a row with the layout missing, and so do records that
    can't be read; ``reason`` says why: no JSON, text that is no Unicode (half of a
    surrogate pair), or a turn that is no whole number of 64 bits.
    """
    key = F.lit(None).cast("string") if key is None else key.cast("string")
    rows = records.select(records[record].alias("_record"), key.alias("_key"))
    names = ["layout", "fingerprint", "group", "turn", "role", "text", "reason"]
    index = _index(mappings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, own in zip(batch.column("_record").to_pylist(), batch.column("_key").to_pylist()):
                out += _read(line, own, index)
            columns = list(zip(*out)) if out else [()] * len(names)
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, "layout string, fingerprint string, group string, turn long, role string, text string, reason string")


def unmapped(turns: DataFrame) -> DataFrame:
    """Fingerprints of the records without a layout, why they have none, and how many they are."""
    return turns.where("layout IS NULL").groupBy("fingerprint", "reason").agg(F.count(F.lit(1)).alias("records"))


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\<#{more}])", r"\\$1")


def segments(turns: DataFrame) -> DataFrame:
    """The formatted form of each turn: group, turn, role, text, segment, mask_from, mask_to.

    The mask is the part of the segment that counts for the loss, in code points, end
    exclusive; it is empty for turns of other roles.
    """
    known = turns.where("layout IS NOT NULL")
    head = F.concat(F.lit("<turn "), F.regexp_replace(escaped("role", ">"), "\n", r"\\n"), F.lit(">\n"))
    made = known.withColumns({"_head": head, "_body": escaped("text")})
    start = F.length("_head")
    mask_to = F.when(F.col("role") == LOSS_ROLE, start + F.length("_body")).otherwise(start)
    return made.select(
        "group", "turn", "role", "text",
        F.concat("_head", "_body", F.lit("\n</turn>\n")).alias("segment"),
        start.alias("mask_from"),
        mask_to.alias("mask_to"),
    )


def in_order(formatted: DataFrame) -> DataFrame:
    """Segments dealt by group and sorted, ready to be written or read conversation by conversation."""
    return formatted.repartition("group").sortWithinPartitions("group", "turn", "role", "text")


_SEGMENT = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)\n</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, or of a part of whole segments."""
    out, at = [], 0
    while at < len(formatted):
        found = _SEGMENT.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], found[1], flags=re.S)
        out.append((role, unescaped(found[2])))
        at = found.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per group, from the formatted text and its mask alone: counts and digests.

    group, n_turns, turns_sha256 (role, line break, text, line break of each turn),
    loss_chars, loss_sha256 (all text under the mask, unescaped), formatted_chars.
    """
    names = ["group", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(s):
            return s["group"], s["n"], s["all"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"]

        state = None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in ("group", "segment", "mask_from", "mask_to")]):
                group, segment, low, high = row
                if state is None or state["group"] != group:
                    if state is not None:
                        out.append(closed(state))
                    state = {"group": group, "n": 0, "all": sha256(), "loss": sha256(), "loss_n": 0, "chars": 0}
                for role, text in parse(segment):
                    state["all"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                masked = unescaped(segment[low:high])
                state["loss"].update(masked.encode())
                state["loss_n"] += len(masked)
                state["chars"] += len(segment)
            yield _record(out)
        if state is not None:
            yield _record([closed(state)])

    def _record(out):
        columns = list(zip(*out)) if out else [()] * len(names)
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "group string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_order(formatted).select("group", "segment", "mask_from", "mask_to").mapInArrow(run, schema)


def row_records(table: DataFrame, group: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table with a row per turn as records of the layout ``turn_rows``."""
    fields = F.struct(
        table[group].alias("conv_id"), table[turn].alias("turn"), table[role].alias("role"), table[text].alias("text")
    )
    return table.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))
