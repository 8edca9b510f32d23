"""Secret scans by one combined deterministic automaton.

All rules are compiled into a single transition array (see ``automata``), and each
text is read once, byte by byte, for all rules together. Where a rule's matches
end, a small automaton of the reversed rule walks back to the leftmost start, not
beyond the rule's match before. A rule ends in a run of a class or in fixed
characters, so a match ends where its run of accepting states does; a private key's
body is read on from its header to the footer.

Defined results: a missing or empty text has no spans; offsets are code points, the
end exclusive; matches of one rule do not overlap, those of different rules may;
equal texts have equal spans; an empty table gives an empty result. Texts are read
whole in a map without any shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from labelaudit.llm import automata
from labelaudit.llm.frames import hidden, made_of, map_texts, shown


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` then ``tail``; it counts if the tail has ``least`` bytes. ``fold`` frees the head's case.

    ``body`` is an expression of ``re`` over ASCII characters.
    """

    kind: str
    head: str
    tail: str
    least: int
    fold: bool = False
    body: str = ""  # what follows the match belongs to it, and all of it is the secret part


#: The kinds every scan has, in the order of their names in results.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=\-]+", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{8,}", 24),  # from 8 on, so that few ends of prose words are looked at
)
#: What a key is written in: base64, header fields, breaks also as a backslash and n, and the marks of quoted lines.
_PEM = r"[A-Za-z0-9+/=\s:,\\\"'>#*\-]"
#: What this scan finds beside them. A key ends with its footer or, if that is missing, with the run.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*", r"PRIVATE KEY-----", 0, body=rf"{_PEM}*?-----END [A-Z ]*PRIVATE KEY-----|{_PEM}*"),
    Rule("code_host", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9\-]+", 10),
    Rule("cloud", r"AIza", r"[A-Za-z0-9_\-]+", 35),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Spans of all rules in a text."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        heads = [automata.parse(r.head, r.fold) for r in rules]
        whole = [("cat", [h, automata.parse(r.tail)]) for h, r in zip(heads, rules)]
        forward = automata.compile_trees(whole, anywhere=True)
        self.classes, self.start = forward.classes, forward.rows()[0]
        self.accept = len(self.start) - 2
        self.back = [self._walker(automata.reverse(t)) for t in whole]
        self.head = [self._walker(h) for h in heads]
        self.body = [re.compile(r.body.encode()) if r.body else None for r in rules]

    @staticmethod
    def _walker(tree):
        machine = automata.compile_trees([tree], anywhere=False)
        return machine.classes, machine.rows()[0]

    @staticmethod
    def _longest(walker, data) -> int:
        """Bytes of the longest match at the start of ``data``; -1 if there is none."""
        classes, state = walker
        best = 0 if state[-2] else -1
        for n, b in enumerate(data, 1):
            state = state[classes[b]]
            if state[-2]:
                best = n
            elif state[-1]:
                break
        return best

    def _ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of each run of accepting bytes, by end: the one pass over the text."""
        state, accept = self.start, self.accept
        open_, out = 0, []
        for at, c in enumerate(data.translate(self.classes)):
            state = state[c]
            if (now := state[accept]) != open_:
                ended = open_ & ~now
                while ended:
                    out.append(((ended & -ended).bit_length() - 1, at))
                    ended &= ended - 1
                open_ = now
        while open_:
            out.append(((open_ & -open_).bit_length() - 1, len(data)))
            open_ &= open_ - 1
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(start, rule, end, start of the tail) in code points, by start, then rule."""
        found, free = [], [0] * len(self.rules)
        for rule, end in self._ends(data):
            n = self._longest(self.back[rule], _backward(data, end, free[rule]))
            if n < 0:  # it would start inside the match before
                continue
            start = value = end - n
            if body := self.body[rule]:
                end = body.match(data, end).end()
            else:
                value += self._longest(self.head[rule], memoryview(data)[start:end])
            free[rule] = end
            if end - value >= self.rules[rule].least:
                found.append((start, rule, end, value))
        if not found or data.isascii():
            return sorted(found)
        place, seen, points = {}, 0, 0
        for at in sorted({p for s in found for p in (s[0], s[2], s[3])}):
            points += len(data[seen:at].decode())
            place[at], seen = points, at
        return sorted((place[s], rule, place[e], place[v]) for s, rule, e, v in found)


def _backward(data: bytes, end: int, least: int):
    for i in range(end - 1, least - 1, -1):
        yield data[i]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per Python worker."""
    return Scanner(rules)


def scan(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns and ``spans``: kind, start, end and the start of the secret part."""

    def run(texts: list[bytes]) -> dict[str, list]:
        found = [scanner(rules).spans(t) for t in texts]
        kind = [r.kind for r in rules]
        return {
            "spans": [
                [{"kind": kind[r], "start": s, "end": e, "secret": v} for s, r, e, v in spans] for spans in found
            ]
        }

    return map_texts(docs, text, keep, "spans array<struct<kind: string, start: long, end: long, secret: long>>", run)


def digests(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the counts and digest of the base kinds, and all spans as text."""
    spans = F.col("spans")

    def joined(s):
        return F.array_join(
            F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    def of(kinds):
        return F.filter(spans, lambda x: x["kind"].isin(kinds))

    base = of([r.kind for r in BASE_RULES])
    counts = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return scan(docs, keep, text).select(
        *keep, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with the secret part of every span, overlaps joined, replaced by ``mark``."""
    rows, names = hidden(docs)

    def clean(data: bytes) -> str | None:
        spans = scanner(rules).spans(data)
        if not spans:
            return None  # as it is
        line, out, at = data.decode(), [], 0
        for start, end in _joined([(v, e) for _, _, e, v in spans]):
            out += [line[at:start], mark]
            at = end
        return "".join([*out, line[at:]])

    def run(texts: list[bytes]) -> dict[str, list]:
        return {"clean": [clean(t) for t in texts]}

    made = rows.withColumn("made", made_of(F.col(names[text]), "clean string", run))
    return shown(made, names, F.coalesce(made["made.clean"], made[names[text]]).alias(text)).select(*docs.columns)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
