"""Decontamination, centroid clustering and conversation repair: pieces, odd rows, and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from labelaudit.llm import centroids, decontaminate, turn_repair

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- decontamination --------------------------------------------------------------------------


def contamination(texts, items, width=10):
    """(n_words, hit words, item ids) of each text."""
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(len(w) - min(len(w), width) + 1):
            if w:
                windows.setdefault(tuple(w[i : i + width]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def made_up(seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "ça", "日本", "7", "x", "y"]
    text = lambda n: "".join(rng.choice(alphabet) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i % 5 if i else None, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 14]))) for i in range(12)] + [(9, None)]
    texts = [text(rng.randrange(60)) for _ in range(30)] + [a + "q " + (b or "") for a, (_, b) in zip(["", "z "] * 6, items)]
    return [*texts, None, "", " . ", items[4][1] * 300], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits_of_made_up_texts(spark, block_bytes):
    """Also with the items dealt into many blocks, each a pass of its own."""
    texts, items = made_up(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench, ["doc_id"], block_bytes=block_bytes).orderBy("doc_id").collect()
    want = contamination(texts, items)
    assert [(r["n_words"], r["n_hit"]) for r in got] == [w[:2] for w in want]
    assert [r["items_sha256"] for r in got] == [hashlib.sha256(",".join(w[2]).encode()).hexdigest() for w in want]
    assert [(r["n_items"], r["contaminated"]) for r in got] == [(len(w[2]), w[1] > 0) for w in want]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Were all windows to hash alike, only equal words would be hits."""
    monkeypatch.setattr(decontaminate, "_MIX", np.uint64(0))
    texts, items = made_up(2)
    table = decontaminate.Table([("" if n is None else str(n), (t or "").encode()) for n, t in items], 10)
    for text, want in zip(texts[:35], contamination(texts[:35], items)):
        raw = text.encode()
        own = decontaminate.read_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        hit = {j for i, n, _ in table.hits(own) for j in range(i, i + n)}
        assert (len(own.start), len(hit)) == want[:2]


def test_words_of_a_text_in_chunks(monkeypatch):
    text = made_up(3)[0][-1].encode()
    whole = decontaminate.read_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    parts = decontaminate.read_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (whole.windows(10)[1] == parts.windows(10)[1]).all() and len(whole.start) > 1000


def test_spans_and_documents_go(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = {1: f"É before. {item.title()}! After é.", 2: "one two three four five", 3: None, 4: f"{item}", 5: f"x {item} y {item}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_hit", F.lit("own"))
    got = {r["doc_id"]: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert [got[i]["text"] for i in texts] == ["É before. ! After é.", texts[2], None, "", "x  y "]
    assert all(r["n_hit"] == "own" for r in got.values())
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3}
    assert decontaminate.remove_documents(docs, bench, share=0.8).where("doc_id = 1").count() == 1
    for given in (odd, none):
        assert decontaminate.remove_spans(given, bench).select(*given.columns).exceptAll(given).count() == 0
        assert decontaminate.remove_documents(given, bench.where("item_id > 9")).count() == given.count()


# --- centroid clustering ------------------------------------------------------------------------


def clusters(rows, dims, k=8, rounds=10):
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)
    centres = [v for _, v in by_hash[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for last in [False] * rounds + [True]:
        own = [min((distance(v, c), j) for j, c in enumerate(centres)) for _, v in rows]
        if not last:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, o) in zip(rows, own) if o == j]
                if mine:
                    centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    sums = {j: sum(d for d, o in own if o == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), o, d, sums[o], sum(sums.values()), digest[o]) for (i, _), (d, o) in zip(rows, own))


def test_clusters_of_the_given_vectors(spark):
    given = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = E.queries()["op12_centroid_clusters"](spark, SF).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == clusters(list(zip(given.vec_id, given.embedding)), 64)


@pytest.mark.parametrize("block", [2, 64])
def test_clusters_of_odd_vectors(spark, block):
    """Ties, repeated rows, missing and unusable ones, and a component beyond the limit of exact floats."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.25, 0.5, -3.0]) for _ in range(3)]) for i in range(60)]
    rows += [(7, [0.5, 0.5, 0.5])] * 40 + [(None, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (70, [40000.0, -40000.0, 1e-9])]
    bad = [(80, None), (81, []), (82, [1.0, 2.0]), (83, [1.0, None, 2.0]), (84, [float("nan"), 0.0, 0.0]), (85, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    got = centroids.report(table, dims=3, k=4, block=block).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == clusters(rows, 3, 4)


def test_clusters_keep_columns(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0], "x", i) for i in range(5)], "vec_id long, v array<float>, cluster string, _nr long")
    done, found = centroids.cluster(table, "v", dims=2, k=9)
    assert done.columns == ["vec_id", "v", "_nr", "cluster", "distance"] and len(found) == 5
    assert {r["vec_id"]: r["_nr"] for r in done.collect()} == {i: i for i in range(5)}
    assert centroids.report(table.where("vec_id > 9"), "v", dims=2).collect() == []
    huge = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, v array<double>")
    assert centroids.report(huge, "v", dims=2, k=1).count() == 2


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_step_by_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = centroids.hilbert_key(cells, bits)
    walk = cells[sorted(range(len(cells)), key=lambda i: keys[i].tobytes())]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(5)
    some = 0
    for _ in range(300):
        centres = rng.integers(-4, 5, (5, 3))
        points = rng.integers(-4, 5, (6, 3)) // rng.integers(1, 4)
        numbers = centroids.candidates(points.min(axis=0), points.max(axis=0), centres)
        apart = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        assert set(apart.argmin(axis=1)) <= set(numbers.tolist())
        own, distance = centroids.nearest(points, centres, numbers)
        assert (own == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
        some += len(numbers) < 5
    assert some > 50


# --- conversation repair ------------------------------------------------------------------------


def cheapest(rows):
    """Cost and audit by a search over all prefixes: (initial, must go, cut off) per row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    tops = {"": (0, "")}

    def better(into, state, weight):
        if state not in into or weight < into[state]:
            into[state] = weight

    def grown(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for x in "ua":
                    if (state, x) in step:
                        better(states, step[state, x], (cost + 5, audit + "I"))
        return states

    tops = grown(tops)
    for initial, gone, cut in rows:
        after = {}
        for state, (cost, audit) in tops.items():
            better(after, state, (cost + 2, audit + "D"))
            for x, price, letter in [] if gone else [(initial, 0, "K"), ("u", 1, "R"), ("a", 1, "R")]:
                if (state, x) in step:
                    better(after, step[state, x], (cost + price + 5 * cut, audit + letter))
        tops = grown(after)
    return min(w for s, w in tops.items() if s in ("", "a"))


def expected(table):
    """The contract on pandas rows that are already damaged, conversation by conversation."""
    out = {}
    for conv, group in table.groupby("conv", dropna=False):
        rows = sorted(group.itertuples(), key=lambda r: (r.turn is not None, r.turn or 0, r.role, hashlib.md5(r.text.encode()).hexdigest()))
        seen, states, counts = set(), [], [0, 0, 0]
        for r in rows:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", r.text)
            fault = 0 if not solid else 1 if (r.role, r.text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((r.role, r.text))
            if fault is not None:
                counts[fault] += 1
            states.append((r.role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = {r.turn for r in rows if r.turn is not None}
        cost, audit = cheapest(states)
        lines, left, last = [], iter(rows), ""
        for letter in audit:
            r = None if letter == "I" else next(left)
            if letter != "D":
                role = r.role if letter == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{r.text if r else ''}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_up_turns(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "unknown", "tool", "", " ", "agent"]
    texts = ["Yes.", "No!", "cut off", "", " \t\x0b", "ok?  \n", "日本。", "Yes."]
    rows = []
    for conv in range(n):
        at = 0
        for _ in range(rng.randrange(14)):
            at += rng.choice([0, 1, 1, 1, 2, 40])
            turn = None if rng.random() < 0.05 else at
            role = rng.choices(roles, [8, 8, 2, 1, 1, 1, 1, 1])[0]
            rows += [(conv, turn, role, rng.choice(texts))] * rng.choice([1, 1, 1, 1, 2, 3])
    return rows


@pytest.mark.parametrize("segment", [4096, 3])
def test_repair_of_made_up_conversations(spark, segment):
    """Also cut into segments of three rows, which are read from every stack and joined."""
    rows = made_up_turns(6, 150)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.report(table, segment=segment).collect()}
    frame = pd.DataFrame(rows, columns=["conv", "turn", "role", "text"]).astype(object)
    assert got == expected(frame.where(frame.notna(), None))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 3, "user", "Really?"), (1, 4, "assistant", "Yes."),
            (1, 4, "assistant", "Yes."), (2, 0, "assistant", "Hello."), (None, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("own"))
    got = sorted(tuple(r) for r in turn_repair.repair(table).where("conv_id = 1").collect())
    assert got == [(1, 0, "system", "Be brief.", "keep"), (1, 1, "user", "Really?", "keep"), (1, 2, "assistant", "Yes.", "keep")]
    assert turn_repair.repair(table.where("turn > 9")).collect() == []
    found = {r["conv_id"]: r for r in turn_repair.report(table).collect()}
    assert (found[1]["audit"], found[1]["gaps"], found[1]["cost"]) == ("KDKKD", 1, 4)
    assert (found[2]["audit"], found[2]["cost"]) == ("D", 2)
    assert (found[None]["blank"], found[None]["audit"], found[None]["gaps"]) == (1, "D", 0)


def test_a_conversation_of_many_rows(spark):
    """A third of all rows: one conversation, over several partitions and segments; half of it one repeated row."""
    n = 6_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"),
    )
    same = spark.range(n).select(F.lit(1).cast("long"), F.lit(-1).cast("long"), F.lit("user"), F.lit("again."))
    others = spark.range(n).select("id", F.lit(0).cast("long"), F.lit("user"), F.lit("Hi.")).where("id > 1")
    r = turn_repair.report(rows.union(same).union(others), segment=512).where("conv_id = 1").first()
    # of the equal rows the first could stay for one insertion; a delete is cheaper
    assert (r["duplicate"], r["cost"], r["audit"]) == (n - 1, 2 * n, "D" * n + "K" * n)


def test_conversations_that_lose_all_rows(spark):
    ids = [i for i in range(300) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    given = spark.createDataFrame([(i, 0, "user", "Hi.") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.report(turn_repair.damage(given), everyone=given).collect()}
    assert len(got) == 300 and ids
    assert all(got[i] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(5)] + [(None, 1, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((" " if r[0] is None else r[0], r[1], r[2], r[3]) for r in turn_repair.damage(table).where("conv_id IS NOT NULL").collect())
    want = []
    for c, t, role, text in rows[:-1]:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        changed = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "A B C" if kind == 2 else text)
        want += [changed] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)
    assert [tuple(r) for r in turn_repair.damage(table).where("conv_id IS NULL").collect()] in ([(None, 1, " ", " ")], [(None, 1, "user", " ")], [(None, 1, " ", "")], [])
