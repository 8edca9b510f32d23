"""Records that cannot be read, names by surname alone, draws that run out, rows without an id."""

import json
import re

import numpy as np
from pyspark.sql import functions as F

from labelaudit.llm import chat, pii, suffix_dedup


def test_records_that_cannot_be_read(spark):
    row = {"conv_id": 1, "turn": 0, "role": "user", "text": "Hi."}
    lines = {
        "a": json.dumps(row), "b": '{"conv_id": 1, "turn"', "c": json.dumps(row | {"text": "\ud800"}), "d": json.dumps(row | {"turn": "first"}),
        "e": json.dumps(row | {"turn": 1 << 70}), "f": "[" * 100_000, "g": None, "h": "17", "i": json.dumps(row | {"turn": True}),
        "j": json.dumps(row | {"role": "\udfff"}), "k": json.dumps(row | {"turn": None}), "l": "",
    }
    records = spark.createDataFrame(list(lines.items()), "key string, record string")
    got = {}
    for key in lines:
        turns = chat.canonical_turns(records.where(F.col("key") == key), key=None).collect()
        assert len(turns) == 1
        got[key] = turns[0]["reason"]
    assert got == {
        "a": None, "b": "no JSON", "c": "text is no Unicode", "d": "turn is no whole number", "e": "turn is no whole number",
        "f": "no JSON", "g": "unknown layout", "h": "unknown layout", "i": "turn is no whole number", "j": "text is no Unicode",
        "k": None, "l": "no JSON",
    }
    whole = chat.canonical_turns(records)
    assert chat.segments(whole).count() == 2
    assert sum(r["records"] for r in chat.unmapped(whole).collect()) == 10


def test_persons_by_their_surname_alone(spark):
    texts = [
        "Mr. Tom Hall met Mrs. Anna Hall. Then Hall left, and HALL's dog; the Hallway stayed.",
        "Nobody named here: the Hall was empty.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace(docs, "k").collect()}
    new = got[0]["text"]
    surname = re.search(r"Mr\. \S+ (\S+) met", new)[1]
    assert not re.search(r"\bHall\b|\bHALL\b", new) and f"Then {surname} left, and {surname.upper()}'s dog; the Hallway stayed." in new
    assert got[1]["text"] == texts[1] and got[0]["n_entities"] == 2


def test_short_addresses_never_run_out(spark):
    """All addresses of one letter or digit at three short domains: more than such letters, were the surrogates as short."""
    mails = [f"{c}@{d}.com" for c in "abcdefghijklmnopqrstuvwxyz0123456789" for d in "xyz"]
    docs = spark.createDataFrame([(i, f"to {m} now") for i, m in enumerate(mails)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"][3:-4] for r in pii.replace(docs, "k").collect()}
    new = [got[i] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    domains = {}
    for a, b in zip(mails, new):
        domains.setdefault(a.split("@")[1], set()).add(b.split("@")[1])
    assert all(len(d) == 1 for d in domains.values()) and len(set.union(*domains.values())) == 3


def test_rows_without_an_id_are_told_apart(spark):
    """The same result with and without ids, also where a gram is so common that it is split and rows are equal."""
    rng = np.random.default_rng(1)
    make = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    line, around = make(120), [make(150) for _ in range(4)]
    texts = [around[i % 4][i:] + line + around[i % 3][: 150 - 7 * (i % 5)] for i in range(20)] + [around[0] + line] * 6 + ["", None]
    columns = ["text", "n_removed", "n_spans", "kept"]
    out = []
    for ids in (range(len(texts)), [None] * len(texts)):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
        rows = suffix_dedup.remove_repeats(docs, group=2).select(*columns).collect()
        out.append(sorted((r["text"] or "", r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows))
    assert out[0] == out[1] and sum(r[1] for r in out[0]) > 0


def test_suffix_dedup_shuffles_texts_once(spark, tmp_path):
    """Both joins of texts read the same shuffle, also where ids may be missing."""
    passage = "".join(chr(97 + i * i % 23) for i in range(260))
    rows = [(i, f"{i} " * 40 + passage) for i in range(20)] + [(None, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = suffix_dedup.remove_repeats(spark.read.parquet(f"{tmp_path}/docs")).select("doc_id", "n_removed")
    assert {r.n_removed for r in found.collect()} >= {260}
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
