"""Queries without SQL against plain Python on the smallest tables."""

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash

import __spark_entry__ as E
from labelaudit.llm import bpe, suffix_dedup
SF = "/root/testdata/sf0.001"

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, name):
    return {r["doc_id"]: r for r in E.queries()[name](spark, SF).collect()}


def test_simhash(spark, fixture_docs):
    def print_of(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = WORDS.findall(text)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if words else 0

    prints = dict(zip(fixture_docs.doc_id, map(print_of, fixture_docs.text)))
    first = {i: i for i in prints}
    for _ in prints:
        new = {i: min(first[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == first:
            break
        first = new
    got = rows(spark, "op3_simhash_components")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", first[i]) for i in prints
    }


def removed(texts, width=200):
    """(bytes removed, runs, digest of the rest) of each text."""
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((int(gone.sum()), runs, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(spark, fixture_docs):
    want = removed([t.encode() for t in fixture_docs.text])
    got = rows(spark, "op4_suffix_dedup")
    assert [tuple(got[i])[2:5] for i in fixture_docs.doc_id] == want


@pytest.mark.parametrize("group", [1, 3])
def test_suffix_dedup_with_common_grams(spark, group):
    """A line shared by all texts, with what stands around it shared by few, split to the last level."""
    rng = np.random.default_rng(group)
    line = rng.integers(97, 123, 120).astype(np.uint8).tobytes().decode()
    around = [rng.integers(97, 123, 150).astype(np.uint8).tobytes().decode() for _ in range(4)]
    texts = [around[i % 4][i:] + line + around[i % 3][: 150 - 7 * (i % 5)] for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, group=group).orderBy("doc_id").collect()
    want = removed([t.encode() for t in texts])
    assert [(r["n_removed"], r["n_spans"], sha256(bytes(r["kept"])).hexdigest()) for r in got] == want
    assert sum(w[0] for w in want) > 0


def test_fertility(spark, fixture_docs):
    got = rows(spark, "op5_tokenizer_fertility")
    for i, text in zip(fixture_docs.doc_id, fixture_docs.text):
        words = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = Counter(grams)
        repeat = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)})
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        assert tuple(got[i])[1:7] == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed
        )
        assert not (failed and got[i]["kept"])
        assert 0 <= got[i]["byte_share"] <= 1 and 0 <= got[i]["entropy"] <= 1


def test_bpe(spark, fixture_docs):
    path, pattern = bpe.production()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    got = rows(spark, "op8_byte_level_bpe")
    for i, text in zip(fixture_docs.doc_id, fixture_docs.text):
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        assert tuple(got[i]) == (i, len(ids), sha256(ids.tobytes()).hexdigest(), sha256(text.encode()).hexdigest())


def test_weighted_fingerprints(spark, fixture_docs):
    def similarity(a, b):
        a, b = (Counter(t.encode().lower().split()) for t in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    docs = fixture_docs.sort_values("doc_id")
    texts = docs.text.tolist()
    after = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, after)]
    got = rows(spark, "op9_weighted_fingerprints")
    assert sorted(got) == docs.doc_id.tolist()
    assert [got[i]["edited_sha256"] for i in docs.doc_id] == [sha256(e.encode()).hexdigest() for e in edited]
    near = np.array([(got[i]["near_edited"], got[i]["near_next"]) for i in docs.doc_id])
    true = np.array([(similarity(a, e), similarity(a, b)) for a, e, b in zip(texts, edited, after)])
    assert np.abs((near - true).mean(axis=0)).max() < 0.02 and np.abs(near - true).max() < 0.3


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have none
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assign = re.compile(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    got = {r["doc_id"]: r for r in E.queries()["op10_secret_automaton"](spark, sf).collect()}
    seen = 0
    for i, text in zip(docs.doc_id, docs.text):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert tuple(got[i])[1:5] == (*[sum(k == r for _, k, _ in spans) for r in range(3)], sha256(line.encode()).hexdigest())
        assert set(line.split(",")) - {""} <= set(got[i]["spans"].split(","))
        seen += len(spans)
    assert seen


def test_weak_labels_on_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = E.queries()["op7_weak_label_quality"](spark, "/root/testdata/sf0.01")
    both = scored.join(labels, "doc_id").toPandas()
    assert (both.kept == (both.quality == 1)).mean() > 0.9
    assert both[both.quality == 1].kept.mean() > 0.97


def test_surrogates_leave_no_entity(spark, fixture_docs):
    seen = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)|\d+\.\d+\.\d+\.\d+")
    got = rows(spark, "op1_pii_surrogates")
    pairs: dict[str, str] = {}
    for i, text in zip(fixture_docs.doc_id, fixture_docs.text):
        old, new = seen.findall(text), seen.findall(got[i]["text"])
        assert len(old) == len(new) == got[i]["n_entities"]
        assert re.sub(seen, "", text) == re.sub(seen, "", got[i]["text"])
        for a, b in zip(old, new):
            assert a != b and pairs.setdefault(a, b) == b
    assert pairs and len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
