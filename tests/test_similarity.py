"""Approximate search, the set join and density groups against plain Python."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelaudit.operators import density as D, lsh as L, neighbours as N, setjoin as S

# --- approximate neighbours ------------------------------------------------------------------


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "row_id long, v array<double>").repartition(3)


def brute(ids, x, k):
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = np.round(np.maximum(1 - units @ units.T, 0), 9)
    return {int(i): [j for _, j in sorted((a, int(o)) for a, o in zip(row, ids) if o != i)][:k] for i, row in zip(ids, away)}


def found(df):
    out = {}
    for r in df.orderBy("row_id", "place").collect():
        out.setdefault(r.row_id, []).append(r.other)
    return out


def recall(got, want):
    return sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


def test_recall_of_a_fitted_index(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 12)), 20, axis=0) + 0.4 * rng.normal(size=(600, 12))
    ids = rng.permutation(2000)[:600]
    df = frame(spark, ids, x)
    index = L.build(df, "v", k=5, tables=3, bits=6, block=64)
    probes = L.fit_probes(index, df, "v", sample=100)
    assert 1 <= probes < 64
    assert recall(found(L.search(index, df, "v", 5, probes=probes)), brute(ids, x, 5)) >= 0.9


def test_all_buckets_give_exact_answers(spark):
    """Copies of a vector, multiples of it, unusable vectors, blocks smaller than a bucket, queries from outside."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    x[:30] = x[0] * np.arange(1, 31)[:, None]
    ids = rng.permutation(500)[:120]
    df = frame(spark, ids, x)
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 4), (902, [float("nan")] * 4)], df.schema)
    index = L.build(df.union(odd), "v", k=6, tables=2, bits=3, block=16)
    want = brute(ids, x, 6)
    got = found(L.search(index, df, "v", 6, probes=8, tables=1))
    assert got == want
    some = [int(i) for i in ids if i % 5 == 0]
    asked = df.where("row_id % 5 = 0").withColumn("row_id", F.col("row_id") + 10_000)
    outside = found(L.search(index, asked, "v", 1, probes=8))
    assert {i - 10_000: o for i, [o] in outside.items()} == {i: min([i, *(j for j in want[i] if j in ids[:30])]) if i in ids[:30] else i for i in some}
    with pytest.raises(ValueError):
        L.search(index, df, "v", 7)


def test_an_index_of_nothing(spark):
    none = frame(spark, [], np.empty((0, 3)))
    assert L.build(none, "v") is None and L.approximate_knn(none, "v").collect() == []
    with pytest.raises(ValueError):
        N.knn(none, "v", mode="other")


def test_probes_come_in_order_of_the_planes_crossed():
    planes = np.eye(3)
    order = L._probes(np.array([[0.1, -0.5, 0.3]]), planes, 8)[0].tolist()
    assert order == [0b101, 0b100, 0b001, 0b000, 0b111, 0b110, 0b011, 0b010]


# --- similar sets ------------------------------------------------------------------------------


def sets_of(texts, width):
    out = {}
    for i, text in texts.items():
        words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
        out[i] = {tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))} if words else set()
    return out


def similar(texts, width, threshold):
    sets = {i: s for i, s in sets_of(texts, width).items()}
    first = {i: min(j for j, t in sets.items() if t == s) if s else i for i, s in sets.items()}
    heads = [i for i in sorted(sets) if first[i] == i and sets[i]]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(heads, 2)}
    return {p: round(v, 9) for p, v in alike.items() if v + 1e-9 >= threshold}, first


def made_up(seed, n=120):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(12)]
    common = [f"licence{i}" for i in range(25)]
    texts = {0: None, 1: "", 2: " \n ", 3: "One", 4: "one", 5: "two words", 6: "two words\n"}
    for i in range(7, n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(5))
        texts[i] = " ".join(words + (common if i % 3 == 0 else []))
    return texts


@pytest.mark.parametrize("width, threshold, part", [(5, 0.8, 2048), (3, 0.7, 4), (1, 0.5, 7), (2, 1.0, 3)])
def test_pairs_of_made_up_texts(spark, width, threshold, part):
    """A line that a third of all texts have, in parts of a few rows; near copies in groups; equal sets."""
    texts = made_up(width)
    df = spark.createDataFrame(list(texts.items()), "row_id long, t string").repartition(3)
    pairs, members = S.similar_texts(df, "t", width=width, threshold=threshold, part=part)
    want, first = similar(texts, width, threshold)
    assert {(r.row_id, r.other): round(r.similarity, 9) for r in pairs.collect()} == want and (want or threshold == 1.0)
    assert {r.row_id: r.first for r in members.collect()} == first


def test_components_and_links_of_texts(spark):
    texts = made_up(9, 60)
    df = spark.createDataFrame(list(texts.items()), "row_id long, t string")
    want, first = similar(texts, 3, 0.6)
    root = {i: i for i in texts}
    for _ in texts:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.row_id: (r.first, r.n_links, r.component) for r in S.similar_components(*S.similar_texts(df, "t", width=3, threshold=0.6)).collect()}
    assert got == {i: (f, sum(f in p for p in want), root[f]) for i, f in first.items()}


def test_similar_texts_of_nothing(spark):
    none = spark.createDataFrame([(1, ""), (2, None)], "row_id long, t string")
    pairs, members = S.similar_texts(none, "t")
    assert pairs.collect() == [] and {tuple(r) for r in members.collect()} == {(1, 1), (2, 2)}
    assert S.similar_texts(none.where("row_id > 2"), "t")[1].collect() == []
    with pytest.raises(ValueError):
        S.pairs(members, threshold=0)


def test_sets_of_texts_stay_where_they_are(spark):
    """What is shuffled is a small multiple of the sets: prefixes and buckets, and only the sets that are in a pair."""
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))) for i in range(400)]
    df = spark.createDataFrame(texts + [(500, texts[0][1] + " end"), (501, texts[1][1])], "row_id long, t string").repartition(3)
    folders = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data")}
    before = files()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, members = S.similar_texts(df, "t")
        assert [(r.row_id, r.other) for r in pairs.collect()] == [(0, 500)]
        assert {r.row_id: r.first for r in members.collect() if r.row_id > 400} == {500: 500, 501: 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(n for f, n in files().items() if f not in before)
    assert moved < 3 * 8 * 500 * 400, moved


@pytest.mark.parametrize("room, buckets, part", [(2, 1 << 10, 4), (3, 2, 2048), (512, 64, 5)])
def test_pairs_in_small_rooms_and_few_buckets(spark, room, buckets, part):
    """Homes split into rooms, all shingles in full buckets, sets whose row is not among those that take part."""
    texts = made_up(3)
    df = spark.createDataFrame(list(texts.items()), "row_id long, t string").repartition(3)
    sets, firsts, _ = S.distinct_sets(df, "t", width=3)
    got = S.pairs(sets, 0.7, part, firsts, room, buckets).collect()
    assert {(r.row_id, r.other): round(r.similarity, 9) for r in got} == similar(texts, 3, 0.7)[0]
    assert len(got) == len({(r.row_id, r.other) for r in got})


# --- density and order -------------------------------------------------------------------------


def test_spanning_forest_is_the_lightest(spark):
    rng = random.Random(3)
    links = sorted({(a, b): round(rng.random(), 2) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(70)) if a < b}.items())
    part, want = {i: i for i in range(25)}, []
    for (a, b), d in sorted(links, key=lambda x: (x[1], x[0])):
        if part[a] != part[b]:
            want.append((a, b, d))
            old, new = part[b], part[a]
            part = {i: new if p == old else p for i, p in part.items()}
    table = spark.createDataFrame([(a, b, d) for (a, b), d in links], "row_id long, other long, distance double")
    assert sorted(tuple(r) for r in D.spanning_forest(table).collect()) == sorted(want)
    assert D.spanning_forest(table.limit(0)).collect() == []


def test_dense_groups_and_noise(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([[1, 0, 0] + 0.02 * rng.normal(size=(20, 3)), [0, 1, 0] + 0.02 * rng.normal(size=(20, 3)), [[0, 0, -1.0]]])
    got = {r.row_id: r.group for r in D.density_groups(N.knn(frame(spark, range(41), x), "v", 5), 5, 20.0).collect()}
    assert got[40] is None and len({got[i] for i in range(20)}) == len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[20]


def test_order_of_like_rows(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 6)), 10, axis=0) + 0.1 * rng.normal(size=(120, 6))
    df = frame(spark, range(120), x)
    near = N.knn(df, "v", 4)
    sorted_ = D.order_check(near, df, "row_id").first()
    mixed = D.order_check(near, df.withColumn("o", F.md5(F.col("row_id").cast("string"))), "o").first()
    assert sorted_["n"] == 480 and sorted_["p_value"] < 1e-6 < 0.01 < mixed["p_value"]
    assert tuple(D.order_check(near.limit(0), df, "row_id").first()) == (0, None, None)


def test_a_query_moves_once_for_each_hall_of_buckets(spark, monkeypatch):
    """Not once for each bucket: all 64 buckets are visited, in a few halls, and the answer is exact."""
    ids, x = np.arange(200), np.random.default_rng(4).normal(size=(200, 5))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "row_id long, v array<double>")
    monkeypatch.setattr(N, "HALL", 200)
    index = L.build(df, "v", k=3, tables=1, bits=6, block=1)
    assert 2 <= len(index.shares[0]) <= 6
    met = L._met(index, L._unit_rows(df, "v", "row_id", 5), 4, 64, 1)
    # at most k of each hall and query, where it was k of each bucket
    assert met.count() <= 200 * 4 * int(index.shares[0].sum())
    assert found(L.search(index, df, "v", 3, probes=64)) == brute(ids, x, 3)
