import pytest

from pyspark.sql import functions as F

from labelaudit.operators import assemble as A, profile as P

SCHEMA = "row_id long, content string, label int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(3, "a", 1), (1, "a", 0), (2, "b", None), (4, None, 1), (5, None, 0), (6, "a", 1)], SCHEMA
    )


def ids(df, column="row_id"):
    return sorted(r[column] for r in df.collect())


def test_dedupe_keeps_the_first_and_drops_missing(rows):
    assert ids(A.dedupe(rows, ["content"], "row_id")) == [1, 2]


def test_dedupe_twice_changes_nothing(rows):
    once = A.dedupe(rows, ["content"], "row_id")
    assert ids(A.dedupe(once, ["content"], "row_id")) == ids(once)


def test_duplicate_members(rows):
    assert ids(A.duplicate_members(rows, ["content"])) == [1, 3, 6]


def test_dedupe_on_two_columns(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 0)], SCHEMA)
    assert ids(A.dedupe(df, ["content", "label"], "row_id")) == [1, 3]


def test_report(rows, spark):
    assert tuple(A.dedupe_report(rows, ["content"]).first()) == (4, 2, 2)
    assert tuple(A.dedupe_report(spark.createDataFrame([], SCHEMA), ["content"]).first()) == (0, 0, 0)


def test_first_source_wins(spark):
    one = spark.createDataFrame([(9, "a", None)], SCHEMA)
    two = spark.createDataFrame([(1, "a", 0), (2, "c", 0)], SCHEMA).drop("label")
    got = A.assemble_and_dedupe([one, two]).orderBy("source_no", "row_id").collect()
    assert [(r.source_no, r.row_id, r.label) for r in got] == [(0, 9, 1), (1, 2, 1)]


def test_drop_missing(rows):
    assert ids(A.drop_missing(rows, ["content"], ["label", "lable"])) == [1, 3, 6]


def test_exclude_treats_missing_keys_as_equal(rows, spark):
    assert ids(A.exclude(rows, spark.createDataFrame([("a",)], "text string"), "content", "text")) == [2, 4, 5]
    with_null = spark.createDataFrame([("a",), (None,)], "text string")
    assert ids(A.exclude(rows, with_null, "content", "text")) == [2]


def test_uniqueness(rows):
    assert A.assert_unique(rows, ["row_id"]) is rows
    with pytest.raises(ValueError):
        A.assert_unique(rows, ["content"])


def test_counts_ignore_missing(rows):
    assert [tuple(r) for r in P.value_counts(rows, "content").collect()] == [("a", 3), ("b", 1)]
    shares = {r.content: r.share for r in P.value_shares(rows, "content").collect()}
    assert shares == {"a": 0.75, "b": 0.25}


def test_top_k_ties_go_by_value(spark):
    df = spark.createDataFrame([("z",), ("y",), ("x",), ("z",)], "c string")
    assert [r.c for r in P.top_k(df, "c", 2).collect()] == ["z", "x"]


def test_distinct_and_overlap(rows):
    got = {r.column_name: r.n_distinct for r in P.distinct_profile(rows, ["content", "label"]).collect()}
    assert got == {"content": 2, "label": 2}
    assert tuple(P.overlap_counts(rows, "content").first()) == (1, 1, 1, 0, 0)


def test_class_weights(spark):
    df = spark.range(4233).selectExpr("CASE WHEN id < 3231 THEN 0 ELSE 1 END AS label")
    got = {r.label: r.weight for r in P.class_weights(df).collect()}
    assert got == pytest.approx({0: 0.655060, 1: 2.112275}, abs=1e-6)


def test_widen_fills_zeros(spark):
    long = spark.createDataFrame([("r1", "a", 2), ("r2", "b", 3)], "r string, c string, n long")
    assert sorted(map(tuple, P.widen(long, "r", "c", ["a", "b"]).collect())) == [("r1", 2, 0), ("r2", 0, 3)]


def test_a_text_held_by_a_third_of_the_rows(spark):
    """Joins by text stay exact, with and without row ids, when one text is everywhere."""
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("content")
    )
    some = spark.createDataFrame([("same",), ("t1",)], "text string")
    assert ids(A.duplicate_members(df, ["content"])) == list(range(0, 3000, 3))
    want = [i for i in range(3000) if i % 3 and i != 1]
    assert ids(A.exclude(df, some, "content", "text")) == ids(A.exclude(df, some, "content", "text", "row_id")) == want
    assert ids(A.dedupe(df, ["content"], "row_id")) == [i for i in range(3000) if i % 3 or i == 0]
    plan = A.duplicate_members(df, ["content"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key_r" in plan or "_salt_r" in plan


def test_salted_join_repeats_only_keys_of_many_rows(spark, monkeypatch):
    """Every key was repeated 64 times, which a broadcast of a small table made 64 times its size."""
    from labelaudit.operators import assemble as A

    monkeypatch.setattr(A, "SLICE", 10)
    left = spark.createDataFrame([(i, "a" if i < 55 else f"k{i}") for i in range(70)] + [(70, None)], "row_id long, key string")
    right = spark.createDataFrame([("a", 1), ("k60", 2), ("k61", 3), (None, 4), ("gone", 5)], "key string, n long")
    joined = A.salted_join(left, right, "key", "row_id")
    assert {(r.row_id, r.n) for r in joined.collect()} == {(i, 1) for i in range(55)} | {(60, 2), (61, 3), (70, 4)}
    anti = A.salted_join(left, right, "key", "row_id", "left_anti")
    assert {r.row_id for r in anti.collect()} == {i for i in range(55, 70)} - {60, 61}
    sides = []
    frame = type(right)
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, *a, **b: sides.append(other) or join(self, other, *a, **b))
    A.salted_join(left, right, "key", "row_id")
    # 6 slices of "a", one of each other key
    assert sides[-1].count() == 6 + 4
