import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import review as W
from labelaudit.sources.schemas import RAW_DECISIONS, REVIEWED
from labelaudit.streaming import decisions as D


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def decision(text, given, final, minute, notes=""):
    return (text, "c", given, 1 - given, final, at(minute), notes)


@pytest.fixture(scope="module")
def reviewed(spark):
    return spark.createDataFrame(
        [decision("a", 0, 1, 1), decision("a", 0, 0, 2), decision("b", 1, 0, 1, "Remove"), decision("c", 1, 1, 1, None)],
        REVIEWED,
    )


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [(1, "a", 1), (2, "a", None), (3, "b", 1), (4, "d", 0), (5, None, 1)], "row_id int, content string, label int"
    )


def test_latest_wins_and_rows_stay(corpus, reviewed):
    fixed = W.apply_corrections(corpus, reviewed)
    assert {r.row_id: r.label for r in fixed.collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    assert fixed.columns == corpus.columns


def test_usable_notes(reviewed):
    assert sorted({r.text for r in W.usable(reviewed).collect()}) == ["a", "c"]


def suspects(spark):
    return spark.createDataFrame([("a", 0, 0.9), ("d", 0, 0.4), ("e", 1, 0.6)], "text string, given_label int, label_score double")


def test_queue_and_statistics(spark, reviewed):
    s = suspects(spark)
    assert sorted(r.text for r in W.pending(s, reviewed).collect()) == ["d", "e"]
    assert [r.text for r in W.next_batch(s, reviewed, [F.desc("label_score")], 1).collect()] == ["e"]
    assert tuple(W.review_stats(s, reviewed).first()) == (4, 2, 50.0, 2)
    empty = spark.createDataFrame([], REVIEWED)
    assert tuple(W.review_stats(s, empty).first()) == (0, 0, None, 3)


def test_corrected_corpus(spark, corpus, reviewed):
    near = spark.createDataFrame([("zzz",)], "text string")
    got = W.corrected_corpus(corpus, reviewed, suspects(spark), near)
    # d is an open suspect; the decision on b was taken back
    assert {r.row_id: r.label for r in got.collect()} == {1: 0, 2: 0, 3: 1, 5: 1}


RAW = [
    ("a", "c", 0, 1, "Y ", "1", " ok ", at(1)),
    ("b", "c", 0, 1, "n", "1", "", at(2)),
    ("c", "c", 0, 1, "y", "7", "", at(3)),
    ("d", "c", 0, 1, "maybe", "1", "", at(4)),
    ("e", "c", 0, 1, None, "1", "", at(5)),
    ("f", "c", 0, 1, "y", None, "", at(6)),
]


def test_conform_decisions(spark):
    good, bad = W.conform_decisions(spark.createDataFrame(RAW, RAW_DECISIONS))
    assert [(r.text, r.final_label, r.reviewer_notes) for r in good.orderBy("text").collect()] == [("a", 1, "ok"), ("b", 0, "")]
    assert {r.text: r.reason for r in bad.collect()} == {
        "c": "new label is not 0 or 1", "d": "answer is not y or n", "e": "answer is not y or n", "f": "new label is not 0 or 1",
    }


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert W.read_ledger(spark, path).count() == 0
    good, _ = W.conform_decisions(spark.createDataFrame(RAW, RAW_DECISIONS))
    W.append_decisions(good, path)
    W.append_decisions(good, path)
    assert W.read_ledger(spark, path).count() == 4
    assert W.latest_decisions(W.read_ledger(spark, path)).count() == 2


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_stream_equals_batch(spark, tmp_path, delay):
    inbox, ledger = str(tmp_path / "inbox"), str(tmp_path / "ledger")
    folders = (str(tmp_path / "rejects"), str(tmp_path / "progress"))
    later = [("a", "c", 0, 1, "y", "0", "", at(9)), RAW[1]]  # a new decision and a repeat
    batches = [RAW, later]
    for rows in batches:
        spark.createDataFrame(rows, RAW_DECISIONS).coalesce(1).write.mode("append").parquet(inbox)
        D.stream_decisions(spark, inbox, ledger, *folders, delay=delay, files_per_batch=1).awaitTermination()
    streamed = D.read_streamed_ledger(spark, ledger)
    good, _ = W.conform_decisions(spark.createDataFrame(RAW + later, RAW_DECISIONS))
    want = sorted(map(tuple, W.latest_decisions(good).collect()))
    assert sorted(map(tuple, W.latest_decisions(streamed).collect())) == want
    assert streamed.count() == (4 if delay is None else 3)
    assert spark.read.parquet(folders[0]).count() == 4
    # a new progress folder reads the inbox again and touches nothing that is there
    again = str(tmp_path / "progress2")
    D.stream_decisions(spark, inbox, ledger, folders[0], again, files_per_batch=1).awaitTermination()
    assert D.read_streamed_ledger(spark, ledger).count() == streamed.count() + 4
    assert sorted(map(tuple, W.latest_decisions(D.read_streamed_ledger(spark, ledger)).collect())) == want
