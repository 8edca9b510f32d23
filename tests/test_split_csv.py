"""CSV read by byte ranges against the reader that takes a file whole."""

import random

import pytest

from labelaudit.sources import split_csv as S
from labelaudit.sources.tables import read_csv

SCHEMA = "id long, text string, label int"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


@pytest.fixture
def ranges(spark):
    """Byte ranges of 4 KB."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def field(rng):
    text = "".join(rng.choices(["word", " ", ",", '"', '""', "\n", "\n\n", "é", "1,2\n3"], k=rng.choice([0, 3, 10, 40])))
    return text * rng.choice([1, 1, 1, 60])


def write(path, rows, end="\n"):
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    lines = ["id,text,label"] + [f"{i},{quoted(t)},{i % 2}" for i, t in rows]
    path.write_bytes((end.join(lines) + end).encode())


def test_records_across_ranges(spark, tmp_path, ranges):
    """Fields of many lines, some longer than a range or two; several files."""
    rng = random.Random(1)
    rows = [(i, field(rng)) for i in range(600)] + [(600, "a\n" * 9000), (601, 'q""\n' * 4000), (602, "end")]
    write(tmp_path / "a.csv", rows[:400])
    write(tmp_path / "b.csv", rows[400:])
    got = S.read_csv_parallel(spark, str(tmp_path), schema(spark))
    assert S._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 20
    back = {r["id"]: (r["text"] or "", r["label"]) for r in got.collect()}
    assert back == {i: (t, i % 2) for i, t in rows}
    whole = read_csv(spark, str(tmp_path), schema(spark))
    assert got.exceptAll(whole).count() == whole.exceptAll(got).count() == 0


def test_carriage_returns_and_a_byte_order_mark(spark, tmp_path, ranges):
    write(tmp_path / "a.csv", [(1, "one\r\ntwo"), (2, "x")], "\r\n")
    raw = (tmp_path / "a.csv").read_bytes()
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + raw + b"\r\n\r\n")
    got = sorted(tuple(r) for r in S.read_csv_parallel(spark, str(tmp_path / "a.csv"), schema(spark)).collect())
    assert [(i, label) for i, _, label in got] == [(1, 1), (2, 0)] and got[1][1] == "x" and got[0][1].startswith("one")


def test_wrong_headers_and_records_stop_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,label,text\n1,1,x\n")
    with pytest.raises(Exception, match="header|not a number|MALFORMED"):
        S.read_csv_parallel(spark, str(tmp_path / "a.csv"), schema(spark)).collect()
    (tmp_path / "b.csv").write_text("id,text,label\nnot a number,x,1\n")
    with pytest.raises(Exception, match="header|not a number|MALFORMED"):
        S.read_csv_parallel(spark, str(tmp_path / "b.csv"), schema(spark)).collect()
    (tmp_path / "c.csv").write_text("id,text,label\n")
    assert S.read_csv_parallel(spark, str(tmp_path / "c.csv"), schema(spark)).collect() == []
