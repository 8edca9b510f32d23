"""Snapshots of the ledger against the ledger itself, also after a crash."""

import datetime as dt
import random

import pytest

from labelaudit.operators import ledger as G, review as W
from labelaudit.sources.schemas import REVIEWED


def decisions(spark, seed, n=60):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        values = {"text": rng.choice([None, *(f"text {i}" for i in range(25))]), "given_label": 0, "suggested_label": 1,
                  "final_label": rng.randrange(2), "review_date": start + dt.timedelta(minutes=rng.randrange(50))}
        rows.append(tuple(values.get(f.name) for f in REVIEWED))
    return spark.createDataFrame(rows, REVIEWED)


def latest(df):
    return {tuple(r) for r in W.latest_decisions(df).collect()}


def test_snapshots_and_tail_equal_the_ledger(spark, tmp_path, monkeypatch):
    ledger, root = str(tmp_path / "ledger"), str(tmp_path / "compacted")
    assert G.newest_decisions(spark, ledger, root).collect() == []
    for step in range(4):
        W.append_decisions(decisions(spark, step), ledger)
        whole = latest(W.read_ledger(spark, ledger))
        assert latest(G.newest_decisions(spark, ledger, root)) == whole
        if step == 1:
            assert G.compact(spark, ledger, root) == 1
            assert latest(G.newest_decisions(spark, ledger, root)) == whole
        if step == 2:  # the program ends between the snapshot and the switch
            with monkeypatch.context() as m:
                m.setattr(G, "switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
                with pytest.raises(KeyboardInterrupt):
                    G.compact(spark, ledger, root)
            assert G.current(spark, root)[0] == 1 and latest(G.newest_decisions(spark, ledger, root)) == whole
    assert G.compact(spark, ledger, root) == 2
    version, snapshot, folded = G.current(spark, root)
    assert len(folded) == len(W.read_ledger(spark, ledger).inputFiles())
    kept = spark.read.parquet(f"{root}/{snapshot}")
    assert kept.count() == kept.select("text").distinct().count() and latest(kept) == whole


def test_two_at_once(spark, tmp_path):
    """Both fold the same files; whoever switches last counts, and nothing is counted twice or lost."""
    ledger, root = str(tmp_path / "ledger"), str(tmp_path / "compacted")
    W.append_decisions(decisions(spark, 7), ledger)
    version, files, rows = G._parts(spark, ledger, root)
    G.newest_per_text(rows).write.parquet(f"{root}/snapshots/1-slow")
    W.append_decisions(decisions(spark, 8), ledger)
    G.compact(spark, ledger, root)
    G.switch(spark, root, version + 1, "snapshots/1-slow", files)
    assert latest(G.newest_decisions(spark, ledger, root)) == latest(W.read_ledger(spark, ledger))
