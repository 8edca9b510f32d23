"""Every query against its SQL on the smallest tables, and the shape of every plan."""

import sys

import pytest

import __spark_entry__ as E
from check import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["term", "rate_before", "rate_after"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def whole_plans(monkeypatch):
    """Tables written between steps become steps of one plan, so that all of it is seen."""
    from labelaudit.operators import confident, metrics, neighbours, ordering  # noqa: F401

    for module in [m for n, m in sys.modules.items() if n.startswith("labelaudit.") and "labelaudit.llm" not in n]:
        if hasattr(module, "settle"):
            monkeypatch.setattr(module, "settle", lambda df: df)
        if hasattr(module, "store"):
            monkeypatch.setattr(module, "store", lambda df, name: df)


# Queries that fit models or run streams; their plans are those of MLlib and of the sink.
FITTED = {"classifier_scores", "oof_scores", "oof_label_issues", "grid_trials", "grid_refit", "score_benchmark", "external_report",
          "external_support", "cluster_performance", "before_after_correction", "fit_mean_probability", "oof_folds",
          "fold_mean_probability", "grid_settings", "review_stream"}
# Queries that go on in rounds until nothing changes: as steps of one plan they would never end.
FITTED |= {"near_duplicate_components", "near_dup_text_kept", "shingle_components", "density_groups"}


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in FITTED and not n.startswith("op") and n != "pipeline"))
def test_whole_plan(spark, whole_plans, name):
    text = plan(E.queries()[name](spark, SF))
    assert "FileScan parquet" in text or name in WRITTEN
    for bad in ("CartesianProduct", "BatchEvalPython"):
        assert bad not in text
    if name not in BOUNDED_PRODUCTS:
        assert "BroadcastNestedLoopJoin" not in text


# Results that are files or lists made before: what is read back is not the given table.
WRITTEN = {"csv_round_trip", "csv_in_ranges", "ledger_from_nothing", "ledger_compacted", "training_log_round_trip", "param_grid"}
# A single row (a median, a total) or a list of k rows beside a table.
BOUNDED_PRODUCTS: set[str] = set()


def test_split_filter_reaches_the_scan(spark):
    text = plan(E.queries()["scan_split"](spark, SF))
    assert "EqualTo(lang,fr)" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in text


def test_equality_filter_reaches_the_scan(spark):
    assert "EqualTo(lang,en)" in plan(E.queries()["filter_by_value"](spark, SF))


def test_label_shares_do_not_read_texts(spark):
    assert "text:string" not in plan(E.queries()["label_shares"](spark, SF))


def test_dedupe_keeps_texts_out_of_the_grouping(spark):
    text = plan(E.queries()["dedupe_keep_first"](spark, SF))
    assert "hashpartitioning(content" not in text and "hashpartitioning(text" not in text


def test_no_wide_row_moves_by_its_text(spark, whole_plans):
    for name in ("duplicate_members", "apply_corrections", "exclude_unreviewed", "review_pending"):
        text = plan(E.queries()[name](spark, SF))
        assert "hashpartitioning(content" not in text and "hashpartitioning(text" not in text
