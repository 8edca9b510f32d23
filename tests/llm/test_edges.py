"""Missing values, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelaudit.llm import bpe, chat, fertility, mixing, pii, secret_scan, simhash, suffix_dedup, weak_quality
from labelaudit.llm import weighted_sampling

WIDE = {
    "pii": lambda d: pii.replace(d, "k"),
    "mix": lambda d: mixing.mix(d, lambda t: mixing.cycled_weights(t, "source")),
    "simhash": simhash.dedupe,
    "suffix": suffix_dedup.remove_repeats,
    "fertility": fertility.keep_good,
    "redact": secret_scan.redact,
    "encode": bpe.encode,
    "round_trip": lambda d: bpe.decode(bpe.encode(d, ids="own"), ids="own", decoded="back"),
}
NARROW = {
    "fertility": lambda d: fertility.score(d, ["doc_id", "key"]),
    "scan": lambda d: secret_scan.digests(d, ["doc_id"]),
    "bpe": lambda d: bpe.digests(d, ["doc_id", "_text"]),
    "quality": lambda d: weak_quality.classify(d, ["doc_id"]),
    "sampling": weighted_sampling.compare_with_next,
    "simhash": lambda d: simhash.components(d, [F.col("doc_id")]),
}


@pytest.mark.parametrize("name", WIDE)
def test_columns_pass_through(odd, none, name):
    got = WIDE[name](odd)
    assert set(odd.columns) <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert 0 < len(got.collect()) <= 3 * odd.count()
    assert WIDE[name](none).collect() == []


@pytest.mark.parametrize("name", NARROW)
def test_a_row_per_row(odd, none, name):
    assert NARROW[name](odd).count() == odd.count()
    assert NARROW[name](none).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.where("doc_id IS NOT NULL").collect()}


def test_results_of_odd_rows(odd):
    got = by_id(fertility.score(odd, ["doc_id"]))
    assert got[1]["kept"] and not got[2]["kept"] and got[3]["n_words"] == 0 and got[7]["n_tokens"] > 0
    got = by_id(secret_scan.digests(odd, ["doc_id"]))
    assert got[8]["spans"] == "assign:11:34" and got[3]["spans"] == ""
    got = by_id(weak_quality.classify(odd, ["doc_id"]))
    assert got[1]["kept"] and got[2]["score"] == got[3]["score"] == 0.0
    got = by_id(suffix_dedup.remove_repeats(odd).select("doc_id", "n_bytes", "n_removed"))
    assert got[5]["n_removed"] == got[5]["n_bytes"] == got[1]["n_removed"] and got[3]["n_bytes"] == 0
    assert got[6]["n_removed"] == 3000  # its own windows overlap
    got = by_id(simhash.components(odd, [F.col("doc_id")]))
    assert got[5]["first"] == 1 and got[2]["first"] == got[3]["first"] == got[7]["first"] == 2 and got[2]["fp"] == 0


def test_one_row_of_each_group_stays(odd):
    left = simhash.dedupe(odd)
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 4, 6, 8, None} and left.count() == 6
    same = odd.where("doc_id = 5").drop("doc_id").withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.dedupe(same).count() == 1


def test_equal_rows_are_mixed_alike(odd):
    counted, names = mixing.copies(odd, None)
    got = {(r[names["doc_id"]], r["copies"]) for r in counted.where(f"{names['doc_id']} = 5").collect()}
    assert len(got) == 1
    assert all(r["copies"] <= 3 for r in counted.collect())


def test_a_single_document_follows_itself(spark):
    one = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    r = weighted_sampling.compare_with_next(one).first()
    assert (r["doc_id"], r["n_chars"], r["near_next"]) == (1, 5, 1.0)


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "x"),
            (2, None, None, "y"), (2, 0, "assistant", "z" * 100_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(1))
    back = {r["group"]: r for r in chat.read_back(chat.segments(chat.canonical_turns(chat.row_records(table)))).collect()}
    assert [back[g]["n_turns"] for g in ("1", "2", None)] == [3, 2, 1]
    assert back["2"]["loss_chars"] == 100_000 and back["1"]["loss_chars"] == 0
    assert chat.read_back(chat.segments(chat.canonical_turns(chat.row_records(table.where("turn > 9"))))).collect() == []


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
                docs = spark.createDataFrame(got.collect(), docs.schema)
            else:
                assert all(r["round_trip"] for r in got.collect())
