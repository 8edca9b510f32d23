import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelaudit.operators import classifier as L, features as X, profile as P


def frame(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype("int32")
    x = rng.normal(size=(n, 4)) + 1.5 * y[:, None]
    df = spark.createDataFrame(
        pd.DataFrame({"row_id": np.arange(n), "label": y, "x": x.tolist()}), "row_id long, label int, x array<double>"
    )
    return L.as_features(df, "x"), x, y


def newton(x, y, c=1.0, w=None):
    """Reference fit: summed loss * c + half the squared weights, free intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y)) if w is None else w
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        grad = c * a.T @ (w * (p - y)) + penalty @ b
        hess = c * (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        b -= np.linalg.solve(hess, grad)
    return b


def test_penalty_matches_a_summed_loss(spark):
    df, x, y = frame(spark)
    model = L.fit_classifier(df)
    assert np.append(model.coefficients.toArray(), model.intercept) == pytest.approx(newton(x, y), abs=1e-3)


def test_balanced_weights_keep_the_penalty(spark):
    """Balanced weights add up to the number of rows, so the same penalty applies."""
    df, x, y = frame(spark)
    weights = P.class_weights(df)
    w = {r.label: r.weight for r in weights.collect()}
    model = L.fit_classifier(df, weights=weights)
    want = newton(x, y, w=np.array([w[int(v)] for v in y]))
    assert np.append(model.coefficients.toArray(), model.intercept) == pytest.approx(want, abs=1e-3)


def test_out_of_fold_scores_everyone_once(spark):
    df, x, y = frame(spark)
    rows = L.out_of_fold(df).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(240))
    fold = np.array([r.fold for r in rows])
    p = np.array([r.p[1] for r in rows])
    held = fold == 2
    b = newton(x[~held], y[~held])
    want = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(240)]) @ b)[held]))
    assert p[held] == pytest.approx(want, abs=1e-3)


def test_grid_isolates_failures(spark):
    df, _, _ = frame(spark)
    train, val = df.where("row_id < 180"), df.where("row_id >= 180")

    def run(train_, val_, params, label, weights):
        if params["c"] < 0:
            raise ValueError("c must be positive")
        return L.run_trial(train_, val_, params, label, weights)

    trials = L.grid_search(train, val, [{"c": 1.0}, {"c": -1.0}, {"c": 0.01}], run=run)
    rows = {r.trial: r for r in trials.collect()}
    assert np.isnan(rows[2].f1) and "positive" in rows[2].error
    assert rows[1].error is None and rows[1].f1 > 0.5
    models, table = L.refit_top(trials, train, val, 2)
    assert len(models) == 2 and table.count() == 2


def test_foreign_model(spark):
    def make():
        def predict(texts):
            n = np.array([len(t) for t in texts], dtype="float32")
            p = n / (n + 1)
            return np.column_stack([1 - p, p])

        return predict

    df = spark.createDataFrame([(1, "abc"), (2, None)], "row_id int, text string")
    got = {r.row_id: round(r.probability, 4) for r in L.score_foreign(df, make, "text", batch_size=1).collect()}
    assert got == {1: 0.75, 2: 0.0}


TEXTS = [(1, "B a\na  c"), (2, "a b"), (3, ""), (4, None), (5, " ".join(["a"] * 600))]


def test_tokens_and_vocabulary(spark):
    df = spark.createDataFrame(TEXTS, "row_id int, content string")
    got = {r.row_id: r.t for r in df.select("row_id", X.tokens("content").alias("t")).collect()}
    assert got[1] == ["b", "a", "a", "c"] and got[3] == [] and got[4] == []
    vocab = [tuple(r) for r in X.build_vocab(df, "content", 2).orderBy("token_id").collect()]
    assert vocab == [("a", 2, 603), ("b", 3, 2)]
    with pytest.raises(ValueError):
        X.build_vocab(df, "content", 0)


def test_encoding_has_fixed_length(spark):
    df = spark.createDataFrame(TEXTS, "row_id int, content string")
    rows = {r.row_id: r for r in X.encode(df, "content", X.build_vocab(df, "content", 2), 8).collect()}
    assert rows[1].ids == [3, 2, 2, 1, 0, 0, 0, 0] and rows[1]["mask"] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert rows[4].ids == [0] * 8 and sum(rows[4]["mask"]) == 0
    assert rows[5].ids == [2] * 8 and rows[5].n_tokens == 600


def test_mean_pool_counts_the_whole_text(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "z"), (3, "b " * 600 + "a")], "row_id int, content string")
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0])], "token string, v array<double>")
    got = {r.row_id: r.vector for r in X.mean_pool(df, "content", vectors, 2).collect()}
    assert got[1] == [1.0, 2.0] and got[2] is None and got[3][0] == pytest.approx(3 / 601)
    first = X.mean_pool(df, "content", vectors, 2, max_len=1).collect()
    assert {r.row_id: r.vector for r in first} == {1: [3.0, 0.0], 2: None, 3: [0.0, 3.0]}
    slots = spark.createDataFrame([(0, [1.0]), (1, [5.0])], "token int, v array<double>")
    by_slot = X.mean_pool(df, "content", slots, 1, key=lambda t: F.when(t == "b", 1).otherwise(0)).collect()
    assert {r.row_id: r.vector[0] for r in by_slot} == pytest.approx({1: 11 / 3, 2: 1.0, 3: 3001 / 601})


def test_weights_of_another_table_keep_the_penalty(spark):
    """The penalty follows the weights that the rows have, not their number."""
    df, x, y = frame(spark)
    weights = spark.createDataFrame([(0, 2.0), (1, 7.0)], "label int, weight double")
    model = L.fit_classifier(df, weights=weights)
    want = newton(x, y, w=np.where(y == 1, 7.0, 2.0))
    assert np.append(model.coefficients.toArray(), model.intercept) == pytest.approx(want, abs=1e-3)
    with pytest.raises(Exception, match="no weight"):
        L.fit_classifier(df, weights=weights.where("label = 0"))


def test_text_features_and_word_vectors(spark):
    df = spark.createDataFrame(TEXTS, "row_id int, content string")
    model = X.fit_text_features(df, "content", 64)
    assert X.text_features(df, model, "content").count() == 5
    vectors = X.fit_word_vectors(df, "content", dim=4, min_count=1)
    assert vectors.where(F.size("v") == 4).count() == 3


@pytest.mark.parametrize("by", ["token", "slot"])
def test_mean_pool_in_blocks_equals_the_join(spark, monkeypatch, by):
    """More vectors than a task holds: texts move with their counts, never beside a vector for each token."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{j}" for j in rng.integers(0, 60, i % 40))) for i in range(80)] + [(90, None), (91, "zz"), (90, "w1")]
    df = spark.createDataFrame(texts, "row_id long, content string")
    name = (lambda i: f"w{i}") if by == "token" else (lambda i: i)
    vectors = [(name(i), rng.normal(size=3).tolist()) for i in range(50)] + [(name(7), [1.0, 2.0, 3.0]), (name(8), None)]
    vectors = spark.createDataFrame(vectors, f"token {'string' if by == 'token' else 'long'}, v array<double>")
    key = {} if by == "token" else {"key": lambda t: F.regexp_extract(t, "([0-9]+)", 1).try_cast("bigint")}
    want = {r.row_id: r.vector for r in X.mean_pool(df, "content", vectors, 3, **key).collect()}
    for constant, value in {"POOL": 1, "BLOCK": 40, "TEAM": 100, "_SOME": 16}.items():
        monkeypatch.setattr(X, constant, value)
    pooled = X.mean_pool(df, "content", vectors, 3, **key)
    got = {r.row_id: r.vector for r in pooled.collect()}
    assert "FlatMapCoGroupsInArrow" in pooled._jdf.queryExecution().toString()
    assert got.keys() == want.keys() and got[91] is None
    for row, vector in want.items():
        assert (vector is None) == (got[row] is None) and (vector is None or np.allclose(vector, got[row], atol=1e-12))
    odd = vectors.union(spark.createDataFrame([(name(9), [1.0, None, 2.0])], vectors.schema))
    assert "FlatMapCoGroupsInArrow" not in X.mean_pool(df, "content", odd, 3, **key)._jdf.queryExecution().toString()


def test_features_are_not_brought_together_by_class(spark, monkeypatch):
    """Two classes would be two tasks, each with half of all features."""
    df, _, _ = frame(spark)
    seen, fit = [], L.LogisticRegression.fit
    monkeypatch.setattr(L.LogisticRegression, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sizes were not known to be small
    try:
        L.fit_classifier(df, weights=P.class_weights(df), max_iter=3)
        assert "SortMergeJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_classifier_scores_fits_until_it_converges(spark, tmp_path, monkeypatch):
    """The fit was cut off after 100 iterations; 399 labelled texts of the given tables take 237."""
    from labelaudit.plans import models as M

    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{j}" for j in rng.integers(0, 400, 30))) for i in range(240)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(rng.random() < 0.3), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, fit = [], L.LogisticRegression.fit

    def spy(self, rows):
        seen.append(fit(self, rows))
        return seen[-1]

    monkeypatch.setattr(L.LogisticRegression, "fit", spy)
    assert M.classifier_scores(spark, str(tmp_path)).count() == 240
    assert [m.getMaxIter() for m in seen] == [1000] and seen[0].summary.totalIterations < 1000


def test_mean_pool_moves_neither_texts_nor_tokens(spark, monkeypatch):
    """Only a sum for each text is shuffled; vectors come in pieces, texts in cuts, and ids come again or are missing."""
    for constant, value in {"PIECE": 30, "WORDS": 7}.items():
        monkeypatch.setattr(X, constant, value)
    texts = [(1, "a b a"), (2, "c zz"), (1, "c"), (None, "a"), (3, None), (4, "zz"), (None, "b " * 20), (5, "a b c d e f " * 9)]
    df = spark.createDataFrame(texts, "row_id long, content string")
    given = {t: [float(i), 1.0, -i * 0.5] for i, t in enumerate("abcdefghijklmnopqrst")}
    rows = [*given.items(), ("b", [4.0, 0.0, 0.0]), ("g", None), (None, [9.0, 9.0, 9.0])]
    pooled = X.mean_pool(df, "content", spark.createDataFrame(rows, "token string, v array<float>"), 3)
    plan = pooled._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = {r.row_id: r.vector for r in pooled.collect()}
    want = {}
    for row, text in texts:
        want.setdefault(row, []).extend(v for t in (text or "").split() for k, v in rows if k == t and v)
    assert got.keys() == want.keys()
    for row, vectors in want.items():
        assert got[row] is None if not vectors else np.allclose(got[row], np.mean(vectors, axis=0), atol=1e-12)
