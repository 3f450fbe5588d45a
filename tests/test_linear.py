"""Many targets from one matrix of products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from checks.features import _history, _named
from checks.views import Views
from pacelake.operators import forecast as M, linear

SF = "/root/testdata/sf0.001"


def frame(spark, x, y, names, marked=None):
    rows = [([float(v) for v in a], *map(float, b), int(m)) for a, b, m in zip(x, y, marked if marked is not None else np.zeros(len(x)))]
    return spark.createDataFrame(rows, f"features array<double>, {', '.join(f'{n} double' for n in names)}, held_out int").repartition(5)


def random_rows(n=400, p=6, t=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, p))
    x[:, 1] = 4.0  # a constant feature
    return x, x @ rng.normal(0, 1, (p, t)) + rng.normal(0, 0.5, (n, t))


@pytest.mark.parametrize("block", [4, 256])
def test_matrix_of_products(spark, monkeypatch, block):
    monkeypatch.setattr(linear, "BLOCK", block)
    x, y = random_rows()
    marks = np.arange(400) % 4 == 0
    found = linear.grams(frame(spark, x, y, "abc", marks), list("abc"), part="held_out")
    z = np.hstack((np.ones((400, 1)), x, y))
    assert found.keys() == {0, 1}
    for part, gram in found.items():
        rows = z[marks == bool(part)]
        np.testing.assert_allclose(gram.products, rows.T @ rows, rtol=1e-10)


def test_as_separate_fits_of_all_encoded_targets(spark):
    v = Views(spark, SF)
    cfg = M.Config(window_rows=8, mode="asof")
    model = M.train(_history(v), _named(v), cfg)
    matrix = M.training_matrix(_history(v), _named(v), model.history_encoder, model.session_encoder, cfg).cache()
    targets = model.session_encoder.feature_columns
    assert len(targets) >= 20 and model.linear.targets == targets
    for target in [*targets[:4], *targets[-4:]]:
        fit = LinearRegression(solver="normal", regParam=1e-3).fit(matrix.select("features", F.col(f"`{target}`").alias("label")))
        at = targets.index(target)
        np.testing.assert_allclose(model.linear.coefficients[at], fit.coefficients.toArray(), rtol=1e-6, atol=1e-8)
        assert model.linear.intercepts[at] == pytest.approx(fit.intercept, abs=1e-7)


def test_heads_give_shares_and_hide_the_dropped_class(spark):
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 2, 300)
    x = rng.normal(0, 0.3, (300, 2)) + kind[:, None] * [2.0, -1.0]
    gram = linear.grams(frame(spark, x, kind[:, None], ["s_b"]), ["s_b"])[0]
    head = linear.softmax_head(gram, ["s_b"], ["s_b"], "s_a")
    assert head.targets == ["s_b"]
    shares = head.values(x)[:, 0]
    assert ((shares > 0.5) == (kind == 1)).mean() > 0.98 and shares.min() >= 0 and shares.max() <= 1


def test_rounds_stop_at_the_least_error(spark):
    x, y = random_rows(seed=9)
    marks = np.arange(400) % 5 == 0
    y[marks, 2] = 0.0  # held-out rows know nothing of the third target
    found = linear.grams(frame(spark, x, y, "abc", marks), list("abc"), part="held_out")
    model, rounds = linear.descend(found[0], found[1], list("abc"), rounds=60, patience=4)
    guess = model.values(x[marks])
    for k, name in enumerate("abc"):
        curve, best = rounds.errors[name], rounds.best[name]
        assert curve[best] == min(curve) and len(curve) - 1 <= min(60, best + 4)
        assert ((y[marks, k] - guess[:, k]) ** 2).mean() == pytest.approx(curve[best], rel=1e-8)
    assert rounds.best["a"] >= 1


def test_table_is_stored_and_models_come_in_one_pass(spark, tmp_path):
    x, y = random_rows()
    df = frame(spark, x, y, "abc")
    gram = linear.grams(df, list("abc"))[0]
    one = linear.joined(linear.ridge(gram, list("abc")), linear.LinearTargets(["h1", "h2"], np.zeros(2), np.eye(2, 6), [["h1", "h2"]], ["h2"]))
    one.save(str(tmp_path / "table"), spark)
    back = linear.LinearTargets.load(str(tmp_path / "table"), spark)
    assert (back.rows, back.heads, back.hidden) == (one.rows, one.heads, one.hidden)
    np.testing.assert_array_equal(back.values(x), one.values(x))
    other = linear.ridge(gram, list("abc"), 5.0)
    plan = linear.predict_each({"one": back, "other": other}, df.select("features", "a").withColumnRenamed("a", "truth"))
    rows = plan.collect()
    assert len(rows) == 800 and {r["model_name"] for r in rows} == {"one", "other"}
    assert all((r["h1"] is None) == (r["model_name"] == "other") and "h2" not in r for r in rows)


def test_refuses_too_many_columns_and_no_rows(spark, monkeypatch):
    x, y = random_rows(20)
    df = frame(spark, x, y, "abc")
    with pytest.raises(ValueError, match="no rows"):
        linear.grams(df.limit(0), ["a"])
    monkeypatch.setattr(linear, "MAX_COLUMNS", 5)
    with pytest.raises(ValueError, match="at most"):
        linear.grams(df, ["a"])


def test_training_options_of_the_job(spark, tmp_path):
    v = Views(spark, SF)
    cfg = M.Config(window_rows=4, mode="asof", softmax_heads=True, flat=True, rounds=6)
    model = M.train(_history(v), _named(v), cfg, hold_out=0.2)
    assert model.rounds is not None and set(model.rounds.best) == set(model.session_encoder.feature_columns)
    assert len(model.linear.heads) == 2 and model.linear.coefficients.shape[1] == 4 * len(model.history_encoder.feature_columns)
    model.save(str(tmp_path / "model"), spark)
    loaded = M.ForecastModel.load(str(tmp_path / "model"), spark)
    assert loaded.config == cfg and loaded.rounds == model.rounds
    both = M.predict_models({"a": model, "b": loaded}, _history(v), 2).collect()
    assert len(both) == 2 * len({(r["user_id"], r["days_back"]) for r in both})
    tagged = M.compare_models(M.per_model({"a": model}, _history(v)), _history(v), _named(v), 1)
    assert {r["source"] for r in tagged.collect()} == {"predictions", "reals"}
