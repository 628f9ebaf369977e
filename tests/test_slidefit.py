import datetime as dt

import numpy as np
import pytest
from conftest import T0

from hazegrid.operators import folds as FO
from hazegrid.operators import slidefit as SF

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def panel(spark):
    """Series of unequal length, one without a name, with gaps in features and labels and one constant column."""
    rng = np.random.default_rng(7)
    rows = []
    for s, n in (("x", 190), ("y", 143), (None, 160), ("short", 40)):
        for i in range(n):
            a, b, c = rng.normal(100, 5), rng.normal(), rng.uniform(0, 1e4)
            y = 2 * a - 3 * b + 0.01 * c + rng.normal()
            rows.append((s, T0 + dt.timedelta(hours=i), a if rng.random() > 0.1 else None, b, c if rng.random() > 0.1 else float("nan"), 4.0,
                         y if rng.random() > 0.1 else None))
    return spark.createDataFrame(rows, "series_id string, ts timestamp, a double, b double, c double, flat double, y double")


def one_fit(rows):
    """Least squares of one fold, its gaps filled with its own means."""
    x = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in rows if r.y is not None])
    y = np.array([r.y for r in rows if r.y is not None])
    fills = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), fills, x)
    slope, *_ = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-9)
    return len(y), y.mean() - slope @ x.mean(axis=0), slope, fills


@pytest.mark.parametrize("train, test, step", [(60, 20, 20), (50, 30, 15), (64, 16, 7)])
@pytest.mark.parametrize("pooled", [True, False])
def test_equals_a_fit_per_fold(panel, train, test, step, pooled):
    groups = {}
    for r in FO.assign_folds(panel, train, test, step).where("split = 'train'").collect():
        groups.setdefault(r.fold if pooled else (r.series_id, r.fold), []).append(r)
    got = {r.fold if pooled else (r.series_id, r.fold): r for r in SF.linear_folds(panel, FEATURES, "y", train, test, step, pooled=pooled).collect()}
    assert set(got) == set(groups) and len(got) > 3
    for key, rows in groups.items():
        n, line, slope, fills = one_fit(rows)
        r = got[key]
        assert r.n == n
        assert np.allclose(r.coefficients, slope, atol=1e-6) and np.allclose(r.fills, fills, atol=1e-6) and r.intercept == pytest.approx(line, abs=1e-4)


def test_predictions_cover_every_fold_row(panel):
    preds = SF.linear_fold_predictions(panel, FEATURES, "y", 60, 20, 20)
    assert preds.count() == FO.assign_folds(panel, 60, 20, 20).count() == preds.where("yhat IS NOT NULL").count()
    assert preds.where("series_id IS NULL").count() > 0
    lines = {r.fold: r for r in SF.linear_folds(panel, FEATURES, "y", 60, 20, 20).collect()}
    rows = {(r.series_id, r.ts): r for r in panel.collect()}
    for p in preds.where("fold = 1").collect():
        r, line = rows[p.series_id, p.ts], lines[1]
        x = [f if v is None or v != v else v for v, f in zip((r.a, r.b, r.c, r.flat), line.fills)]
        assert p.yhat == pytest.approx(line.intercept + np.dot(line.coefficients, x), abs=1e-9)


def test_rows_are_shuffled_once_for_all_folds(panel, capsys):
    """Beside counting positions, moments are exchanged once by (series, number), then only folds are."""
    SF.linear_folds(panel, ["a", "b"], "y", 60, 20, 20).explain("simple")
    plan = capsys.readouterr().out
    moments = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "pos#" in line]
    assert len(moments) == 2 and sum("fold#" in line for line in moments) == 1


def test_no_fold_fits(panel):
    assert SF.linear_folds(panel, ["a"], "y", 5000, 10, 10).count() == 0
