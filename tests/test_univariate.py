"""A description of columns reads its input once, and its moments, quantiles and shares are those of all rows."""

import math

import numpy as np
import pytest

from riskpanel.operators import quality


def test_numbers_are_described_in_one_read(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(3, 2, 2000), 1)
    rows = [(float(v), 4.0, None if i % 5 else float(i % 3 - 1), None if i else 7.0) for i, v in enumerate(x)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "x double, flat double, few double, one double").repartition(3)
    out = {w.column_name: w for w in quality.describe_numeric(df.mapInArrow(counted, df.schema), ["x", "flat", "few", "one"]).collect()}
    assert reads.value == 2000
    z = (x - x.mean()) / x.std(ddof=1)
    w = out["x"]
    assert (w.n, w.integral) == (2000, False) and w.mean == pytest.approx(x.mean(), abs=1e-9) and w.sd == pytest.approx(x.std(ddof=1), abs=1e-6)
    assert w.skew == pytest.approx((z**3).mean(), abs=1e-5) and w.kurtosis == pytest.approx((z**4).mean() - 3, abs=1e-5)
    assert w.mad == pytest.approx(np.median(abs(x - np.median(x))), abs=1e-6) and w.tail_ratio == pytest.approx(np.quantile(x, 0.99) / np.median(x), abs=1e-6)
    assert w.mode_share == pytest.approx(np.unique(x, return_counts=True)[1].max() / 2000, abs=1e-6)
    assert (w.zero_pct, w.negative_pct) == (pytest.approx(100 * (x == 0).mean()), pytest.approx(100 * (x < 0).mean()))
    few = np.array([i % 3 - 1 for i in range(0, 2000, 5)])
    assert out["few"].n == 400 and out["few"].integral and out["few"].negative_pct == pytest.approx(100 * (few < 0).mean(), abs=1e-6) and out["few"].tail_ratio is None
    # Columns of one value have no shape, as in the SQL: 0 / 0, or nothing to divide by.
    assert (out["flat"].sd, out["flat"].mad, out["flat"].mode_share) == (0.0, 0.0, 1.0) and math.isnan(out["flat"].skew) and math.isnan(out["flat"].kurtosis)
    assert (out["one"].n, out["one"].sd, out["one"].skew) == (1, None, None)
