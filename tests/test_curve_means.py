"""Means of a column by bucket are the exact ones to the last shown digit, in whatever order the rows come."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import curves


@pytest.mark.parametrize("query", [lambda p: curves.severity_curve(p, "price", "s"), lambda p: curves.log_odds_curve(p, "price", "y", 12)], ids=["severity_curve", "log_odds_curve"])
@pytest.mark.parametrize("order", ["price", "id"])
def test_means_do_not_depend_on_order(spark, query, order):
    r = random.Random(3)
    rows = [(i, round(r.uniform(-2e7, 2e7), 2), i % 7 / 7, i % 3 // 2) for i in range(40_000)]
    panel = spark.createDataFrame(rows, "id int, price double, s double, y int").repartition(1).sortWithinPartitions(F.desc(order))
    values, at = sorted(x[1] for x in rows), 0
    for b in sorted(query(panel).collect(), key=lambda b: b.bucket):
        assert b.x == round(math.fsum(values[at : at + b.n]) / b.n, 7), b.bucket
        at += b.n
    assert at == len(values)
