"""Exact tests whose cost does not follow the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from datarights.operators.stats import mcnemar


def plain(b, c):
    n, k = b + c, np.arange(min(b, c) + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in k.tolist()])
    return min(0.0, math.log(2) + logs.max() + math.log(np.exp(logs - logs.max()).sum()))


@pytest.mark.parametrize("b, c", [(0, 0), (0, 1), (0, 9), (3, 3), (7, 2), (40, 61), (0, 5000), (497_000, 503_000), (100, 999_900), (500_000, 500_000)])
def test_mcnemar(spark, b, c):
    """Also with a million pairs that differ, and where p is too small for a double."""
    base = spark.range(b + c + 5)
    left = base.select("id", (F.col("id") < b).alias("passed"))
    right = base.select("id", ((F.col("id") >= b) & (F.col("id") < b + c)).alias("passed"))
    got = mcnemar(left, right, ["id"]).first()
    assert (got.b, got.c, got.n_discordant) == (b, c, b + c)
    assert got.ln_p == pytest.approx(plain(b, c) if b + c else 0.0, rel=1e-7, abs=1e-7) and got.p_exact == pytest.approx(math.exp(got.ln_p))
