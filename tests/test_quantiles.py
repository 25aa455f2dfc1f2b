"""Exact order statistics vs brute force on a skewed fixture (one hot group)."""

import numpy as np
import pandas as pd
import pytest

from pliego.operators import study as S
from pliego.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.lognormal(10, 1.2, 3000), 2)})
    hot.loc[::7, "v"] = 50000.0                       # many copies of one value
    cold = pd.DataFrame({"g": [f"g{i % 40}" for i in range(6000)], "v": np.round(rng.gamma(2, 500, 6000), 2)})
    one = pd.DataFrame({"g": ["single"], "v": [7.0]})
    pdf = pd.concat([hot, cold, one], ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(spark, skewed):
    pdf, df = skewed
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = exact_quantiles(df, "v", probs, ["g"]).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        want = np.quantile(grp["v"].to_numpy(), probs)
        assert np.allclose(got.loc[g, [f"q_{i}" for i in range(5)]].to_numpy(dtype=float), want, rtol=1e-12)


def test_describe_matches_pandas(spark, skewed):
    pdf, df = skewed
    got = S.describe_values(df, "v", ["g"]).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        s = grp["v"]
        assert got.loc[g, "n"] == len(s)
        assert np.isclose(got.loc[g, "media"], s.mean())
        assert np.isclose(got.loc[g, "desviacion"], s.std(ddof=1) if len(s) > 1 else 0.0)
        assert got.loc[g, "moda"] == s.mode().iloc[0]
        assert np.isclose(got.loc[g, "mediana"], s.median())


def test_outliers_plus_adjusted_is_n(spark, skewed):
    _, df = skewed
    m = S.market_stats(df, "v", ["g"]).toPandas()
    assert ((m["n_atipicos"] + m["n_ajustado"]) == m["n"]).all()


def test_adjusted_and_top_outliers_brute_force(spark, skewed):
    pdf, df = skewed
    m = S.market_stats(df, "v", ["g"]).toPandas().set_index("g")
    tops = S.top_outliers(df, "v", ["g"]).toPandas()
    for g, grp in pdf.groupby("g"):
        s = grp["v"]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        out = s[(s < lo) | (s > hi)]
        kept = s[~((s < lo) | (s > hi))]
        assert m.loc[g, "n_atipicos"] == len(out)
        assert np.isclose(m.loc[g, "mediana_ajustada"], kept.median())
        assert np.isclose(m.loc[g, "desviacion_ajustada"], kept.std(ddof=1) if len(kept) > 1 else 0.0)
        want = list(out.nlargest(5))
        have = list(tops[tops.g == g].sort_values("posicion")["valor"])
        assert np.allclose(have, want)


def test_ungrouped(spark, skewed):
    pdf, df = skewed
    d = S.describe_values(df, "v").first()
    assert d["n"] == len(pdf) and np.isclose(d["p90"], pdf["v"].quantile(0.9))


def test_approx_quantiles_within_rank_error(spark, skewed):
    from pliego.operators.quantiles import approx_quantiles
    pdf, df = skewed
    got = approx_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"], accuracy=10000).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        s = np.sort(grp["v"].to_numpy())
        n = len(s)
        for i, p in enumerate([0.25, 0.5, 0.75]):
            v = got.loc[g, f"q_{i}"]
            rank_lo, rank_hi = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right")
            target = p * n
            assert rank_lo - n / 10000 - 1 <= target <= rank_hi + n / 10000 + 1
