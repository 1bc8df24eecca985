"""Estimators against brute force on a small sample, and their invariants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.tquantile import exact_quantiles, t_quantile
from tallyloom.operators.design import SurveyDesign
from tallyloom.operators.estimate import (
    ALL,
    ANSWERED,
    MeanTable,
    RatioTable,
    indicator_tables,
    mean_table,
    mean_tables,
    ratio_table,
    total_table,
)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 400
    y = rng.choice([0.0, 1.0, np.nan], n, p=[0.5, 0.4, 0.1])
    return pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c", None], n, p=[0.5, 0.3, 0.1, 0.1]),
            "sex": rng.choice(["m", "f"], n),
            "h": rng.choice(["s1", "s2", "s3"], n),
            "u": rng.integers(0, 25, n),
            "w": rng.uniform(0.5, 3.0, n),
            "y": y,
            "z": np.where(rng.random(n) < 0.3, np.nan, 1.0),
            "income": rng.normal(5000, 40, n),
        }
    )


@pytest.fixture(scope="module")
def frame(spark, sample):
    rows = sample.astype(object).where(sample.notna(), None)
    schema = "g string, sex string, h string, u long, w double, y double, z double, income double"
    return spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema)


def brute(sample, column, inside, weight=None, strata=None, psu=None):
    """Mean and standard error straight from the residuals of every row."""
    w = sample[weight].to_numpy() if weight else np.ones(len(sample))
    h = sample[strata].to_numpy() if strata else np.zeros(len(sample))
    u = sample[psu].to_numpy() if psu else np.arange(len(sample))
    y = sample[column].to_numpy(dtype=float)
    use = inside & ~np.isnan(y)
    mean = (w[use] * y[use]).sum() / w[use].sum()
    z = np.where(use, w * (np.nan_to_num(y) - mean) / w[use].sum(), 0.0)
    return mean, math.sqrt(variance(z, h, u))


def variance(z, h, u):
    total = 0.0
    for s in np.unique(h):
        units = pd.Series(z[h == s]).groupby(u[h == s]).sum().to_numpy()
        n = len(units)
        total += n / (n - 1) * ((units**2).sum() - units.sum() ** 2 / n)
    return total


DESIGNS = [
    {},
    {"weight": "w"},
    {"strata": "h"},
    {"weight": "w", "strata": "h"},
    {"weight": "w", "strata": "h", "psu": "u"},
    {"psu": "u"},
]


@pytest.mark.parametrize("options", DESIGNS)
@pytest.mark.parametrize("where", [None, "sex = 'f'"])
def test_mean_against_brute_force(frame, sample, options, where):
    rows = mean_table(SurveyDesign(frame, **options), "y", ["g"], where).collect()
    inside = (sample.sex == "f").to_numpy() if where else np.ones(len(sample), bool)
    assert len(rows) == 4
    for r in rows:
        group = sample.g.isna() if r.g is None else sample.g == r.g
        mean, se = brute(sample, "y", inside & group.to_numpy(), **options)
        assert r.mean_value == pytest.approx(mean, abs=1e-12)
        assert r.mean_value_se == pytest.approx(se, abs=1e-12)
        assert r.num_obs_uw == (inside & group.to_numpy()).sum()
        w = sample.w.to_numpy() if "weight" in options else np.ones(len(sample))
        assert r.denominator == pytest.approx(w[inside & group.to_numpy()].sum())


@pytest.mark.parametrize("options", DESIGNS[3:5])
def test_interval_uses_units_minus_strata_of_the_domain(frame, sample, options):
    domain = sample[(sample.sex == "f") & (sample.g == "a")]
    units = domain[["h", "u"]].drop_duplicates() if "psu" in options else domain
    df = len(units) - domain.h.nunique()
    design = SurveyDesign(frame, **options)
    (r,) = mean_table(design, "y", ["sex"], "sex = 'f' AND g = 'a'").collect()
    q = exact_quantiles(0.975)[df - 1] if df <= 100 else None
    half = r.mean_value_upp - r.mean_value
    if q:
        assert half / r.mean_value_se == pytest.approx(q, abs=1e-9)
    assert r.mean_value - r.mean_value_low == pytest.approx(half)


def test_filtering_rows_is_not_a_domain(frame):
    design = SurveyDesign(frame, "w", "h")
    (domain,) = mean_table(design, "y", ["sex"], "sex = 'f'").collect()
    subset = SurveyDesign(frame.where("sex = 'f'"), "w", "h")
    (cut,) = mean_table(subset, "y", ["sex"]).collect()
    assert domain.mean_value == pytest.approx(cut.mean_value)
    assert domain.mean_value_se != pytest.approx(cut.mean_value_se, rel=1e-6)


def test_large_numbers_keep_precision_with_a_center(frame, sample):
    design = SurveyDesign(frame, "w", "h")
    (r,) = mean_table(design, "income", [], binary=False, center=5000).collect()
    mean, se = brute(sample, "income", np.ones(len(sample), bool), "w", "h")
    assert r.mean_value == pytest.approx(mean, rel=1e-13)
    assert r.mean_value_se == pytest.approx(se, rel=1e-9)


def test_scaling_the_weights(frame):
    scaled = SurveyDesign(frame.withColumn("w", F.col("w") * 8), "w", "h")
    design = SurveyDesign(frame, "w", "h")
    for a, b in zip(
        mean_table(design, "y", ["g"]).orderBy("g").collect(),
        mean_table(scaled, "y", ["g"]).orderBy("g").collect(),
    ):
        assert a.mean_value == pytest.approx(b.mean_value)
        assert a.mean_value_se == pytest.approx(b.mean_value_se)
        assert a.denominator * 8 == pytest.approx(b.denominator)


def test_repartitioning_changes_nothing(frame):
    def values(f):
        rows = mean_table(SurveyDesign(f, "w", "h"), "y", ["g"]).orderBy("g").collect()
        return [(r.g, round(r.mean_value, 9), round(r.mean_value_se, 9)) for r in rows]

    assert values(frame) == values(frame.repartition(7, "u"))


def test_single_unit_stratum(frame, spark):
    lone = spark.createDataFrame(
        [("a", "m", "only", 1, 1.0, 1.0, 1.0, 1.0)], frame.schema
    )
    both = frame.union(lone)
    with pytest.raises(Exception, match="single sampling unit"):
        mean_table(SurveyDesign(both, "w", "h"), "y", ["g"]).collect()
    rows = mean_table(SurveyDesign(both, "w", "h", lonely="zero"), "y", ["g"]).collect()
    assert len(rows) == 4 and all(r.mean_value_se > 0 for r in rows)
    elsewhere = mean_table(SurveyDesign(both, "w", "h"), "y", ["g"], "h <> 'only'").collect()
    assert len(elsewhere) == 4


def test_totals_against_brute_force(frame, sample):
    rows = total_table(SurveyDesign(frame, "w", "h"), ["g"], "y").collect()
    w, h = sample.w.to_numpy(), sample.h.to_numpy()
    for r in rows:
        group = (sample.g.isna() if r.g is None else sample.g == r.g).to_numpy()
        z = np.where(group, w * sample.y.fillna(0).to_numpy(), 0.0)
        assert r.total == pytest.approx(z.sum())
        assert r.total_se == pytest.approx(math.sqrt(variance(z, h, np.arange(len(z)))))
        known = group & sample.y.notna().to_numpy()
        assert r.answered == pytest.approx(w[known].sum())


def test_ratio_may_exceed_one(frame, sample):
    rows = ratio_table(SurveyDesign(frame, "w", "h"), "z", "y", ["g"], "ratio").collect()
    for r in rows:
        group = (sample.g.isna() if r.g is None else sample.g == r.g).to_numpy()
        w = sample.w.to_numpy()[group]
        top = (w * sample.z.fillna(0).to_numpy()[group]).sum()
        base = (w * sample.y.fillna(0).to_numpy()[group]).sum()
        assert r.mean_value == pytest.approx(round(top / base, 4))
        assert r.denominator == pytest.approx(r.z_total) == pytest.approx(top)
    assert any(r.mean_value > 1 for r in rows)


def test_no_answers_give_missing_not_an_error(frame):
    empty = frame.withColumn("y", F.lit(None).cast("double"))
    (r,) = mean_table(SurveyDesign(empty, "w", "h"), "y", []).collect()
    assert r.mean_value is None and r.mean_value_se is None and r.num_obs_uw == 400
    (r,) = ratio_table(SurveyDesign(empty), "z", "y", ["h"], "x", "h = 's1'").collect()
    assert r.mean_value is None


def test_counts_and_denominators(frame, sample):
    design = SurveyDesign(frame, "w", "h")
    (r,) = mean_table(design, "y", [], count=ANSWERED, denominator=ANSWERED).collect()
    known = sample.w[sample.y.notna()].sum()
    assert r.num_obs_uw == pytest.approx(known) == pytest.approx(r.denominator)
    (r,) = mean_table(design, "y", [], count=ALL, cv=True).collect()
    assert r.num_obs_uw == pytest.approx(sample.w.sum())
    assert r.mean_value_cv == pytest.approx(r.mean_value_se / r.mean_value)


def test_tables_of_one_pass_equal_single_tables(frame):
    design = SurveyDesign(frame, "w", "h")
    tables = [
        MeanTable("t1", "y", ["g"], "sex = 'f'"),
        MeanTable("t2", "y", ["sex", "g"], None, count=ANSWERED),
        MeanTable("t3", "z", [], "g IS NOT NULL"),
    ]
    stacked = mean_tables(design, tables).collect()
    for t in tables:
        single = mean_table(design, t.column, t.by, t.where, count=t.count).collect()
        part = [r for r in stacked if r.table == t.name]
        assert len(part) == len(single)
        key = lambda r: tuple(str(r[k]) for k in t.by)
        for a, b in zip(sorted(part, key=key), sorted(single, key=key)):
            for c in ["num_obs_uw", "denominator", "denominator_se", "mean_value"]:
                assert a[c] == pytest.approx(b[c], abs=1e-12)
            assert a.mean_value_low == pytest.approx(b.mean_value_low, abs=1e-12)


def test_means_and_ratios_of_one_pass(frame):
    design = SurveyDesign(frame, "w", "h")
    tables = [MeanTable("m", "y", ["g"]), RatioTable("r", "z", "y", ["g"], denominator="y")]
    rows = indicator_tables(design, tables).collect()
    means = {r.g: r for r in mean_table(design, "y", ["g"]).collect()}
    ratios = {r.g: r for r in ratio_table(design, "z", "y", ["g"], "r", None, "y").collect()}
    assert len(rows) == 8
    for r in rows:
        other = means[r.g] if r.var_name == "m" else ratios[r.g]
        for c in ["num_obs_uw", "denominator", "denominator_se", "mean_value"]:
            assert r[c] == pytest.approx(other[c])
        if r.var_name == "r":
            assert r.z_total_se == pytest.approx(other.z_total_se) and r.mean_value_se is None


def test_strata_sizes(frame, sample):
    rows = SurveyDesign(frame, strata="h", psu="u").strata_sizes().collect()
    wanted = sample.groupby("h").u.nunique().to_dict()
    assert {r.stratum: r.n_h for r in rows} == wanted


def test_unknown_column_or_option_is_refused(frame):
    with pytest.raises(ValueError):
        SurveyDesign(frame, weight="none")
    with pytest.raises(ValueError):
        SurveyDesign(frame, lonely="ignore")


# Published two-sided 95% quantiles of Student's t.
PUBLISHED = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 30: 2.042272, 100: 1.983972}
PUBLISHED |= {200: 1.971896, 1000: 1.962339}


def test_t_quantiles(spark):
    rows = spark.createDataFrame([(d,) for d in [0, *PUBLISHED]], "df long")
    got = {r.df: r.q for r in rows.selectExpr("df", f"{t_quantile('df')} AS q").collect()}
    assert got.pop(0) is None
    for df, q in PUBLISHED.items():
        assert got[df] == pytest.approx(q, abs=6e-7)


def test_a_row_without_weight_is_sampled_with_weight_zero(frame):
    some = F.when(F.col("u") > 3, F.col("w"))
    gaps = mean_table(SurveyDesign(frame.withColumn("w", some), "w", "h"), "y", []).first()
    zeros = F.coalesce(some, F.lit(0.0))
    filled = mean_table(SurveyDesign(frame.withColumn("w", zeros), "w", "h"), "y", []).first()
    assert gaps == filled and gaps.num_obs_uw == 400
