"""SQL text of the summary tables, by the direct two-pass formulas.

The mean is computed first, then every row's linearised residual, then the
between-unit variance of the residuals in each stratum.
"""

from __future__ import annotations

from oracles.frames_sql import text
from tallyloom.operators.estimate import ALL, ANSWERED, MeanTable, RatioTable
from tallyloom.plans.catalogue import Distribution, Estimate, Shares, Spec

TABLE = {"household": "main", "person": "ind"}

# Normal quantile at 0.975.
Q = "1.959963984540054"

DIGITS = 6


def rounded(sql: str, name: str) -> str:
    return f"round({sql}, {DIGITS}) + 0.0 AS {name}"


def t_quantile(df: str) -> str:
    q, v = Q, f"CAST({df} AS DOUBLE)"
    return (
        f"({q} + (pow({q}, 3) + {q}) / 4 / {v}"
        f" + (5 * pow({q}, 5) + 16 * pow({q}, 3) + 3 * {q}) / 96 / pow({v}, 2)"
        f" + (3 * pow({q}, 7) + 19 * pow({q}, 5) + 17 * pow({q}, 3) - 15 * {q})"
        f" / 384 / pow({v}, 3))"
    )


def _same(left: str, right: str, keys: list[str]) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys)


def _domain(grain: str, values: dict[str, str], by, where, weight, strata) -> str:
    """Rows with a value, a weight and a stratum; stratum sizes of the whole table."""
    columns = [*by, *[f"{sql} AS {name}" for name, sql in values.items()]]
    columns += [f"{weight or 'CAST(1 AS DOUBLE)'} AS w", f"{strata or text('all')} AS h"]
    return f"""base AS (SELECT {', '.join(columns)},
    coalesce({where or 'TRUE'}, FALSE) AS inside FROM {TABLE[grain]}),
sizes AS (SELECT h, CAST(count(*) AS DOUBLE) AS nh FROM base GROUP BY h),
dom AS (SELECT * FROM base WHERE inside),
free AS (SELECT count(*) - count(DISTINCT h) AS df FROM dom)"""


def _spread(z: str) -> str:
    return f"nh / (nh - 1) * (sum({z} * {z}) - sum({z}) * sum({z}) / nh)"


def mean_sql(spec: Estimate, cv: bool = False) -> str:
    t: MeanTable = spec.table
    by = list(t.by)
    keys = ", ".join(by)
    ratio = "sum(w * y) / sum(CASE WHEN y IS NOT NULL THEN w END)"
    value = {"rows": "est.n", ANSWERED: "est.wy", ALL: "est.sw"}
    count = [f"{value[t.count]} AS num_obs_uw"]
    if t.count == ALL:
        count.append(rounded("sqrt(var.vw)", "num_obs_uw_se"))
    denominator = [f"{value[t.denominator]} AS denominator"]
    if t.denominator == ALL:
        denominator.append(rounded("sqrt(var.vw)", "denominator_se"))
    half = f"{t_quantile('free.df')} * sqrt(var.vm)"
    last = [rounded("sqrt(var.vm) / nullif(est.m, 0)", "mean_value_cv")] if cv else []
    columns = [
        *[f"est.{k}" for k in by],
        f"{text(t.var_name or t.column)} AS var_name",
        *count,
        *denominator,
        rounded("est.m", "mean_value"),
        rounded(f"est.m - {half}", "mean_value_low"),
        rounded(f"est.m + {half}", "mean_value_upp"),
        rounded("CASE WHEN est.m IS NOT NULL THEN sqrt(var.vm) END", "mean_value_se"),
        *last,
    ]
    return f"""WITH {_domain(spec.grain, {'y': t.column}, by, t.where, t.weight, spec.strata)},
est AS (SELECT {keys}, count(*) AS n, CAST(sum(w) AS DOUBLE) AS sw,
    CAST(coalesce(sum(CASE WHEN y IS NOT NULL THEN w END), 0) AS DOUBLE) AS wy, {ratio} AS m
    FROM dom GROUP BY {keys}),
lin AS (SELECT {', '.join(f'dom.{k}' for k in by)}, h, CAST(w AS DOUBLE) AS w,
    CASE WHEN y IS NULL THEN 0.0 ELSE w * (y - m) / wy END AS z
    FROM dom JOIN est ON {_same('dom', 'est', by)}),
parts AS (SELECT {keys}, {_spread('z')} AS vz, {_spread('w')} AS vw
    FROM lin JOIN sizes USING (h) GROUP BY {keys}, h, nh),
var AS (SELECT {keys}, greatest(sum(vz), 0) AS vm, greatest(sum(vw), 0) AS vw
    FROM parts GROUP BY {keys})
SELECT {', '.join(columns)}
FROM est JOIN var ON {_same('est', 'var', by)} CROSS JOIN free"""


def ratio_sql(spec: Estimate) -> str:
    t: RatioTable = spec.table
    by = list(t.by)
    keys = ", ".join(by)
    values = {"top": t.numerator, "base": t.base}
    z = {
        "top": "w * coalesce(top, 0)",
        "base": "w * coalesce(base, 0)",
        "known": "CASE WHEN base IS NULL THEN 0 ELSE w END",
    }
    sums = ", ".join(f"CAST(sum({v}) AS DOUBLE) AS t_{k}" for k, v in z.items())
    lin = ", ".join(f"{v} AS z_{k}" for k, v in z.items())
    spreads = ", ".join(f"{_spread(f'z_{k}')} AS v_{k}" for k in z)
    totals = ", ".join(f"greatest(sum(v_{k}), 0) AS v_{k}" for k in z)
    shown = {
        "num_obs_uw": "known",
        "denominator": "base" if t.denominator == t.base else "top",
        f"{t.numerator}_total": "top",
        f"{t.base}_total": "base",
    }
    columns = [f"est.{k}" for k in by] + [f"{text(t.name)} AS var_name"]
    for name, k in shown.items():
        columns += [f"t_{k} AS {name}", rounded(f"sqrt(v_{k})", f"{name}_se")]
    columns.append(f"round(t_top / nullif(t_base, 0), {t.digits}) AS mean_value")
    return f"""WITH {_domain(spec.grain, values, by, t.where, t.weight, spec.strata)},
est AS (SELECT {keys}, {sums} FROM dom GROUP BY {keys}),
lin AS (SELECT {keys}, h, {lin} FROM dom),
parts AS (SELECT {keys}, {spreads} FROM lin JOIN sizes USING (h) GROUP BY {keys}, h, nh),
var AS (SELECT {keys}, {totals} FROM parts GROUP BY {keys})
SELECT {', '.join(columns)} FROM est JOIN var ON {_same('est', 'var', by)}"""


def shares_sql(spec: Shares) -> str:
    by = list(spec.by)
    parts = []
    for c in [*spec.columns]:
        parts.append(_share_sql(spec, c, by))
    return "\nUNION ALL\n".join(parts)


def _share(spec: Shares, column: str) -> str:
    v = column if spec.equals is None else f"CAST({column} = {spec.equals} AS DOUBLE)"
    if spec.weight is None:
        return f"avg({v}) * 100"
    return (
        f"sum({spec.weight} * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN {spec.weight} END) * 100"
    )


def _share_sql(spec: Shares, column: str, by: list[str]) -> str:
    name = column
    if spec.labels is not None:
        name = spec.labels.get(column, column if spec.unlisted == "keep" else None)
    columns = [
        *by,
        *[rounded(_share(spec, k), k) for k in spec.keep],
        f"CAST({text(name)} AS VARCHAR) AS {spec.names_to}",
        rounded(_share(spec, column), spec.values_to),
    ]
    group = f" GROUP BY {', '.join(by)}" if by else ""
    where = f" WHERE {spec.where}" if spec.where else ""
    return f"SELECT {', '.join(columns)} FROM {TABLE[spec.grain]}{where}{group}"


def _label_case(column: str, labels) -> str:
    cases = " ".join(f"WHEN {k} THEN {text(v)}" for k, v in labels.items())
    return f"CASE {column} {cases} END"


def distribution_sql(spec: Distribution) -> str:
    by = list(spec.by)
    code = spec.column
    shown = code
    if spec.labels is not None:
        if spec.label_first:
            code = _label_case(spec.column, spec.labels)
            shown = "code"
        else:
            shown = _label_case("code", spec.labels)
    else:
        shown = "code"
    where = f" WHERE {code} IS NOT NULL" if spec.skip_missing else ""
    keys = ", ".join([*by, code])
    over = f"PARTITION BY {', '.join(by)}" if by else ""
    head = ", ".join([*by, f"{code} AS code"])
    share = rounded(f"CAST(n AS DOUBLE) / sum(n) OVER ({over}) * 100", spec.share_name)
    columns = [*by, f"{shown} AS {spec.column}", f"n AS {spec.count_name}", share]
    return f"""WITH counts AS (SELECT {head}, count(*) AS n FROM {TABLE[spec.grain]}{where}
    GROUP BY {keys})
SELECT {', '.join(columns)} FROM counts"""


def table_sql(spec: Spec) -> str:
    if isinstance(spec, Shares):
        return shares_sql(spec)
    if isinstance(spec, Distribution):
        return distribution_sql(spec)
    if isinstance(spec.table, MeanTable):
        return mean_sql(spec, spec.table.cv)
    return ratio_sql(spec)
