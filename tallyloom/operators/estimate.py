"""Design-based means, totals and ratios of totals.

Every estimate comes from sums of ``w``, ``wy``, ``w²``, ``w²y`` and ``w²y²`` per
group and stratum.  They are collected in one pass over the rows with map-side
partial sums, so a group of any size costs one small record per task, and all
that follows works on one record per group and stratum.

Rows outside a domain stay in the pass, because the variance needs the stratum
sizes of the full design.  With ``a = Σw`` and ``b = Σwy`` over answered rows,
the mean is ``b/a`` and its linearised variance is
``(V(b) - 2·mean·C(a, b) + mean²·V(a)) / a²``, where ``V`` and ``C`` are the
stratified between-unit variance and covariance of the sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.codes import name as column_name
from tallyloom.functions.codes import quoted
from tallyloom.functions.tquantile import t_quantile
from tallyloom.operators.design import SurveyDesign

ROWS = "rows"
ANSWERED = "answered"
ALL = "all"


@dataclass(frozen=True)
class Measure:
    """A numeric column to estimate.

    ``binary`` claims that a column holds only 0, 1 or NULL, which needs fewer sums; a false
    claim that shows in a variance stops the query.  ``center`` is subtracted while summing and added back to the mean; a value near the mean
    keeps precision for large numbers and leaves the results unchanged.
    """

    column: str
    binary: bool = False
    center: float = 0.0


@dataclass(frozen=True)
class MeanTable:
    """Specification of a table of means.

    ``count`` is what ``num_obs_uw`` shows: number of rows (``rows``), weighted
    number of answered rows (``answered``) or weighted number of rows (``all``).
    ``denominator`` is ``all`` or ``answered``.  ``where`` is an SQL predicate.
    ``weight`` overrides the weight of the design.
    """

    name: str
    column: str
    by: Sequence[str]
    where: str | None = None
    count: str = ROWS
    denominator: str = ALL
    weight: str | None = None
    var_name: str | None = None
    binary: bool = False
    center: float = 0.0
    cv: bool = False


@dataclass(frozen=True)
class _Request:
    """One measure, in one domain, by some keys, under one weight."""

    measure: Measure
    by: tuple[str, ...]
    where: str | None
    weight: str | None


def _distinct(items):
    return list(dict.fromkeys(items))


def _aggregate(frame: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return frame.groupBy(*by).agg(*[F.expr(s) for s in sums])


def _measure_sums(tag: str, y: str, measure: Measure, weight: str | None) -> list[str]:
    """Aggregates of one measure, found in column y; some coincide for unweighted or 0/1 data."""
    if measure.center:
        y = f"({y} - {measure.center}D)"
    square = not measure.binary or measure.center
    if weight is None:
        sums = {"a": f"CAST(count({y}) AS DOUBLE)", "b": f"sum({y})"}
        if square:
            sums["g"] = f"sum({y} * {y})"
    else:
        w = weight
        sums = {
            "a": f"sum(CASE WHEN {y} IS NOT NULL THEN {w} END)",
            "b": f"sum({w} * {y})",
            "c": f"sum(CASE WHEN {y} IS NOT NULL THEN {w} * {w} END)",
            "e": f"sum({w} * {w} * {y})",
        }
        if square:
            sums["g"] = f"sum({w} * {w} * {y} * {y})"
    return [f"{text} AS {tag}{name}" for name, text in sums.items()]


def _measure_fields(tag: str, measure: Measure, weight: str | None) -> dict[str, str]:
    """Where the five sums of one measure are found in the aggregate."""
    square = not measure.binary or measure.center
    a, b = f"{tag}a", f"{tag}b"
    c, e = (a, b) if weight is None else (f"{tag}c", f"{tag}e")
    fields = {"a": a, "b": b, "c": c, "e": e, "g": f"{tag}g" if square else e}
    return {name: f"coalesce({place}, 0D)" for name, place in fields.items()}


def _struct(fields: dict[str, str]) -> str:
    return "struct(" + ", ".join(f"{text} AS {name}" for name, text in fields.items()) + ")"


class _Pass:
    """One pass over a design that answers several requests."""

    def __init__(self, design: SurveyDesign, requests: Sequence[_Request]):
        self.design = design
        self.requests = list(requests)
        self.by = _distinct(k for r in self.requests for k in r.by)
        # inside the pass all columns have names of its own, so any name can be a key
        self.keys = [f"k{i}" for i in range(len(self.by))]
        self.shown = [f"{k} AS {column_name(c)}" for k, c in zip(self.keys, self.by)]
        self.wheres = _distinct(r.where for r in self.requests)
        self.weights = _distinct(r.weight for r in self.requests)
        self.measures = _distinct((r.measure, r.weight) for r in self.requests)
        self.shared = len({(r.where, r.by) for r in self.requests}) == 1
        self.strata = ["stratum"] if design.strata else []
        self.unit = ["psu"] if design.psu else []
        #: conditions that some row of the whole table must meet, or a measure is missing everywhere
        self.present = _distinct(design.deferred[m.column][1] for m, _ in self.measures if m.column in design.deferred)

    def _sums(self) -> DataFrame:
        """One record per combination of keys, domain flags, stratum (and unit)."""
        d = self.design
        flags = {f"in{i}": f"coalesce({w}, false)" for i, w in enumerate(self.wheres) if w}
        keys = {k: column_name(c) for k, c in zip(self.keys, self.by)}
        if self.shared and flags:
            keys = {k: f"CASE WHEN {flags['in0']} THEN {c} END" for k, c in keys.items()}
        group = {**keys, **flags}
        if d.strata:
            group["stratum"] = column_name(d.strata)
        if d.psu:
            group["psu"] = column_name(d.psu)
        columns = _distinct(m.column for m, _ in self.measures)
        values = {c: f"y{i}" for i, c in enumerate(columns)}
        weights = {w: f"u{i}" for i, w in enumerate(self.weights) if w is not None}
        source = {c: d.deferred[c][0] if c in d.deferred else c for c in columns}
        named = {y: f"CAST({column_name(source[c])} AS DOUBLE)" for c, y in values.items()}
        named |= {f"q{i}": column_name(c) for i, c in enumerate(self.present)}
        named |= {u: column_name(w) for w, u in weights.items()}
        rows = d.frame.selectExpr(*[f"{text} AS {n}" for n, text in (named | group).items()])
        sums = ["count(1) AS n", *[f"count_if(q{i}) AS q{i}" for i in range(len(self.present))]]
        for i, w in enumerate(self.weights):
            if w is not None:
                u = weights[w]
                sums += [f"sum({u}) AS w{i}", f"sum({u} * {u}) AS ww{i}"]
        for i, (m, w) in enumerate(self.measures):
            sums += _measure_sums(f"m{i}", values[m.column], m, weights.get(w))
        return _aggregate(rows, list(group), sums)

    def _cell(self, number: int, request: _Request) -> dict[str, str]:
        """Fields of one request in one record of sums."""
        i = self.weights.index(request.weight)
        w, ww = ("n", "n") if request.weight is None else (f"w{i}", f"ww{i}")
        tag = f"m{self.measures.index((request.measure, request.weight))}"
        return {
            "request": str(number),
            "w": f"coalesce(CAST({w} AS DOUBLE), 0D)",
            "ww": f"coalesce(CAST({ww} AS DOUBLE), 0D)",
            **_measure_fields(tag, request.measure, request.weight),
        }

    def _inside(self, where: str | None) -> str:
        return "true" if where is None else f"in{self.wheres.index(where)}"

    def _units(self, sums: DataFrame) -> DataFrame:
        """Records of a sampling unit side by side, the first one carrying what is counted once a unit.

        One shuffle by stratum and unit; all that follows up to the sums per stratum stays in place.
        """
        unit = ", ".join([*self.strata, "psu"])
        first = f"row_number() OVER (PARTITION BY {unit} ORDER BY {', '.join(self.keys) or 'n'}) = 1"
        held = [f"max({self._inside(w)}) OVER (PARTITION BY {unit}) AS held{i}" for i, w in enumerate(self.wheres)]
        return sums.repartition(*[F.col(c) for c in [*self.strata, "psu"]]).selectExpr("*", f"{first} AS first", *held)

    def _cells(self) -> DataFrame:
        """Records per request and cell of rows inside its domain, and (request -1) the sizes of strata.

        ``size`` counts sampling units, ``size0``, ``size1``, .. those inside each domain.
        """
        sums = self._units(self._sums()) if self.unit else self._sums()
        types = {k: t for k, t in sums.dtypes if k in self.keys}
        none = {k: f"CAST(NULL AS {t})" for k, t in types.items()}
        if self.unit:
            sizes = {"size": "CAST(first AS BIGINT)"}
            sizes |= {f"size{i}": f"CAST(first AND held{i} AS BIGINT)" for i in range(len(self.wheres))}
        else:
            sizes = {"size": "n"}
            sizes |= {f"size{i}": f"CASE WHEN {self._inside(w)} THEN n ELSE 0L END" for i, w in enumerate(self.wheres)}
        sizes |= {f"q{i}": f"q{i}" for i in range(len(self.present))}
        no_sizes = {x: "0L" for x in sizes}
        zero = {x: "0D" for x in ["w", "ww", "a", "b", "c", "e", "g"]}
        cells = [_struct({"inside": "true", "n": "0L", **none, "request": "-1", **zero, **sizes})]
        for i, r in enumerate(self.requests):
            keys = {k: k if c in r.by else none[k] for k, c in zip(self.keys, self.by)}
            fields = {"inside": self._inside(r.where), "n": "n", **keys, **self._cell(i, r), **no_sizes}
            cells.append(_struct(fields))
        out = sums.selectExpr(*self.strata, *self.unit, f"inline(array({', '.join(cells)}))")
        return out.where("inside").drop("inside")

    def _strata_records(self) -> DataFrame:
        """Cells summed per request, group and stratum, unless they are unique already."""
        cells = self._cells()
        if self.shared and not self.unit:
            return cells
        counted = [c for c in cells.columns if c == "size" or c.startswith("size") or c[0] == "q" and c[1:].isdigit()]
        group = ["request", *self.keys, *self.strata]
        names = ["n", "w", "ww", "a", "b", "c", "e", "g"]
        if self.unit:
            added = [f"sum({x}) AS {x}" for x in ["n", "w", "a", "b", *counted]]
            # within the partitioning by stratum and unit
            cells = _aggregate(cells, [*group, "psu"], added)
            products = {"ww": "w * w", "c": "a * a", "e": "a * b", "g": "b * b"}
            return _aggregate(cells, group, [f"sum({products.get(x, x)}) AS {x}" for x in [*names, *counted]])
        return _aggregate(cells, group, [f"sum({x}) AS {x}" for x in [*names, *counted]])

    def _known(self) -> str:
        """Whether a request's measure is there at all: some row of the table meets its condition."""
        known = []
        for r in self.requests:
            there = self.design.deferred.get(r.measure.column)
            known.append(f"total_q{self.present.index(there[1])} > 0" if there else "true")
        return _choice(known)

    def _spread(self, xy: str, x: str, y: str) -> str:
        """Between-unit (co)variance of the stratum totals x and y."""
        if self.design.lonely == "zero":
            single = "0D"
        else:
            single = "CAST(raise_error('a stratum has a single sampling unit') AS DOUBLE)"
        scale = f"CASE WHEN n_h > 1 THEN n_h / (n_h - 1) ELSE {single} END"
        return f"({scale}) * ({xy} - {x} * {y} / n_h)"

    def groups(self) -> DataFrame:
        """One record per request and group: totals, their (co)variances and df."""
        records = self._strata_records()
        spread = {
            "v_w": self._spread("ww", "w", "w"),
            "v_a": self._spread("c", "a", "a"),
            "c_ab": self._spread("e", "a", "b"),
            "v_b": self._spread("g", "b", "b"),
        }
        spread_fields = [f"{text} AS {x}" for x, text in spread.items()]
        domains = [f"size{i}" for i in range(len(self.wheres))]
        present = [f"q{i}" for i in range(len(self.present))]
        if self.strata:
            over = "OVER (PARTITION BY stratum)"
            sized = [f"sum({x}) {over} AS {x}" for x in ["size", *domains]]
            first = f"row_number() OVER (PARTITION BY stratum ORDER BY {', '.join(['request', *self.keys])}) = 1 AS first"
            kept = [c for c in records.columns if c not in ("size", *domains)]
            records = records.selectExpr(*kept, *sized, first).withColumnRenamed("size", "n_h")
            # one record of a stratum stands for its degrees of freedom
            totals = {x: f"CASE WHEN first THEN {x} - CAST({x} > 0 AS BIGINT) ELSE 0L END" for x in domains}
            totals |= {x: x for x in present}
            # sizes alone are no reason to stop at a stratum of a single unit
            inside = [f"CASE WHEN request < 0 THEN 0D ELSE {text} END AS {x}" for x, text in spread.items()]
            records = records.selectExpr("*", *inside)
            out = _with_totals(records, self.keys, ["n", "w", "a", "b", *spread], totals)
            df = _choice([f"total_size{self.wheres.index(r.where)}" for r in self.requests])
        else:
            totals = {x: x for x in ["size", *domains, *present]}
            out = _with_totals(records, self.keys, ["n", "w", "ww", "a", "b", "c", "e", "g"], totals)
            out = out.withColumnRenamed("total_size", "n_h").selectExpr("*", *spread_fields)
            df = _choice([f"total_size{self.wheres.index(r.where)} - 1" for r in self.requests])
        measured = ["a", "v_a", "b", "v_b", "c_ab"]
        if present:
            known = self._known()
            measured = [f"CASE WHEN {known} THEN {x} ELSE 0D END AS {x}" for x in measured]
        return out.selectExpr("request", *self.keys, *["n", "w", "v_w"], *measured, f"{df} AS df")


#: Copies of the totals, each beside a part of the groups.
BUCKETS = 16


def _with_totals(records: DataFrame, keys: Sequence[str], sums: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Records summed by request and keys; every group also gets the totals of the records of request -1.

    Totals are dealt to every bucket of groups by the shuffle that sums them, so no task holds all
    groups and the records are read once.
    """
    types = dict(records.dtypes)
    none = {k: f"CAST(NULL AS {types[k]})" for k in keys}
    zero = {x: f"CAST(0 AS {types[x]})" for x in sums}
    total = _struct({"bucket": "x", "request": "-1", **none, **zero, **{f"total_{x}": t for x, t in totals.items()}})
    bucket = f"CAST(pmod(hash({', '.join(['request', *keys])}), {BUCKETS}) AS INT)"
    nothing = {f"total_{x}": "0L" for x in totals}
    own = _struct({"bucket": bucket, "request": "request", **{k: k for k in keys}, **{x: x for x in sums}, **nothing})
    copies = f"transform(sequence(0, {BUCKETS - 1}), x -> {total})"
    dealt = records.selectExpr(f"inline(CASE WHEN request < 0 THEN {copies} ELSE array({own}) END)")
    named = [f"total_{x}" for x in totals]
    out = _aggregate(dealt, ["bucket", "request", *keys], [f"sum({x}) AS {x}" for x in [*sums, *named]])
    whole = [f"sum({x}) OVER (PARTITION BY bucket) AS {x}" for x in named]
    return out.selectExpr("request", *keys, *sums, *whole).where("request >= 0")


def _root(variance: str, size: str) -> str:
    """Standard error.  Below zero a variance is rounding, if tiny beside ``size``, or an error."""
    wrong = "CAST(raise_error('a negative variance: is a binary column really 0/1?') AS DOUBLE)"
    return (
        f"sqrt(CASE WHEN {variance} < -1e-9D * ({size}) THEN {wrong}"
        f" WHEN {variance} < 0 THEN 0D ELSE {variance} END)"
    )


def _total_se(x: str, prefix: str = "") -> str:
    """Standard error of the total w, a or b; its variance is rounded at the scale of x²/n."""
    return _root(f"{prefix}v_{x}", f"{prefix}{x} * {prefix}{x} / greatest({prefix}n, 1)")


def _choice(values: Sequence[str]) -> str:
    """A per-request constant; plain where all requests agree."""
    if len(set(values)) == 1:
        return values[0]
    return f"get(array({', '.join(values)}), request)"


_MEAN = "try_divide(b, a)"
_MEAN_SE = _root(
    f"try_divide(v_b - 2 * {_MEAN} * c_ab + {_MEAN} * {_MEAN} * v_a, a * a)",
    f"coalesce({_MEAN} * {_MEAN}, 0D) / greatest(n, 1)",
)


def mean_tables(
    design: SurveyDesign, tables: Sequence[MeanTable], level: float = 0.95
) -> DataFrame:
    """Several tables of means from one pass over the design.

    Rows carry the table's ``name`` in column ``table``, then all keys used by
    any table (NULL where a table does not use one), then the estimates.
    """
    requests = [
        _Request(
            Measure(t.column, t.binary, t.center), tuple(t.by), t.where, t.weight or design.weight
        )
        for t in tables
    ]
    one_pass = _Pass(design, requests)
    counts = {t.count for t in tables}
    number = {ROWS: "CAST(n AS DOUBLE)", ANSWERED: "a", ALL: "w"}
    num_obs = "n" if counts == {ROWS} else _choice([number[t.count] for t in tables])
    center = _choice([f"{float(t.center)!r}D" for t in tables])
    columns = {
        "table": _choice([quoted(t.name) for t in tables]),
        **dict(zip(one_pass.by, one_pass.keys)),
        "var_name": _choice([quoted(t.var_name or t.column) for t in tables]),
        "num_obs_uw": num_obs,
    }
    if ALL in counts:
        se = {ALL: _total_se("w")}
        columns["num_obs_uw_se"] = _choice(
            [se.get(t.count, "CAST(NULL AS DOUBLE)") for t in tables]
        )
    columns["denominator"] = _choice([number[t.denominator] for t in tables])
    if any(t.denominator == ALL for t in tables):
        columns["denominator_se"] = _choice(
            [_total_se("w") if t.denominator == ALL else "CAST(NULL AS DOUBLE)" for t in tables]
        )
    columns["mean_value"] = f"{_MEAN} + {center}"
    half = f"{t_quantile('df', (1 + level) / 2)} * mean_value_se"
    out = one_pass.groups().selectExpr(
        *[f"{text} AS {column_name(c)}" for c, text in columns.items()],
        f"{_MEAN_SE} AS mean_value_se",
        "df",
    )
    interval = [f"mean_value - {half} AS mean_value_low", f"mean_value + {half} AS mean_value_upp"]
    cv = ["try_divide(mean_value_se, mean_value) AS mean_value_cv"]
    return out.selectExpr(
        *map(column_name, columns), *interval, "mean_value_se", *(cv if any(t.cv for t in tables) else [])
    )


def mean_table(
    design: SurveyDesign,
    column: str,
    by: Sequence[str],
    where: str | None = None,
    level: float = 0.95,
    **options,
) -> DataFrame:
    """Mean of one column by group, with standard error and confidence interval."""
    table = MeanTable(column, column, tuple(by), where, **options)
    return mean_tables(design, [table], level).drop("table")


def total_table(
    design: SurveyDesign,
    by: Sequence[str],
    column: str | None = None,
    where: str | None = None,
    binary: bool = False,
) -> DataFrame:
    """Weighted totals by group: of the rows, or of a column where one is given.

    ``answered`` is the weighted number of rows in which the column is not missing.
    """
    source = design if column else design.derive(one="1D")
    measure = Measure(column or "one", binary or column is None)
    request = _Request(measure, tuple(by), where, design.weight)
    one_pass = _Pass(source, [request])
    return one_pass.groups().selectExpr(
        *one_pass.shown,
        f"{quoted(column or ROWS)} AS var_name",
        "n AS num_obs_uw",
        "b AS total",
        f"{_total_se('b')} AS total_se",
        "a AS answered",
    )


def ratio_table(
    design: SurveyDesign,
    numerator: str,
    base: str,
    by: Sequence[str],
    var_name: str,
    where: str | None = None,
    denominator: str | None = None,
    digits: int = 4,
    binary: bool = False,
) -> DataFrame:
    """Ratio of two totals by group, with the standard error of each total.

    The two columns are summed independently, so the ratio may exceed 1.
    ``num_obs_uw`` is the weighted number of rows with a known ``base``;
    ``denominator`` repeats the total of the named column (default: ``numerator``).
    """
    denominator = denominator or numerator
    if denominator not in (numerator, base):
        raise ValueError("denominator must be the numerator or the base column")
    requests = [
        _Request(Measure(c, binary), tuple(by), where, design.weight) for c in (numerator, base)
    ]
    totals = {
        "num_obs_uw": (1, "a"),
        "denominator": (0 if denominator == numerator else 1, "b"),
        f"{numerator}_total": (0, "b"),
        f"{base}_total": (1, "b"),
    }
    sums = []
    for shown, (request, total) in totals.items():
        value = f"CASE WHEN request = {request} THEN {total} END"
        sums.append(f"max({value}) AS {column_name(shown)}")
        se = f"CASE WHEN request = {request} THEN {_total_se(total)} END"
        sums.append(f"max({se}) AS {column_name(f'{shown}_se')}")
    one_pass = _Pass(design, requests)
    wide = _aggregate(one_pass.groups(), one_pass.keys, sums)
    top, bottom = (column_name(f"{c}_total") for c in (numerator, base))
    return wide.selectExpr(
        *one_pass.shown,
        f"{quoted(var_name)} AS var_name",
        *map(column_name, wide.columns[len(by) :]),
        f"round(try_divide({top}, {bottom}), {digits}) AS mean_value",
    )


@dataclass(frozen=True)
class RatioTable:
    """Specification of a table of ratios of totals, see ``ratio_table``."""

    name: str
    numerator: str
    base: str
    by: Sequence[str]
    where: str | None = None
    denominator: str | None = None
    weight: str | None = None
    digits: int = 4
    binary: bool = False


def indicator_tables(
    design: SurveyDesign, tables: Sequence[MeanTable | RatioTable], level: float = 0.95
) -> DataFrame:
    """Means and ratios stacked by column name, all from one pass over the design.

    The columns are those of ``mean_tables`` and ``ratio_table`` together; a table
    leaves the columns it lacks missing.
    """
    requests, places = [], []
    for t in tables:
        w = t.weight or design.weight
        if isinstance(t, MeanTable):
            measures = [Measure(t.column, t.binary, t.center)]
        else:
            measures = [Measure(t.numerator, t.binary), Measure(t.base, t.binary)]
        places.append(len(requests))
        requests += [_Request(m, tuple(t.by), t.where, w) for m in measures]
    one_pass = _Pass(design, requests)
    wide = one_pass.groups()
    if len(requests) > len(tables):
        wide = _beside(wide, one_pass.keys, tables, [int(p in places) for p in range(len(requests))])
    none = "CAST(NULL AS DOUBLE)"
    columns: dict[str, list[str]] = {}

    def put(name: str, place: int, text: str) -> None:
        columns.setdefault(name, [none] * len(tables))[place] = text

    number = {ROWS: "CAST(n AS DOUBLE)", ANSWERED: "a", ALL: "w"}
    for i, t in enumerate(tables):
        if isinstance(t, MeanTable):
            half = f"{t_quantile('df', (1 + level) / 2)} * {_MEAN_SE}"
            mean = f"{_MEAN} + {float(t.center)!r}D"
            put("num_obs_uw", i, number[t.count])
            put("denominator", i, number[t.denominator])
            put("denominator_se", i, _total_se("w") if t.denominator == ALL else none)
            put("mean_value", i, mean)
            put("mean_value_low", i, f"{mean} - {half}")
            put("mean_value_upp", i, f"{mean} + {half}")
            put("mean_value_se", i, _MEAN_SE)
        else:
            same = t.denominator in (None, t.numerator)
            prefix = "" if same else "base_"
            put("num_obs_uw", i, "base_a")
            put("num_obs_uw_se", i, _total_se("a", "base_"))
            put("denominator", i, f"{prefix}b")
            put("denominator_se", i, _total_se("b", prefix))
            put(f"{t.numerator}_total", i, "b")
            put(f"{t.numerator}_total_se", i, _total_se("b"))
            put(f"{t.base}_total", i, "base_b")
            put(f"{t.base}_total_se", i, _total_se("b", "base_"))
            put("mean_value", i, f"round(try_divide(b, base_b), {t.digits})")
    return wide.selectExpr(
        *one_pass.shown,
        f"{_choice([quoted(t.name) for t in tables])} AS var_name",
        *[f"{_switch(texts)} AS {column_name(c)}" for c, texts in columns.items()],
    )


def _beside(
    groups: DataFrame, by: Sequence[str], tables: Sequence[MeanTable | RatioTable], first: list[int]
) -> DataFrame:
    """Both totals of a ratio in one record, and the table's number as ``request``."""
    sizes = [1 if isinstance(t, MeanTable) else 2 for t in tables]
    item = _choice([str(i) for i, size in enumerate(sizes) for _ in range(size)])
    parts = ["n", "w", "v_w", "a", "v_a", "b", "v_b", "c_ab", "df"]
    is_first = _choice([str(x) for x in first])
    pairs = groups.selectExpr(*by, f"{item} AS request", f"{is_first} AS first", *parts)
    sums = [f"max(CASE WHEN first = 1 THEN {x} END) AS {x}" for x in parts]
    base = ["n", "a", "v_a", "b", "v_b"]
    sums += [f"max(CASE WHEN first = 0 THEN {x} END) AS base_{x}" for x in base]
    return _aggregate(pairs, ["request", *by], sums)


def _switch(texts: Sequence[str]) -> str:
    """The expression of each request, alike ones written once."""
    places: dict[str, list[str]] = {}
    for i, text in enumerate(texts):
        places.setdefault(text, []).append(str(i))
    if len(places) == 1:
        return texts[0]
    branches = [f"WHEN request IN ({', '.join(p)}) THEN {text}" for text, p in places.items()]
    return f"CASE {' '.join(branches)} END"


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns a table lacks are missing."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
