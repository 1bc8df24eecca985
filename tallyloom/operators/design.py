"""A survey design: rows with their weight, stratum and sampling unit."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.codes import name


@dataclass(frozen=True)
class SurveyDesign:
    """Rows plus the columns that say how they were sampled.

    Without ``weight`` every row counts 1, without ``strata`` there is one
    stratum, without ``psu`` each row is its own sampling unit; sampling units
    are nested in their stratum.  A row without a weight counts as sampled with
    weight zero.  ``lonely`` says what a stratum with a single sampling unit
    does: ``"fail"`` stops the query, ``"zero"`` adds no variance.

    ``deferred`` maps a column that is missing everywhere unless some row of the table meets a
    condition to its values row by row and the flag of that condition.  Estimates then take both
    from their own pass over the rows, and the whole table is ``frame``.

    Filtering rows of ``frame`` changes the design.  To study a part of the
    sample pass ``where`` to the estimator, which keeps the stratum sizes.
    """

    frame: DataFrame
    weight: str | None = None
    strata: str | None = None
    psu: str | None = None
    lonely: str = "fail"
    deferred: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.lonely not in ("fail", "zero"):
            raise ValueError(f"lonely must be 'fail' or 'zero', not {self.lonely!r}")
        for column in (self.weight, self.strata, self.psu):
            if column is not None and column not in self.frame.columns:
                raise ValueError(f"no column {column!r} in the design frame")

    def derive(self, **columns: str) -> SurveyDesign:
        """The same design with derived columns, given as SQL expressions."""
        kept = [name(c) for c in self.frame.columns if c not in columns]
        derived = [f"{text} AS {name(c)}" for c, text in columns.items()]
        return replace(self, frame=self.frame.selectExpr(*kept, *derived))

    def strata_sizes(self) -> DataFrame:
        """Number of sampling units in every stratum of the full design."""
        stratum = F.col(name(self.strata)) if self.strata else F.lit(None).cast("string")
        units = self.frame.groupBy(stratum.alias("stratum"))
        if self.psu is None:
            return units.agg(F.count(F.lit(1)).alias("n_h"))
        return units.agg(F.count_distinct(F.col(name(self.psu))).alias("n_h"))
