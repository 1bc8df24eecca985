"""Survey designs, design-based estimates, profiles and chart frames."""

from tallyloom.operators.design import SurveyDesign
from tallyloom.operators.estimate import (
    MeanTable,
    mean_table,
    mean_tables,
    ratio_table,
    total_table,
)

__all__ = [
    "MeanTable",
    "SurveyDesign",
    "mean_table",
    "mean_tables",
    "ratio_table",
    "total_table",
]
