"""Seasonal index of a clean panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricepanel.operators import panel as P
from pricepanel.operators import seasonal as N
from pricepanel.schemas import PANEL, PanelColumns
from pricepanel.session import stage


def weekly_panel(panel: DataFrame, anchor: str, min_weeks: int = N.MIN_WEEKS, cols: PanelColumns = PANEL) -> DataFrame:
    """Gap-free weekly prices of the products seen often enough.

    The weekly means are small beside the quotes and read several times, so
    they are staged.
    """
    weekly = stage(N.weekly_means(P.lowest_vs_anchor(panel, anchor, cols), cols), "weekly")
    return N.keep_frequent(N.fill_weeks(weekly, cols), min_weeks, cols)


def seasonal_index(panel: DataFrame, anchor: str, master: DataFrame, min_weeks: int = N.MIN_WEEKS, cols: PanelColumns = PANEL) -> DataFrame:
    changes = N.with_initial_change(weekly_panel(panel, anchor, min_weeks, cols), cols)
    return N.seasonal_index(changes, master, cols)
