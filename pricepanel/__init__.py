"""pricepanel: marketplace price panels as lazy PySpark DataFrame operators."""

from pricepanel.schemas import PANEL, PanelColumns

__all__ = ["PANEL", "PanelColumns"]
