"""Registered queries with the SQL that checks them."""

from . import catalog, companies, evaluation, extras, panels, research, screens, setups, stateful
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "companies", "evaluation", "extras", "panels", "research", "screens", "setups", "stateful"]
