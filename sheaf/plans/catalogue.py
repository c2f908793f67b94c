"""Everything that is registered: importing this module imports every query family."""

from sheaf.plans import control, diagnostics, documents, layout, progress, rules, scalars
from sheaf.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "control", "diagnostics", "documents", "layout", "progress", "rules", "scalars"]
