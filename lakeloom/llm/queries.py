"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("p1_markup", "p2_ledger", "p3_near", "p4_knn", "p5_quality", "p6_fusion", "p7_packing", "p8_leaks", "p9_reading")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f".{_name}", __package__)
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
