"""The registered queries, grouped as the operators are."""

from importlib import import_module

from tablewright.workload.registry import ORACLES, QUERIES

GROUPS = [
    "scanning", "relational", "windows", "scalars", "profiling", "detecting", "cleaning", "featurizing", "preparing",
    "evaluating", "reporting", "explaining", "learning", "clustering",
]
for _group in GROUPS:
    import_module(f"tablewright.workload.{_group}")

__all__ = ["ORACLES", "QUERIES"]
