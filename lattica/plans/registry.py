"""Operators by name, found by what a dataset declares."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators import metrics, select


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., object]
    required: frozenset[str]
    optional: frozenset[str]
    priority: int


_operators: list[Operator] = []


def operator(name: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = (), priority: int = 0) -> Callable[[Callable], Callable]:
    """Registers a function for a command name and the schemas that it needs."""

    def add(run: Callable) -> Callable:
        _operators.append(Operator(name, run, frozenset(required), frozenset(optional), priority))
        _operators.sort(key=lambda o: -o.priority)
        return run

    return add


def resolve(name: str, schemas: set[str]) -> Operator:
    """The operator of highest priority whose required schemas are all there."""
    for o in _operators:
        if o.name == name and o.required <= schemas:
            return o
    raise NotImplementedError(f"{name} for {sorted(schemas)}")


operator("cells", ("mesh",))(lambda mesh: mesh.cells)
operator("points", ("mesh",))(lambda mesh: mesh.points)
operator("bounds", ("mesh",))(lambda mesh: metrics.bounds(mesh.points))
operator("metrics", ("mesh",))(metrics.cell_metrics)
operator("used points", ("mesh",))(select.used_points)
