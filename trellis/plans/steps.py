"""Pipelines of named kernels: the declared steps become one lazy plan.

A kernel maps a grid to a grid. Boundary conditions are stated once; a kernel says how deep its stencils reach, and gets a grid that
goes that far beyond each face that isn't periodic. Reductions by name are there for later kernels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boundary import Condition, surround
from ..runtime import settled
from ..spec import AXES, GridSpec

KERNELS: dict[str, Kernel] = {}


@dataclass(frozen=True)
class Kernel:
    run: Callable[..., DataFrame]
    reach: int = 0
    reads: tuple[str, ...] = ()

    def __call__(self, grid: DataFrame, spec: GridSpec, **inputs) -> DataFrame:
        return self.run(grid, spec, **inputs)


def kernel(reach: int = 0, reads: tuple[str, ...] = ()):
    """Registers a function (grid, spec, **inputs) -> grid under its name."""

    def wrap(f):
        KERNELS[f.__name__] = Kernel(f, reach, reads)
        return KERNELS[f.__name__]

    return wrap


@dataclass
class Steps:
    """Kernels in order. `conditions` by field; `inputs` are handed to the kernels that name them; outputs go to `results`."""

    spec: GridSpec
    conditions: dict[str, Condition] = field(default_factory=dict)
    calls: list[tuple[str, Kernel, dict]] = field(default_factory=list)
    results: dict[str, float] = field(default_factory=dict)

    def call(self, k: Kernel | str, **inputs) -> Steps:
        name = k if isinstance(k, str) else next((n for n, v in KERNELS.items() if v is k), "kernel")
        self.calls.append((name, KERNELS[k] if isinstance(k, str) else k, inputs))
        return self

    def reduce(self, **aggregates: Column) -> Steps:
        """Scalars for later calls: inputs given as strings name them."""
        self.calls.append(("reduce", Kernel(lambda g, s: g), aggregates))
        return self

    def run(self, grid: DataFrame, times: int = 1, settle: int = 4) -> DataFrame:
        for k in range(times):
            for name, kern, inputs in self.calls:
                if name == "reduce":
                    grid = settled(grid)  # else the kernels before it would run once for the scalars and again for the grid
                    self.results |= grid.agg(*(c.alias(n) for n, c in inputs.items())).first().asDict()
                    continue
                given = {a: self.results.get(v, v) if isinstance(v, str) else v for a, v in inputs.items()}
                source = grid
                if kern.reach and not all(self.spec.periodic):
                    fields = kern.reads or tuple(c for c in grid.columns if c not in AXES)
                    source = surround(grid.select(*AXES, *fields), self.spec, {f: self.conditions.get(f, Condition("symmetric")) for f in fields}, kern.reach)
                grid = kern(source, self.spec, **given)
            if times > 1 and k % settle == settle - 1:
                grid = settled(grid)
        return grid


def windowed(grid: DataFrame, change: dict[str, Column], where: Column) -> DataFrame:
    """Fields changed in part of the grid; cells outside keep what they have."""
    return grid.withColumns({f: F.when(where, c).otherwise(F.col(f)) for f, c in change.items()})
