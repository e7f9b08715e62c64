"""Pipelines of named nodes.

A node is a function from DataFrames to a DataFrame. Nothing runs until a result is read, and the result of
every node can be inspected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Pipeline:
    results: dict[str, DataFrame] = field(default_factory=dict)

    def add_input(self, name: str, df: DataFrame) -> Pipeline:
        return self._put(name, df)

    def add_node(self, name: str, fn: Callable[..., DataFrame], inputs: list[str]) -> Pipeline:
        missing = [i for i in inputs if i not in self.results]
        if missing:
            raise KeyError(f"node {name!r} reads unknown nodes {missing}")
        return self._put(name, fn(*[self.results[i] for i in inputs]))

    def add_branches(self, name: str, fn: Callable[[DataFrame], tuple[DataFrame, ...]], source: str) -> Pipeline:
        """A node with several outputs, named name.output_1, name.output_2, ..."""
        for i, df in enumerate(fn(self.results[source]), start=1):
            self._put(f"{name}.output_{i}", df)
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.results[name]

    def _put(self, name: str, df: DataFrame) -> Pipeline:
        if name in self.results:
            raise ValueError(f"node {name!r} exists")
        self.results[name] = df
        return self
