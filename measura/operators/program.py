"""A builder for straight-line exact programs: a list of named steps that becomes a chain of columns.

All values are BIGINT and overflow raises (ANSI), as does division by zero; nothing is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measura.functions.exact import gcd, ladder_rungs, wrapped


class Program:
    def __init__(self, steps: tuple[tuple[str, Column], ...] = ()) -> None:
        self.steps = steps

    def _with(self, name: str, value: Column) -> Program:
        return Program((*self.steps, (name, value.cast("long"))))

    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def apply(self, df: DataFrame) -> DataFrame:
        """df with a column for each step; later steps may read earlier ones."""
        for name, value in self.steps:
            df = df.withColumn(name, value)
        return df

    def field(self, name: str, column: str) -> Program:
        return self._with(name, F.col(column))

    def constant(self, name: str, value: int) -> Program:
        return self._with(name, F.lit(value))

    def _two(self, name: str, left: str, right: str, f: Callable[[Column, Column], Column]) -> Program:
        return self._with(name, f(F.col(left), F.col(right)))

    def sum(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, lambda a, b: a + b)

    def difference(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, lambda a, b: a - b)

    def product(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, lambda a, b: a * b)

    def quotient(self, name: str, left: str, right: str) -> Program:
        """Toward zero."""
        return self._with(name, F.expr(f"`{left}` div `{right}`"))

    def exact_quotient(self, name: str, left: str, right: str) -> Program:
        """A remainder fails the query."""
        return self._with(name, F.expr(f"if(`{left}` % `{right}` = 0, `{left}` div `{right}`, raise_error('not divisible'))"))

    def remainder(self, name: str, left: str, right: str) -> Program:
        """With the sign of the left side."""
        return self._two(name, left, right, lambda a, b: a % b)

    def absolute(self, name: str, of: str) -> Program:
        return self._with(name, F.abs(F.col(of)))

    def compare(self, name: str, left: str, right: str) -> Program:
        """1, 0 or -1."""
        return self._two(name, left, right, lambda a, b: F.when(a > b, 1).when(a < b, -1).otherwise(0))

    def gcd(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, gcd)

    def ladder(self, name: str, left: str, right: str, rungs: int = 60) -> Program:
        """How many rungs of 1, 1, 2, 3, 5 ... times the right side the left side reaches, with its sign."""
        line = F.array(*(F.lit(r).cast("long") for r in ladder_rungs(rungs)))
        reached = lambda a, b: F.size(F.filter(line, lambda r: r * F.abs(b) <= F.abs(a)))
        return self._two(name, left, right, lambda a, b: F.sign(a).cast("long") * reached(a, b))

    def xor(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, lambda a, b: a.bitwiseXOR(b))

    def band(self, name: str, left: str, right: str) -> Program:
        return self._two(name, left, right, lambda a, b: a.bitwiseAND(b))

    def wrap(self, name: str, of: str, bits: int) -> Program:
        """The low bits as a signed value."""
        return self._with(name, wrapped(F.col(of), bits))

    def table(self, name: str, of: str, values: list[int]) -> Program:
        """Entry of a table whose length is a power of two, by the low bits."""
        line = F.array(*(F.lit(v).cast("long") for v in values))
        return self._with(name, F.get(line, F.abs(F.col(of)).bitwiseAND(F.lit(len(values) - 1)).cast("int")))

    def lane(self, name: str, column: str) -> Program:
        """The lane number, which the caller keeps as a column."""
        return self._with(name, F.col(column))
