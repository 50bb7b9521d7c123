"""Aggregates and how each is kept up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INVERTIBLE = {"sum", "count", "avg", "group"}


@dataclass(frozen=True)
class AggSpec:
    """One output column of a reduction.

    ``kind`` is sum, count or avg, which change by what is added and taken away; min or max; or ``expr``, any SQL
    aggregate over the group, for instance ``aggregate(collect_list(value), 0D, (a, b) -> a + b)`` for a reduction
    that is associative and commutative but has no inverse. The latter three are computed anew for touched groups.
    ``group`` is a commutative group of the user's own: ``fold`` is the SQL aggregate that applies its operation to many
    values (``{}`` stands for them), ``inverse`` an expression of the value ``{}`` that takes it back, ``zero`` the value
    of nothing. It changes by what is added and taken away.
    """

    name: str
    kind: str
    value: str = "1"
    fold: str = ""
    inverse: str = "{}"
    zero: str = "null"

    @property
    def invertible(self) -> bool:
        return self.kind in INVERTIBLE

    def full(self) -> Column:
        if self.kind == "expr":
            return F.expr(self.value).alias(self.name)
        if self.kind == "group":
            return F.coalesce(F.expr(self.fold.format(f"({self.value})")), F.expr(self.zero)).alias(self.name)
        if self.kind == "count":
            return F.count(F.expr(self.value)).alias(self.name)
        return F.expr(f"{self.kind}({self.value})").alias(self.name)

    def partials(self, weight: Column) -> list[Column]:
        """Sums that add up across changes: of the weighted values, and of the weights of values that aren't null."""
        if self.kind == "group":
            value = f"({self.value})"
            moved = f"(case when _diff < 0 then {self.inverse.format(value)} else {value} end)"
            return [F.coalesce(F.expr(self.fold.format(moved)), F.expr(self.zero)).alias(f"{self.name}__g")]
        v = F.expr(self.value)
        counted = F.sum(F.when(v.isNotNull(), weight).otherwise(F.lit(0).cast("long"))).alias(f"{self.name}__n")
        return [counted] if self.kind == "count" else [counted, F.sum(v * weight).alias(f"{self.name}__s")]

    def merged(self) -> list[Column]:
        if self.kind == "group":
            return [F.expr(self.fold.format(f"{self.name}__g")).alias(f"{self.name}__g")]
        n = F.sum(f"{self.name}__n").alias(f"{self.name}__n")
        return [n] if self.kind == "count" else [n, F.sum(f"{self.name}__s").alias(f"{self.name}__s")]

    def value_of(self, prefix: str = "") -> Column:
        """The value from merged partials, which are columns behind ``prefix``."""
        if self.kind == "group":
            return F.col(f"{prefix}{self.name}__g")
        n = F.col(f"{prefix}{self.name}__n")
        if self.kind == "count":
            return n
        s = F.when(n > 0, F.col(f"{prefix}{self.name}__s"))
        return s / n if self.kind == "avg" else s


def sum_of(name: str, value: str) -> AggSpec:
    return AggSpec(name, "sum", value)


def count_of(name: str, value: str = "1") -> AggSpec:
    return AggSpec(name, "count", value)


def avg_of(name: str, value: str) -> AggSpec:
    return AggSpec(name, "avg", value)


def min_of(name: str, value: str) -> AggSpec:
    return AggSpec(name, "min", value)


def max_of(name: str, value: str) -> AggSpec:
    return AggSpec(name, "max", value)


def opaque(name: str, expr: str) -> AggSpec:
    return AggSpec(name, "expr", expr)


def group_of(name: str, value: str, fold: str, inverse: str = "{}", zero: str = "null") -> AggSpec:
    """A commutative group of the user's own, for instance exclusive or: ``group_of("x", "v", "bit_xor({})", zero="0L")``."""
    return AggSpec(name, "group", value, fold, inverse, zero)
