"""Statements to DataFrames: names and kinds are resolved first, Catalyst plans the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.values import kind_of, rendered_double
from larkspur.operators.relational import HIDDEN, count_star, live
from larkspur.plans import messages as M
from larkspur.plans.dialect import ColRef, DialectError, Select, TableRef, Term

_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True)
class Input:
    """One table of a query: the rows that are alive, under a handle of its own."""

    ref: TableRef
    df: DataFrame
    handle: str

    def find(self, name: str) -> tuple[Column, str, str] | None:
        for f in self.df.schema.fields:
            if f.name.lower() == name.lower():
                return F.col(f"{self.handle}.`{f.name}`"), kind_of(f.dataType), f.name
        return None

    def named(self, qualifier: str) -> bool:
        return qualifier.lower() in {self.ref.name.lower(), (self.ref.alias or self.ref.name).lower()}


def resolve(ref: ColRef, inputs: list[Input]) -> tuple[Column, str, str] | None:
    """Column, kind and declared name; the left input is asked first for a qualifier; None if unknown or ambiguous."""
    if ref.qualifier:
        side = next((i for i in inputs if i.named(ref.qualifier)), None)
        return side.find(ref.name) if side else None
    found = [x for x in (i.find(ref.name) for i in inputs) if x]
    return found[0] if len(found) == 1 else None


def predicate(term: Term, column: Column, kind: str) -> Column:
    """Kinds decide before Spark compares: a mismatch, or NULL, is false."""
    value = term.value
    if kind in ("int", "float") and value.kind in ("int", "float"):
        return _COMPARE[term.op](column, F.lit(value.value if kind == "int" else float(value.value)))
    if kind == value.kind == "str":
        return _COMPARE[term.op](column, F.lit(value.value))
    return F.lit(False)


def where_chain(select: Select, inputs: list[Input], unknown: str) -> Column | None:
    groups = []
    for group in select.where:
        terms = []
        for t in group:
            found = resolve(t.column, inputs)
            if not found:
                raise DialectError(unknown.format(t.column))
            terms.append(predicate(t, found[0], found[1]))
        groups.append(reduce(Column.__and__, terms))
    return reduce(Column.__or__, groups) if groups else None


def join_condition(a: tuple[Column, str, str], b: tuple[Column, str, str]) -> Column:
    """Numbers as numbers (mixed ones as doubles), anything else by its text."""
    (x, kx, _), (y, ky, _) = a, b
    if kx == ky and kx in ("int", "float", "str"):
        return x == y
    if {kx, ky} == {"int", "float"}:
        return x.cast("double") == y.cast("double")
    text = lambda c, k: rendered_double(c.cast("double")) if k == "float" else c.cast("string")
    return text(x, kx) == text(y, ky)


def lower(select: Select, table: Callable[[str], DataFrame], now: int) -> DataFrame:
    """The query over the rows alive at ``now``; table(name) raises for an unknown one."""
    inputs = [Input(select.table, live(table(select.table.name), now).alias("l"), "l")]
    if select.join:
        inputs.append(Input(select.join, live(table(select.join.name), now).alias("r"), "r"))
        if select.count_alias is not None:
            raise DialectError(M.COUNT_JOIN)
        sides = [resolve(ref, inputs) for ref in select.on]
        if None in sides:
            raise DialectError(M.JOIN_COLUMN)
        df = inputs[0].df.join(inputs[1].df, join_condition(*sides), "inner")
    else:
        df = inputs[0].df
    chosen = where_chain(select, inputs, M.WHERE_COLUMN if select.join else M.COLUMN)
    columns = []
    for ref, alias in select.items:
        # over one table a qualifier says nothing that the name does not
        found = resolve(ref if select.join else ColRef(ref.name), inputs)
        if not found:
            raise DialectError(M.COLUMN.format(ref))
        columns.append(found[0].alias(alias or found[2]))
    if chosen is not None:
        df = df.where(chosen)
    if select.count_alias is not None:
        return count_star(df, select.count_alias)
    return df.select(*columns) if columns else df.select(*[F.col(f"{i.handle}.`{c}`") for i in inputs for c in i.df.columns if c not in HIDDEN])
