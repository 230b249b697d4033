"""Issue lists: arrays of (path, message) built from rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUES_TYPE = "array<struct<path:string,message:string>>"


def no_issues() -> Column:
    return F.array().cast(ISSUES_TYPE)


def issue(path: Column | str, message: Column | str) -> Column:
    """A list of one issue; rules give such a list, or null when they hold."""
    path = F.lit(path) if isinstance(path, str) else path
    message = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(path.alias("path"), message.alias("message")))


def unless(rule: Column, path: Column | str, message: Column | str) -> Column:
    """An issue where the rule is not true; a null rule counts as broken."""
    return F.when(~F.coalesce(rule, F.lit(False)), issue(path, message))


def issue_list(*candidates: Column) -> Column:
    """The issues of all rules in order.

    Joining short lists stays in generated code, which dropping nulls from one
    array (a higher-order function) would not.
    """
    return F.concat(*[F.coalesce(c, no_issues()) for c in candidates])


def issues_of_items(items: Column, rule: Callable[[Column, Column], Column]) -> Column:
    """The issues of every item; ``rule`` takes the item and its position."""
    found = F.flatten(F.transform(items, lambda x, i: F.coalesce(rule(x, i), no_issues())))
    return F.coalesce(found, no_issues())


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def is_number(value: Column, least: float | None = None, greatest: float | None = None) -> Column:
    """Finite and within the closed bounds; NaN sorts above all numbers, so it is tested first."""
    as_double = value.cast("double")
    rule = ~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf")))
    if least is not None:
        rule = rule & (as_double >= F.lit(float(least)))
    if greatest is not None:
        rule = rule & (as_double <= F.lit(float(greatest)))
    return F.coalesce(rule, F.lit(False))


def is_word(value: Column, words: list[str]) -> Column:
    return F.coalesce(value.isin(words), F.lit(False))
