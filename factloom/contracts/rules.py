"""Contracts as data: a record's rules by reason code, and ``violations`` that names those a row breaks. Nothing is raised in an executor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.metrics import reasons

# Forms of identities, digests, media types, hosts, instants and days.
IDENT = r"^[a-z0-9][a-z0-9._-]{0,127}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"
MEDIA = r"^[a-z0-9][a-z0-9.+-]*/[a-z0-9][a-z0-9.+-]*$"
HOST = r"^https://(?!([0-9]{1,3}\.){3}[0-9]{1,3}(/|$))([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(/[^\s?#]*)?$"
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
HEAD = r"^[0-9a-f]{40}$"
REFERENCE = r"^canonical:[a-z0-9][a-z0-9._-]{0,127}#[a-z0-9][a-z0-9._-]{0,127}$"


@dataclass
class Contract:
    """``rules()``: reason -> what must hold (unknown counts as broken). ``valid``: a record that keeps it, as SQL; ``broken``: changes and the reasons they give."""

    rules: Callable[[], dict[str, Column]]
    valid: dict[str, str]
    broken: list[tuple[dict[str, str], str]] = field(default_factory=list)


CONTRACTS: dict[str, dict[str, Contract]] = {}


def contract(family: str, valid: dict[str, str], *broken: tuple[dict[str, str], str]):
    """Register the rules of a record under its family."""

    def add(rules):
        CONTRACTS.setdefault(family, {})[rules.__name__] = Contract(rules, valid, list(broken))
        return rules

    return add


def violations(records: DataFrame, rules: Callable[[], dict[str, Column]]) -> DataFrame:
    """The records with the names of the rules that each breaks, in their order; an empty text if it keeps all."""
    return records.withColumn("violations", reasons(rules()))


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def ident(c) -> Column:
    return col(c).rlike(IDENT)


def digest(c) -> Column:
    return col(c).rlike(DIGEST)


def text(c, most: int, least: int = 1) -> Column:
    """So many signs, none of them a control sign besides tab and line ends."""
    return F.length(col(c)).between(least, most) & ~col(c).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def media(c) -> Column:
    return col(c).rlike(MEDIA) & (F.length(col(c)) <= 192)


def locator(c) -> Column:
    """https, a host of labels and no address literal, no query."""
    return col(c).rlike(HOST) & (F.length(col(c)) <= 2048)


def instant(c) -> Column:
    return col(c).rlike(INSTANT) & F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()


def day(c) -> Column:
    return col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(col(c), "yyyy-MM-dd").isNotNull()


def among(c, *values: str) -> Column:
    return col(c).isin(*values)


def optional(c, rule: Callable) -> Column:
    return col(c).isNull() | rule(c)


def many(c, low: int, high: int) -> Column:
    return F.size(col(c)).between(low, high)


def each(c, rule: Callable[[Column], Column]) -> Column:
    return F.forall(col(c), lambda x: F.coalesce(rule(x), F.lit(False)))


def distinct(c, key: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.size(F.array_distinct(F.transform(col(c), key))) == F.size(col(c))


def ids(c, low: int = 0, high: int = 10_000) -> Column:
    return many(c, low, high) & each(c, ident) & distinct(c)


def no_authority(*names: str) -> Column:
    """Every one of these flags is false: a record grants nothing by itself."""
    return F.forall(F.array(*[F.coalesce(F.col(n), F.lit(True)) for n in names]), lambda x: ~x)


def span(c) -> Column:
    return (col(c)["start"] >= 0) & (col(c)["end"] >= col(c)["start"])
