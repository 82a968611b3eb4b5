"""Guardrails: bounds on what a layer holds, which a collapsed or half-empty build breaks. They are no analytical thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Guard:
    """An aggregate of a table, null counted as 0, and the bounds it must keep; a guard that does not block only warns."""

    name: str
    measure: Column
    least: float | None = None
    most: float | None = None
    blocks: bool = True

    def judged(self, value) -> dict:
        value = float(value or 0)
        good = (self.least is None or value >= self.least) and (self.most is None or value <= self.most)
        return {"guard": self.name, "value": value, "least": self.least, "most": self.most, "state": "PASS" if good else "FAIL" if self.blocks else "WARN"}


def least_rows(n: int, blocks: bool = True) -> Guard:
    return Guard("rows", F.count("*"), least=n, blocks=blocks)


def declared_rows(n: int) -> Guard:
    """As many rows as the build says it has."""
    return Guard("declared_rows", F.count("*"), least=n, most=n)


def least_of_each(column: str, floors: dict[str, int], blocks: bool = True) -> list[Guard]:
    """A floor for each mode: all together can look healthy while one has gone."""
    return [Guard(f"{column}={mode}", F.count_if(F.col(column) == mode), least=n, blocks=blocks) for mode, n in sorted(floors.items())]


def most_share(name: str, condition: Column, share: float, blocks: bool = True) -> Guard:
    """At most this share of the rows, as of unclassified ones; no rows have no share."""
    return Guard(name, F.try_divide(F.count_if(condition), F.count("*")), most=share, blocks=blocks)


def least_ratio(name: str, part: Column, whole: Column, ratio: float, blocks: bool = True) -> Guard:
    """At least so many rows of one kind for each of another."""
    return Guard(name, F.try_divide(F.count_if(part), F.count_if(whole)), least=ratio, blocks=blocks)


def none_where(name: str, condition: Column, blocks: bool = True) -> Guard:
    return Guard(name, F.count_if(condition), most=0, blocks=blocks)


def report(df: DataFrame, guards: list[Guard]) -> DataFrame:
    """(guard, value, least, most, state) of a table that is already there, in one pass."""
    measured = df.agg(*(F.coalesce(g.measure.cast("double"), F.lit(0.0)).alias(f"g{i}") for i, g in enumerate(guards)))
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    rows = F.array(*(F.struct(F.lit(g.name).alias("guard"), F.col(f"g{i}").alias("value"), number(g.least).alias("least"), number(g.most).alias("most"), F.lit(g.blocks).alias("blocks")) for i, g in enumerate(guards)))
    tall = measured.select(F.explode(rows).alias("r")).select("r.*")
    good = (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("most").isNull() | (F.col("value") <= F.col("most")))
    return tall.select("guard", "value", "least", "most", F.when(good, "PASS").when(F.col("blocks"), "FAIL").otherwise("WARN").alias("state"))
