"""A registry of functions by name, which are also SQL functions of the session.

An entry is a function from Columns to a Column, so that it stays in the JVM; `install` makes its SQL form, in which the
expression is inlined by name.  Table functions are entries from DataFrames to a DataFrame, called by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geo


@dataclass(frozen=True)
class Entry:
    name: str
    parameters: tuple[tuple[str, str], ...]  # names and SQL types
    returns: str
    description: str
    body: str  # the SQL expression of the parameters


class Registry:
    def __init__(self) -> None:
        self.entries: dict[str, Entry] = {}
        self.tables: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, parameters: dict[str, str], returns: str, description: str, body: str) -> None:
        if not name.isidentifier():
            raise ValueError(f"not a name: {name}")
        if name in self.entries:
            raise ValueError(f"already registered: {name}")
        self.entries[name] = Entry(name, tuple(parameters.items()), returns, description, body)

    def add_table(self, name: str, f: Callable[..., DataFrame]) -> None:
        if name in self.tables:
            raise ValueError(f"already registered: {name}")
        self.tables[name] = f

    def definitions(self, spark: SparkSession) -> DataFrame:
        """(name, description, parameters, returns) of all entries, by name."""
        rows = [(e.name, e.description, [p for p, _ in e.parameters], e.returns) for e in sorted(self.entries.values(), key=lambda e: e.name)]
        return spark.createDataFrame(rows, "name string, description string, parameters array<string>, returns string")

    def install(self, spark: SparkSession) -> None:
        """Every entry as a temporary SQL function; its body is inlined where it is called, so nothing leaves the JVM."""
        for e in self.entries.values():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {e.name}({', '.join(f'{p} {t}' for p, t in e.parameters)}) RETURNS {e.returns} RETURN {e.body}")

    def call(self, name: str, *args: Column) -> Column:
        """The entry applied to columns, once installed; KeyError for unknown names."""
        return F.call_function(self.entries[name].name, *args)

    def table(self, name: str, *args, **kw) -> DataFrame:
        return self.tables[name](*args, **kw)


def default() -> Registry:
    r = Registry()
    r.add("haversine_km", {"lat1": "DOUBLE", "lng1": "DOUBLE", "lat2": "DOUBLE", "lng2": "DOUBLE"}, "DOUBLE", "distance on the globe", f"2 * {geo.EARTH_KM} * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2))))")
    r.add("text_tokens", {"t": "STRING"}, "INT", "a token for each four characters, at least one", "greatest(1, cast(floor(length(t) / 4) as int))")
    r.add("slug", {"t": "STRING"}, "STRING", "an anchor's name", "coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'section')")
    r.add("preview", {"t": "STRING", "n": "INT"}, "STRING", "the first n characters", "case when length(t) > n then concat(substring(t, 1, n), '…') else t end")
    r.add("midrange", {"a": "DOUBLE", "b": "DOUBLE"}, "DOUBLE", "the mean of two extremes, to one decimal", "round((a + b) / 2, 1)")
    return r


__all__ = ["Entry", "Registry", "default"]
