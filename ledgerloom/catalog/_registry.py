"""How queries are registered: a name, the ids of the operators they cover, a callable and a DuckDB statement."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import TABLES, read_table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Run
    oracle: str | None


class Registry:
    """Queries of one part of the catalogue."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(self, name: str, ids: str, run: Run, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = Query(name, ids, run, oracle)

    def sql(self, name: str, ids: str, text: str, oracle: str | None = None, **args: object) -> None:
        """A statement that runs over the tables it names; on DuckDB too, unless ``oracle`` says otherwise."""
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in used:
                read_table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(text, args=args or None)

        self.add(name, ids, run, oracle or text)

    def query(self, name: str, ids: str, oracle: str | None = None) -> Callable[[Run], Run]:
        """Decorator for a query made with the DataFrame API."""

        def register(run: Run) -> Run:
            self.add(name, ids, run, oracle)
            return run

        return register
