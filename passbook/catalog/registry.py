"""Registry of queries over the test tables, each with its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from passbook.catalog.views import SPARK_VIEWS, VIEWS, view_clause
from passbook.operators.tokens import materialise

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@dataclass
class Tables:
    """Test tables and the views derived from them, read lazily."""

    spark: SparkSession
    folder: str
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def written(self, name: str) -> DataFrame:
        """A view with a window that other views name several times: worked out once and written."""
        key = f"{name} written"
        if key not in self._views:
            self._views[key] = materialise(getattr(self, name), name)
        return self._views[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.raw(name)
        if name not in VIEWS and name not in SPARK_VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            needs, text = VIEWS.get(name) or SPARK_VIEWS[name]
            again = [n for n in needs if n in VIEWS and text.count("{" + n + "}") > 1 and " over (" in VIEWS[n][1]]
            self._views[name] = self.spark.sql(
                text.format(**{n: "{" + n + "}" for n in needs}),
                **{n: self.written(n) if n in again else getattr(self, n) for n in needs},
            )
        return self._views[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``views`` names the views the SQL reads."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, str(folder).rstrip("/")))

        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = view_clause(views.split()) + sql
        return fn

    return wrap
