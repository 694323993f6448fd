"""Connectors of one's own: a table that Python code reads in parallel, with columns and filters handed down to it.

A connector names its schema, cuts a read into parts, and gives each part's rows as Arrow batches. It becomes a Spark data source, so
that its tables are planned, joined and aggregated like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Filters as (column, operator, value), as ``tabular.where_sql`` takes them.
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Connector:
    """What a table needs; made anew by each worker from the options of the read. ``name`` is its format's."""

    name = "connector"

    def __init__(self, options: dict[str, str]):
        self.options = options

    def schema(self) -> str:
        """In DDL."""
        raise NotImplementedError

    def parts(self, filters: list[tuple[str, str, object]]) -> list:
        """What can be read apart, each a value that can be pickled."""
        return [None]

    def accepts(self, name: str, operator: str, value: object) -> bool:
        """Whether the connector applies this filter itself, for every row. What it declines Spark applies."""
        return False

    def read(self, part, filters: list[tuple[str, str, object]]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class Part(InputPartition):
    def __init__(self, value):
        super().__init__(value)


def as_triple(f: Filter) -> tuple[str, str, object] | None:
    if isinstance(f, (IsNull, IsNotNull)):
        return ".".join(f.attribute), "=" if isinstance(f, IsNull) else "<>", None
    if isinstance(f, In):
        return ".".join(f.attribute), "IN", tuple(f.value)
    return (".".join(f.attribute), OPERATORS[type(f)], f.value) if type(f) in OPERATORS else None


class Reader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector, self.filters = connector, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            triple = as_triple(f)
            if triple is not None and self.connector.accepts(*triple):
                self.filters.append(triple)
            else:
                yield f

    def partitions(self):
        return [Part(p) for p in self.connector.parts(self.filters)] or [Part(None)]

    def read(self, partition: Part):
        yield from self.connector.read(partition.value, self.filters)


def register(spark: SparkSession, kind: type[Connector]) -> None:
    """Makes ``kind`` a format of ``spark.read``; options are handed to it. Filters are handed down, which the session is set to do."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind.name

        def schema(self) -> str:
            return kind(dict(self.options)).schema()

        def reader(self, schema) -> DataSourceReader:
            return Reader(kind(dict(self.options)))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)


def read(spark: SparkSession, kind: type[Connector], **options: str) -> DataFrame:
    register(spark, kind)
    return spark.read.format(kind.name).options(**options).load()
