"""Tables by name: registered DataFrames first, else Spark's catalog. Loaders that register tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans import model as M


class _Frames(dict):
    """Tables by name; one that was given as a function is opened when it is first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            found = self[name] = found()
        return found

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self[name]) for name in self]


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: Mapping[str, DataFrame] = _Frames()
        self.version = 0

    def register(self, name: str, frame: DataFrame) -> None:
        self.frames[name] = frame
        self.version += 1

    def register_later(self, name: str, make: Callable[[], DataFrame]) -> None:
        """A table that ``make`` opens when a query first needs it, so unused ones cost no listing of files."""
        self.frames[name] = make
        self.version += 1

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise KeyError(f"no table {name}")

    def virtual(self, table: M.VirtualTable) -> DataFrame:
        """Inline rows; types come from all of them, whole numbers giving way to doubles."""
        fields = [_column_type(name, [r[i] for r in table.records]) for i, name in enumerate(table.fields)]
        rows = [tuple(float(v) if isinstance(f.dataType, T.DoubleType) and v is not None else v for v, f in zip(r, fields, strict=True)) for r in table.records]
        return self.spark.createDataFrame(rows, T.StructType(fields))

    # Loaders

    def create(self, name: str, schema: T.StructType | str) -> None:
        self.register(name, self.spark.createDataFrame([], schema))

    def load(self, name: str, rows: Iterable[Sequence[Any]]) -> None:
        """Appends rows to a table made by ``create``."""
        old = self.table(name)
        self.register(name, old.unionByName(self.spark.createDataFrame([tuple(r) for r in rows], old.schema)))

    def load_csv(self, name: str, path: str, delimiter: str = ",", header: bool = True, **options: Any) -> None:
        """All columns are strings unless ``inferSchema`` or ``schema`` is among the options."""
        schema = options.pop("schema", None)
        reader = self.spark.read.options(delimiter=delimiter, header=header, **options)
        self.register(name, (reader.schema(schema) if schema is not None else reader).csv(path))

    def load_file(self, name: str, path: str, kind: str = "parquet", **options: Any) -> None:
        """parquet, orc, json, avro or any other source that Spark knows."""
        self.register(name, self.spark.read.format(kind).options(**options).load(path))

    def load_jdbc(self, name: str, url: str, table: str, **options: Any) -> None:
        self.register(name, self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())

    def keep(self, name: str, frame: DataFrame) -> None:
        """A result as a table that queries and SQL can use."""
        frame.createOrReplaceTempView(name)
        self.register(name, frame)

    def stores(self) -> dict[str, T.StructType]:
        found = {n: f.schema for n, f in self.frames.items()}
        for t in self.spark.catalog.listTables():
            found.setdefault(t.name, self.spark.table(t.name).schema)
        return found


def _column_type(name: str, values: list[Any]) -> T.StructField:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int}:
        return T.StructField(name, T.LongType() if kinds else T.StringType())
    if kinds <= {int, float}:
        return T.StructField(name, T.DoubleType())
    first = next(v for v in values if v is not None)
    from pyspark.sql.types import _infer_type

    return T.StructField(name, _infer_type(first))
