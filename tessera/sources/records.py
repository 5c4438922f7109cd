"""Files of records as catalog tables: a volume is a database, a file a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from tessera.operators.sets import require_unique


@dataclass(frozen=True)
class Index:
    """An index definition. Spark keeps none: a unique one is a check, a clustered one a layout by ranges, a hashed one
    a layout in this many buckets, whose lookups read one bucket and whose joins and groupings need no shuffle."""

    column: str
    unique: bool = False
    clustered: bool = False
    buckets: int = 0


@dataclass
class Volume:
    """A database with tables in Parquet."""

    spark: SparkSession
    name: str
    indices: dict[str, list[Index]] = field(default_factory=dict)
    read_only: set[str] = field(default_factory=set)

    def create(self) -> Volume:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.name}`")
        return self

    def destroy(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.name}` CASCADE")

    def _table(self, file: str) -> str:
        return f"`{self.name}`.`{file}`"

    def create_file(self, file: str, rows: DataFrame) -> DataFrame:
        for index in self.indices.get(file, ()):
            if index.unique:
                require_unique(rows, index.column)
        for index in self.indices.get(file, ()):
            if index.clustered:
                rows = rows.repartitionByRange(index.column).sortWithinPartitions(index.column)
        self._laid(file, rows).saveAsTable(self._table(file), format="parquet", mode="overwrite")
        return self.open_file(file)

    def _laid(self, file: str, rows: DataFrame) -> DataFrameWriter:
        """A writer of rows that keeps the file's hash index, if it has one."""
        hashed = [i for i in self.indices.get(file, ()) if i.buckets]
        return rows.write.bucketBy(hashed[0].buckets, hashed[0].column).sortBy(hashed[0].column) if hashed else rows.write

    def open_file(self, file: str) -> DataFrame:
        return self.spark.table(self._table(file))

    def append(self, file: str, rows: DataFrame) -> DataFrame:
        self._check_writable(file)
        for index in self.indices.get(file, ()):
            if index.unique:
                require_unique(self.open_file(file).select(index.column).unionByName(rows.select(index.column)), index.column)
        self._laid(file, rows.select(*self.open_file(file).columns)).saveAsTable(self._table(file), format="parquet", mode="append")
        return self.open_file(file)

    def replace(self, file: str, rows: DataFrame) -> DataFrame:
        """New contents, which may be computed from the old: they are written beside and then swapped in."""
        self._check_writable(file)
        for index in self.indices.get(file, ()):
            if index.unique:
                require_unique(rows, index.column)
        beside = f"{file}__new"
        self._laid(file, rows).saveAsTable(self._table(beside), format="parquet", mode="overwrite")
        self.destroy_file(file)
        self.rename_file(beside, file)
        return self.open_file(file)

    def rename_file(self, file: str, to: str) -> None:
        self.spark.sql(f"ALTER TABLE {self._table(file)} RENAME TO {self._table(to)}")

    def destroy_file(self, file: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(file)}")

    def files(self) -> list[str]:
        return sorted(r["tableName"] for r in self.spark.sql(f"SHOW TABLES IN `{self.name}`").collect())

    def create_index(self, file: str, index: Index) -> None:
        if index.unique:
            require_unique(self.open_file(file), index.column)
        if index.buckets and any(i.buckets for i in self.indices.get(file, ())):
            raise ValueError(f"{file} has a hash index already")
        self.indices.setdefault(file, []).append(index)
        if index.clustered:
            self.replace(file, self.open_file(file).repartitionByRange(index.column).sortWithinPartitions(index.column))
        elif index.buckets:
            self.replace(file, self.open_file(file).repartition(index.buckets, index.column))

    def drop_index(self, file: str, column: str) -> None:
        """Forgets the index; a hashed file is laid out anew without buckets."""
        gone = [i for i in self.indices.get(file, ()) if i.column == column]
        self.indices[file] = [i for i in self.indices.get(file, ()) if i.column != column]
        if any(i.buckets for i in gone):
            self.replace(file, self.open_file(file))

    def protect(self, file: str, writable: bool) -> None:
        """Marks a file as writable or not; append() and replace() keep to it."""
        self.read_only.discard(file) if writable else self.read_only.add(file)

    def _check_writable(self, file: str) -> None:
        if file in self.read_only:
            raise PermissionError(file)
