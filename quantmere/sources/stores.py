"""Stores: keyed tables with overwrite, append, upsert and error modes.

Bounds of ``read`` are inclusive and reach the scan as filters; ``columns`` prune
it.  Upsert keeps the last written row for each (ts, asset...) key.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NotFoundError, ReadOnlyError

MODES = ("overwrite", "append", "upsert", "error")


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the row of the later frame wins for each key."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("__batch").desc())
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__batch")


class Store(ABC):
    """Common parts of all stores."""

    def __init__(self, *, read_only: bool = False, ts: str = "ts") -> None:
        self.read_only, self.ts = read_only, ts

    @abstractmethod
    def keys(self) -> list[str]: ...

    @abstractmethod
    def _load(self, key: str) -> DataFrame: ...

    def _save(self, key: str, df: DataFrame, mode: str) -> None:
        raise ReadOnlyError(type(self).__name__)

    def delete(self, key: str) -> None:
        raise ReadOnlyError(type(self).__name__)

    def exists(self, key: str) -> bool:
        return key in self.keys()

    def _key(self, key: str | None) -> str:
        if key is not None:
            return key
        keys = self.keys()
        if len(keys) != 1:
            raise NotFoundError(f"a key is needed: {len(keys)} are stored")
        return keys[0]

    def read(self, key: str | None = None, *, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
        key = self._key(key)
        if not self.exists(key):
            raise NotFoundError(key)
        df = self._load(key)
        if start is not None:
            df = df.filter(F.col(self.ts) >= F.lit(start))
        if end is not None:
            df = df.filter(F.col(self.ts) <= F.lit(end))
        return df.select(self.ts, *[c for c in columns if c != self.ts]) if columns else df

    def last_index(self, key: str | None = None):
        """Largest time stored, None where nothing is."""
        key = self._key(key)
        return self._load(key).agg(F.max(self.ts)).first()[0] if self.exists(key) else None

    def _row_keys(self, df: DataFrame) -> list[str]:
        return [c for c in (self.ts, "asset", "series") if c in df.columns]

    def write(self, key: str, df: DataFrame, *, mode: str = "overwrite") -> None:
        if self.read_only:
            raise ReadOnlyError(type(self).__name__)
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if self.ts not in df.columns:
            raise ValueError(f"frames need a column {self.ts!r}")
        there = self.exists(key)
        if mode == "error" and there:
            raise FileExistsError(key)
        if mode == "upsert" and there:
            self._save(key, upsert_rows(self._load(key), df, self._row_keys(df)), "replace")
        else:
            self._save(key, df, "append" if mode == "append" and there else "replace")

    def sync_to(self, sink: Store, *, key: str | None = None, source_key: str | None = None, start=None, end=None, mode: str = "upsert") -> DataFrame:
        """Read here, write there; returns what was read."""
        df = self.read(source_key, start=start, end=end)
        sink.write(key or source_key or self._key(None), df, mode=mode)
        return df


class MemoryStore(Store):
    """Frames by name in this process."""

    def __init__(self, initial: dict[str, DataFrame] | None = None, **options) -> None:
        super().__init__(**options)
        self.frames = dict(initial or {})

    def keys(self) -> list[str]:
        return sorted(self.frames)

    def _load(self, key: str) -> DataFrame:
        return self.frames[key]

    def _save(self, key: str, df: DataFrame, mode: str) -> None:
        self.frames[key] = self.frames[key].unionByName(df) if mode == "append" else df

    def delete(self, key: str) -> None:
        self.frames.pop(key, None)


class ParquetStore(Store):
    """One Parquet directory per key under a root of any Hadoop file system; '/' in a key nests."""

    def __init__(self, spark: SparkSession, root: str, **options) -> None:
        super().__init__(**options)
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keys(self) -> list[str]:
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        out, stack = [], [root]
        base = root.toUri().getPath().rstrip("/")
        while stack:
            here = stack.pop()
            children = list(fs.listStatus(here))
            if any(c.isFile() and c.getPath().getName().endswith(".parquet") for c in children):
                out.append(here.toUri().getPath()[len(base) + 1 :])
            else:
                stack += [c.getPath() for c in children if c.isDirectory() and c.getPath().getName()[0] not in "._"]
        return sorted(out)

    def exists(self, key: str) -> bool:
        fs, p = self._fs(f"{self.root}/{key}")
        return bool(fs.exists(p))

    def _load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{key}")

    def _save(self, key: str, df: DataFrame, mode: str) -> None:
        path = f"{self.root}/{key}"
        if mode == "append":
            df.write.mode("append").parquet(path)
            return
        # the new rows may be read from the old files: write beside them, then swap
        fresh = f"{self.root}/.new-{key.replace('/', '-')}"
        df.write.mode("overwrite").parquet(fresh)
        fs, old = self._fs(path)
        fs.delete(old, True)
        fs.mkdirs(old.getParent())
        fs.rename(self._fs(fresh)[1], old)
        self.spark.catalog.refreshByPath(path)

    def delete(self, key: str) -> None:
        fs, p = self._fs(f"{self.root}/{key}")
        fs.delete(p, True)


class TableStore(Store):
    """Catalog tables, '/' in a key written as '__'."""

    def __init__(self, spark: SparkSession, database: str = "default", **options) -> None:
        super().__init__(**options)
        self.spark, self.database = spark, database

    def _name(self, key: str) -> str:
        return f"{self.database}.{key.replace('/', '__')}"

    def keys(self) -> list[str]:
        return sorted(t.name.replace("__", "/") for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def exists(self, key: str) -> bool:
        return self.spark.catalog.tableExists(self._name(key))

    def _load(self, key: str) -> DataFrame:
        return self.spark.table(self._name(key))

    def _save(self, key: str, df: DataFrame, mode: str) -> None:
        if mode == "append":
            df.write.mode("append").saveAsTable(self._name(key))
            return
        fresh = self._name(f"{key}__new")
        df.write.mode("overwrite").saveAsTable(fresh)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(key)}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self._name(key)}")

    def delete(self, key: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(key)}")


class CsvStore(Store):
    """A CSV file, or a directory of one file per asset, the asset being the file's stem."""

    def __init__(self, spark: SparkSession, path: str, *, date_col: str = "date", assets: list[str] | None = None, read_only: bool = True, **options) -> None:
        super().__init__(read_only=read_only, **options)
        self.spark, self.path, self.date_col, self.assets = spark, path, date_col, assets

    def keys(self) -> list[str]:
        return [self.path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")]

    def _load(self, key: str) -> DataFrame:
        raw = self.spark.read.option("header", True).option("inferSchema", True).csv(self.path)
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?$", 1)
        df = raw.withColumn("asset", stem) if "asset" not in raw.columns else raw
        df = df.withColumn(self.ts, F.col(self.date_col).cast("timestamp"))
        df = df.drop(self.date_col) if self.date_col != self.ts else df
        return df.filter(F.col("asset").isin(self.assets)) if self.assets else df

    def write(self, key: str, df: DataFrame, *, mode: str = "overwrite") -> None:
        if self.read_only:
            raise ReadOnlyError("CsvStore")
        if mode != "overwrite":
            raise NotImplementedError("CSV can only be overwritten")
        df.withColumnRenamed(self.ts, self.date_col).write.mode("overwrite").option("header", True).csv(self.path)


class ServerTable(Store):
    """A read-only server table over JDBC: asset columns, timeframe, renamed fields, features.

    Time, asset and timeframe conditions are plain filters that Spark pushes to
    the server.  ``frame`` may stand in for the connection.
    """

    FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}

    def __init__(
        self, spark: SparkSession, table: str, *, url: str | None = None, properties: dict[str, str] | None = None, asset_cols: tuple[str, ...] = ("code",), separator: str = ":",
        timestamp_col: str = "timestamp", timeframe_col: str | None = None, timeframe: str | None = None, ohlcv_map: dict[str, str] | None = None, features: list[str] | str = "*",
        where: str | None = None, partition: dict[str, str] | None = None, frame: DataFrame | None = None, **options,
    ) -> None:
        super().__init__(read_only=True, **options)
        self.spark, self.table, self.url, self.properties = spark, table, url, properties or {}
        self.asset_cols, self.separator, self.timestamp_col = list(asset_cols), separator, timestamp_col
        self.timeframe_col, self.timeframe, self.map, self.features = timeframe_col, timeframe, ohlcv_map or self.FIELDS, features
        self.where, self.partition, self.frame = where, partition or {}, frame

    def _base(self) -> DataFrame:
        df = self.frame
        if df is None:
            reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=self.table, **self.properties, **self.partition)
            df = reader.load()
        if self.timeframe_col and self.timeframe:
            df = df.filter(F.col(self.timeframe_col) == self.timeframe)
        return df.filter(self.where) if self.where else df

    def _asset(self):
        return F.concat_ws(self.separator, *[F.col(c) for c in self.asset_cols])

    def keys(self) -> list[str]:
        return [r[0] for r in self._base().select(self._asset().alias("a")).distinct().orderBy("a").collect()]

    def exists(self, key: str) -> bool:
        return bool(self._of(key).limit(1).count())

    def _of(self, key: str | None) -> DataFrame:
        df = self._base()
        if key:
            for c, v in zip(self.asset_cols, key.split(self.separator), strict=True):
                df = df.filter(F.col(c) == v)
        return df

    def _load(self, key: str) -> DataFrame:
        return self._shaped(self._of(key))

    def read_all(self) -> DataFrame:
        return self._shaped(self._base())

    def _shaped(self, df: DataFrame) -> DataFrame:
        """Renamed and deduplicated: for each (ts, asset) the last row in the order of all its columns."""
        taken = {self.timestamp_col, *self.asset_cols, *self.map, *([self.timeframe_col] if self.timeframe_col else [])}
        extra = [c for c in df.columns if c not in taken] if self.features == "*" else list(self.features)
        fields = [c for c in self.map if c in df.columns]
        out = df.select(F.col(self.timestamp_col).alias(self.ts), self._asset().alias("asset"), *[F.col(c).alias(self.map[c]) for c in fields], *extra)
        rest = [c for c in out.columns if c not in (self.ts, "asset")]
        w = Window.partitionBy(self.ts, "asset").orderBy(*[F.col(c).desc_nulls_last() for c in rest])
        return out.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")

    def last_index(self, key: str | None = None):
        return self._of(key).agg(F.max(self.timestamp_col)).first()[0]

    def asset_ranges(self) -> DataFrame:
        """(asset, first, last, rows)."""
        return self._base().groupBy(self._asset().alias("asset")).agg(F.min(self.timestamp_col).alias("first"), F.max(self.timestamp_col).alias("last"), F.count("*").alias("rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
