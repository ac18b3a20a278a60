"""Tables with one row a key, in hash buckets below a path, that change by files and not by rewriting.

``data/<write>/bucket=<n>`` holds rows, ``versions/<number>`` one JSON text: for each bucket the writes that make it up.  A version's
file appears by one rename that fails if another writer was first, so readers see the old table or the new one.  An insert
adds a file to the buckets of its new keys; an upsert copies the buckets of its keys and leaves all others alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sizes import small
from .tables import _one_a_key


class Conflict(RuntimeError):
    """Another writer made the version; the caller may open the table again and repeat the change."""


@dataclass(frozen=True)
class KeyedTable:
    """One version.  ``parts`` maps a bucket to the writes that hold its rows; it has at most ``buckets`` entries.

    Keys are compared with null equal to null.  On a file system whose rename isn't atomic (some object stores) let one writer work at a time.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: str
    version: int
    parts: dict[int, list[str]]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other bucket's files are opened."""
        chosen = self.parts if buckets is None else {b: self.parts[b] for b in buckets if b in self.parts}
        paths = [f"{self.path}/data/{write}/bucket={b}" for b, writes in sorted(chosen.items()) for write in writes]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def find(self, wanted: DataFrame) -> DataFrame:
        """Rows of the keys of ``wanted``: only their buckets are read."""
        return self.rows(self.touched(wanted)).join(small(wanted.select(*self.keys).distinct()), list(self.keys), "left_semi")

    def upsert(self, new: DataFrame, order: Column | None = None) -> KeyedTable:
        """New rows take the place of old ones with their keys; of several with one key the last by ``order`` counts, or the greatest by its other columns."""
        chosen = _one_a_key(new, self.keys, order).select(*self._columns())
        touched = self.touched(new)
        kept = self._without(self.rows(touched), chosen)
        write = self._write(kept.unionByName(chosen))
        return self._publish({**self.parts, **{b: [write] for b in touched}})

    def insert_absent(self, new: DataFrame, order: Column | None = None) -> KeyedTable:
        """One row goes in for each key that isn't there; rows that are there stay as they are, and none is copied."""
        absent = _one_a_key(self._without(new, self.rows(self.touched(new))), self.keys, order)
        write = self._write(absent.select(*self._columns()))
        return self._publish({**self.parts, **{b: [*self.parts.get(b, []), write] for b in self._written(write)}})

    def delete(self, gone: DataFrame) -> KeyedTable:
        """The table without the keys of ``gone``."""
        touched = [b for b in self.touched(gone) if b in self.parts]
        write = self._write(self._without(self.rows(touched), gone))
        left = set(self._written(write))
        return self._publish({**{b: p for b, p in self.parts.items() if b not in touched}, **{b: [write] for b in touched if b in left}})

    # ---- parts -------------------------------------------------------------------------------------------------

    def _columns(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets``

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        gone = others.select(*(F.col(k).alias(f"_gone_{k}") for k in self.keys)).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in self.keys]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        return rows.join(gone, condition, "left_anti")

    def _write(self, rows: DataFrame) -> str:
        """Rows go to a folder of their own that no version names yet: a writer that dies here leaves the table as it was."""
        write = uuid.uuid4().hex
        named = rows.withColumn("bucket", self._bucket())
        named.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        return write

    def _written(self, write: str) -> list[int]:
        return sorted(int(n.removeprefix("bucket=")) for n in _names(self.spark, f"{self.path}/data/{write}") if n.startswith("bucket="))

    def _publish(self, parts: dict[int, list[str]]) -> KeyedTable:
        next_ = KeyedTable(self.spark, self.path, self.keys, self.buckets, self.schema, self.version + 1, parts)
        text = json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": self.schema, "parts": parts})
        _put(self.spark, f"{self.path}/versions/{next_.version:010d}", text)
        return next_


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, system = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all; raises Conflict where it is there already."""
    jvm = spark.sparkContext._jvm
    place, system = _files(spark, path)
    temporary, _ = _files(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = system.create(temporary)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if place.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(temporary, place, options)
    except Exception as error:
        system.delete(temporary, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(path) from error
        raise


def create(rows: DataFrame, path: str, *keys: str, buckets: int = 64, order: Column | None = None) -> KeyedTable:
    """A new table of the rows, one a key.  At scale, choose buckets so that one is some 100 MB to 1 GB."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return KeyedTable(rows.sparkSession, path, keys, buckets, schema, -1, {}).insert_absent(rows, order)


def open_table(spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
    """The last version, or an earlier one."""
    numbers = sorted(int(n) for n in _names(spark, f"{path}/versions") if n.isdigit())
    number = numbers[-1] if version is None else version
    found = json.loads(spark.read.text(f"{path}/versions/{number:010d}", wholetext=True).first()[0])
    return KeyedTable(spark, path, tuple(found["keys"]), found["buckets"], found["schema"], number, {int(b): p for b, p in found["parts"].items()})
