"""Catalogs laid out for their conditions: folders a scan prunes by, and rows sorted so that Parquet's statistics skip row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sizes import small


def write_catalog(rows: DataFrame, path: str, key: str, folders: tuple[str, ...] = ("y", "s"), order: tuple[str, ...] = ("lang",), rows_a_file: int = 5_000_000, row_group_bytes: int = 16 << 20) -> DataFrame:
    """Writes a catalog in a folder for each value of ``folders``, sorted by ``order`` inside, and returns it as it is read back.

    One range sort does it: tasks hold ranges of (folders, order, hash of ``key``), so few files a folder result, and a term or language
    with a third of all rows is split by the hash.  Rows without a value in ``folders`` are kept, under null; an empty string there
    becomes null too.  ``folders`` should be columns of few values, such as year and semester.
    """
    place = F.xxhash64(key)
    sorted_rows = rows.repartitionByRange(*folders, *order, place).sortWithinPartitions(*folders, *order, place)
    writer = sorted_rows.write.partitionBy(*folders).option("maxRecordsPerFile", rows_a_file).option("parquet.block.size", row_group_bytes)
    writer.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def in_folders_of(catalog: DataFrame, wanted: DataFrame, *folders: str) -> DataFrame:
    """The catalog's rows whose ``folders`` stand in some row of ``wanted``; nulls match nothing.

    A semi join whose small side prunes the catalog's folders before they are read, if ``wanted`` is filtered itself.
    """
    return catalog.join(small(wanted.select(*folders).distinct()), list(folders), "left_semi")
