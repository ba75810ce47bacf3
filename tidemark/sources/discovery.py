"""Finding Parquet files by their columns, from footers alone, and reading them under names of one's own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _footer_rows(batches):
    """path, columns, rows of each file; null columns where a file has no Parquet footer. Data pages are not read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        names, rows = [], []
        for path in batch.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///") if path.startswith("file:") else path)
            try:
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                names.append(meta.schema.to_arrow_schema().names)
                rows.append(meta.num_rows)
            except pa.ArrowInvalid:
                names.append(None)
                rows.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.int64())], ["path", "columns", "rows"])


def footers(spark: SparkSession, root: str, pattern: str = "*.parquet", tasks: int | None = None) -> DataFrame:
    """(path, columns, rows) of every file under `root`, at any depth, whose name fits; columns is null for what is no Parquet.

    Spark lists the files without opening them; tasks then read each file's footer, through any file system that pyarrow knows.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "path").mapInArrow(_footer_rows, "path string, columns array<string>, rows long")


def matching(files: DataFrame, groups: Sequence[Sequence[str]], hint: str = "") -> DataFrame:
    """Those of footers() that have a column of every group, with their place: names with the hint first, then short and early paths."""
    name = F.element_at(F.split("path", "/"), -1)
    ok = F.lit(True)
    for g in groups:
        ok = ok & F.arrays_overlap("columns", F.array(*map(F.lit, g)))
    order = F.struct((~F.contains(F.lower(name), F.lit(hint.lower()))).alias("far"), F.length("path").alias("length"), F.col("path").alias("at"))
    return files.where("columns IS NOT NULL").where(ok).withColumn("place", order)


def discover(spark: SparkSession, root: str, groups: Sequence[Sequence[str]], hint: str = "") -> str:
    """The path of the first match; FileNotFoundError if no file has the columns."""
    best = matching(footers(spark, root), groups, hint).agg(F.min_by("path", "place")).first()[0]
    if best is None:
        raise FileNotFoundError(f"no Parquet file under {root} has a column of every group")
    return best


def _first(df: DataFrame, names: Sequence[str], optional: bool, to: str) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(n)
    if optional:
        return F.lit(0.0)
    raise ValueError(f"no column for {to}: {', '.join(names)}")


def totals(df: DataFrame, key: Mapping[str, Sequence[str]], amounts: Mapping[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Sums per key under one's own names. key and amounts: names and the columns that may hold them, the first one that is there.

    Keys become strings; what is no number, null or NaN counts as 0, as does an optional amount without a column.
    """
    number = lambda c: F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    keys = [_first(df, names, False, k).cast("string").alias(k) for k, names in key.items()]
    rows = df.select(*keys, *[number(_first(df, names, k in optional, k)).alias(k) for k, names in amounts.items()])
    return rows.groupBy(*key).agg(*[F.sum(k).alias(k) for k in amounts])
