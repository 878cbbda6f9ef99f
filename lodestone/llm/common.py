"""What the operators share: reading tables, partition counts, packed arrays."""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import keep, scope

__all__ = ["filtered_join", "keep", "mix64", "partitions", "pieces_of", "row_key", "scope", "semi", "small_batches", "table"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces_of(batches, size, most_bytes: int = 8 << 20, most_rows: int = 4096):
    """Cut pandas batches so that each piece holds few rows and few bytes of text."""
    for pdf in batches:
        if len(pdf) == 0:
            continue
        sizes = np.fromiter((size(row) for row in pdf.itertuples(index=False)), np.int64, len(pdf))
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield pdf.iloc[start:i]
                start, total = i, 0
            total += int(n)
        yield pdf.iloc[start:]


#: Settings under which a filtered join of any size gets its Bloom filter; the filter's size is bounded.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "8000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 26),
}


def filtered_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that Spark precedes by a Bloom filter of bounded size on the key, so that most rows
    without a partner are not shuffled. Without the filter the result is the same. A scope with the
    settings BLOOM puts the session's own back.
    """
    for k, v in BLOOM.items():
        rows.sparkSession.conf.set(k, v)
    # Always true: Spark makes the filter only for keys that are themselves filtered.
    return rows.join(keys.filter(F.xxhash64(*on) >= F.lit(-2 ** 63)), on, how)


def row_key(*names: str) -> Column:
    """A 64-bit key of a document's row by its doc_id and the columns `names`, any of which may be null."""
    cols = [F.col("doc_id").cast("long"), *[F.col(c) for c in names]]
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def semi(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns are among `keys`."""
    return filtered_join(rows, keys, keys.columns, "left_semi")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole documents go to Python workers; a batch of the default number of rows can fill their memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
