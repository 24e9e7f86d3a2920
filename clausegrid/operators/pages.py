"""Deep pages of an ordered table.

``orderBy().offset().limit()`` gathers offset + limit rows. Here the table is stored once in its
order, in files of bounded size, with the place of each file's first row; a page reads the one
or two files that hold it, however deep it lies.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_ROWS = 100_000


def store_ordered(df: DataFrame, order: list[Column], folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``df`` in ``order`` (which should name every row; equal rows stay together in any
    order) and the index of its files. Rows are dealt out by ranges, so no task sorts all."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_num", F.monotonically_increasing_id())
    placed.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(f"{folder}/rows")
    files = spark.read.parquet(f"{folder}/rows").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("_num").alias("first"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    index = files.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    index.write.mode("overwrite").parquet(f"{folder}/files")


def total(spark: SparkSession, folder: str) -> int:
    """Number of rows, from the index."""
    return spark.read.parquet(f"{folder}/files").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def files_of_page(spark: SparkSession, folder: str, offset: int, limit: int) -> list:
    """(file, start) of the files that hold rows ``offset`` to ``offset + limit``, in order."""
    index = spark.read.parquet(f"{folder}/files")
    held = index.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
    return [(r["file"], r["start"]) for r in held.orderBy("start").collect()]


def page(spark: SparkSession, folder: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the stored order, with their ``place``."""
    stored = spark.read.parquet(f"{folder}/rows")
    held = files_of_page(spark, folder, offset, limit) if limit > 0 else []
    if not held:
        return stored.limit(0).withColumn("place", F.lit(0).cast("long")).drop("_num")
    rows = spark.read.schema(stored.schema).parquet(*[f for f, _ in held])
    skipped = offset - held[0][1]
    near = rows.orderBy("_num").limit(skipped + limit)  # within the files of the page
    at = near.withColumn("place", F.row_number().over(Window.orderBy("_num")).cast("long") + held[0][1] - 1)
    return at.filter(F.col("place") >= offset).drop("_num")
