"""Orders, limits and pages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """The size of the whole result beside each row of a page: a one-row aggregate, not a window over everything."""
    return page.crossJoin(F.broadcast(whole.agg(F.count("*").alias("total"))))


def offset_page(df: DataFrame, order: list[Any], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(max(0, int(offset))).limit(clamp(limit, most))


def keyset_page(df: DataFrame, columns: list[str], after: tuple | None, limit: int, most: int = 100, descending: bool = False) -> DataFrame:
    """Rows behind a cursor over several columns; a cursor must name them all."""
    if after is not None:
        if len(after) != len(columns) or any(v is None for v in after):
            raise ValueError("incomplete cursor")
        here = F.struct(*columns)
        there = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, after)])
        df = df.filter(here < there if descending else here > there)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    return df.orderBy(*order).limit(clamp(limit, most))


def next_cursor(page: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """The last row's cursor."""
    return page.agg((F.min if descending else F.max)(F.struct(*columns)).alias("c")).select(*[F.col(f"c.{c}").alias(c) for c in columns])


def page_with_more(df: DataFrame, order: list[Any], limit: int) -> DataFrame:
    """A page of `limit` rows and whether more follow: one row more is fetched."""
    got = df.orderBy(*order).limit(limit + 1)
    more = F.broadcast(got.agg((F.count("*") > limit).alias("has_more")))
    return got.orderBy(*order).limit(limit).crossJoin(more)


#: Rows of a range of write_paged; a range is sorted in one task.
RANGE_ROWS = 1_000_000


def write_paged(df: DataFrame, path: str, cursor: list[str], facets: tuple[str, ...] = (), ranges: int = 200, rows: int | None = None) -> None:
    """Writes a result for paging: rows in ranges of the cursor, and a directory of each range's ends and counts by facet.

    There are as many ranges as given, or more, so that one holds about RANGE_ROWS. rows is about how many rows there
    are, which are counted if it is not given. Equal cursors fall in one range. A page
    then reads the ranges it shows, and a total comes from the directory.
    """
    ranges = max(ranges, -(-(df.count() if rows is None else rows) // RANGE_ROWS))
    ranged = df.repartitionByRange(ranges, *cursor).withColumn("page_range", F.spark_partition_id())
    # the writer wants its folders' rows together; in this order it need not sort them again
    ranged.sortWithinPartitions("page_range", *cursor).write.partitionBy("page_range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, page_range int").parquet(f"{path}/rows")
    ends = [f(F.struct(*cursor)).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    stored.groupBy("page_range", *facets).agg(F.count("*").alias("n"), *ends).write.parquet(f"{path}/directory")


def read_page(spark: SparkSession, path: str, cursor: list[str], limit: int, after: tuple | None = None, where: dict[str, Any] | None = None, search: Column | None = None, most: int = 100, remaining: bool = False) -> DataFrame:
    """A page of write_paged with total_count: rows behind the cursor whose facets are as given and that the search condition keeps.

    total_count is over all such rows, or with remaining only those behind the cursor. Without a search it comes from
    the directory and, for remaining, the cursor's own range; a search has to read the rows of its facets.
    """
    if after is not None and (len(after) != len(cursor) or any(v is None for v in after)):
        raise ValueError("incomplete cursor")
    directory, rows = spark.read.parquet(f"{path}/directory"), spark.read.parquet(f"{path}/rows")
    for facet, value in (where or {}).items():
        if facet not in directory.columns:
            raise ValueError(f"not a facet: {facet}")
        directory, rows = directory.filter(F.col(facet) == value), rows.filter(F.col(facet) == value)
    place = lambda: F.struct(*[F.lit(v).cast(rows.schema[x].dataType).alias(x) for x, v in zip(cursor, after)])
    here = F.struct(*cursor)
    limit = clamp(limit, most)
    behind = directory if after is None else directory.filter(F.col("high") > place())
    if search is not None:
        found = rows.filter(search)
        total = (found.filter(here > place()) if remaining and after is not None else found).agg(F.count("*").alias("total_count"))
    else:
        # every range holds a row of the page or the cursor, so limit + 1 of them are enough
        first = [r.page_range for r in behind.groupBy("page_range").agg(F.min("low").alias("low")).orderBy("low").limit(limit + 1).select("page_range").collect()]
        found = rows.filter(F.col("page_range").isin(first))
        if remaining and after is not None:
            # ranges around the cursor (one, as ranges don't overlap) are counted by their rows, later ones by the directory
            split = [r.page_range for r in behind.filter(F.col("low") <= place()).select("page_range").distinct().collect()]
            whole = behind.filter(~F.col("page_range").isin(split)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            part = rows.filter(F.col("page_range").isin(split) & (here > place())).agg(F.count("*").alias("n"))
            total = whole.unionByName(part).agg(F.sum("n").alias("total_count"))
        else:
            total = directory.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"))
    page = keyset_page(found, cursor, after, limit, most).drop("page_range")
    return page.crossJoin(F.broadcast(total))  # one row
