"""Paged record sources: pages that were landed as files, and pages that a client fetches.

A client is a function that is named as module:function, takes (endpoint, page, size) and returns a list of
objects. Reading stops at the first missing, empty or short page.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plenum.sources.files import exists

SIZE = 100


def landed_pages(spark: SparkSession, path: str, schema: str, start_page: int = 1, max_pages: int = 20, size: int = SIZE) -> DataFrame:
    """Rows of JSON arrays in files or folders that are named page-1, page-2 ... (or page=1), read by Spark from any file system it knows; with page and _pos."""
    fields = T._parse_datatype_string(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("page", T.IntegerType()), T.StructField("_pos", T.LongType())]))
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    number = F.regexp_extract("file", r"page[-=](\d+)", 1)
    pages = raw.filter(number != "").select(number.cast("int").alias("page"), F.from_json("value", T.ArrayType(fields)).alias("a")).filter((F.col("page") >= start_page) & (F.col("page") < start_page + max_pages))
    full = {r["page"] for r in pages.filter(F.size("a") >= size).select("page").collect()}  # at most max_pages rows
    last = start_page
    while last in full and last < start_page + max_pages:
        last += 1
    return pages.filter(F.col("page") <= last).select("page", F.posexplode("a").alias("_pos", "r")).select("r.*", "page", F.col("_pos").cast("long").alias("_pos"))


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def client(name: str) -> Callable[[str, int, int], list[dict]]:
    """The function that module:function names, on whatever machine it is called."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.client, self.endpoint, self.fields = options["client"], options.get("endpoint", ""), fields
        self.start, self.most = int(options.get("start_page", 1)), int(options.get("max_pages", 20))
        self.step = int(options.get("pages_per_partition", 20))

    def partitions(self) -> list[InputPartition]:
        """Runs of pages. Runs beyond the last page cost one request each."""
        end = self.start + self.most
        return [Pages(k, min(k + self.step, end)) for k in range(self.start, end, self.step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch = client(self.client)
        for page in range(partition.first, partition.last):
            rows = fetch(self.endpoint, page, SIZE)
            for row in rows or []:
                yield tuple(None if (x := row.get(f)) is None else x if isinstance(x, str) else json.dumps(x) for f in self.fields)
            if len(rows or []) < SIZE:
                return


class PagedSource(DataSource):
    """spark.read.format("paged").schema("id string, ...").option("client", "package.module:function").option("endpoint", url).option("start_page", 1).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, author string, date string, raw_text string, url string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, [f.name for f in schema.fields])
