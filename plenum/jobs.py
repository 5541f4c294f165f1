"""python -m plenum.jobs QUERY DATA OUT [parquet|csv|json] [--limit N]: run one query over a folder of tables and write its rows, or the first N of them in the order of their columns."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from plenum.plans.catalogue import QUERIES

    limit = None
    if len(args) > 2 and args[-2] == "--limit" and args[-1].isdigit():
        limit, args = int(args[-1]), args[:-2]
    if len(args) not in (3, 4) or args[0] not in QUERIES:
        print(f"{__doc__}\n\nQueries: {', '.join(sorted(QUERIES))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(args[0]).getOrCreate()
    rows = QUERIES[args[0]](spark, args[1])
    if limit is not None:
        rows = rows.orderBy(*[c for c, kind in rows.dtypes if not kind.startswith("map")]).limit(limit)
    writer = rows.write.mode("overwrite").option("header", True)
    writer.format(args[3] if len(args) == 4 else "parquet").save(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
