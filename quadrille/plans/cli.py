"""Command line: python -m quadrille config.json"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("Missing config path argument.\nUsage:\n  python -m quadrille path/to/config.json", file=sys.stderr)
        return 1
    from .fragmenter import load
    from .ship import ship

    try:
        spark = SparkSession.builder.appName("quadrille").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        ship(spark)
        load(args[0]).run(spark)
    except Exception as e:  # the message, and a code that scripts can test
        print(e, file=sys.stderr)
        return 1
    return 0
