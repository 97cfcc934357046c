"""python -m netloom PATH [OUT] [--format F] [--har | --flat]: show the tables of captures, or write them as Parquet below OUT; or their HAR or flat requests as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netloom.operators.outputs import simple_requests
from netloom.sources.canonical import relation, to_har
from netloom.sources.load import READERS, load


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="netloom", description=__doc__)
    parser.add_argument("path", help="captures of one format: a file, a folder or a pattern")
    parser.add_argument("out", nargs="?", help="folder for the tables; without it, their first rows are shown")
    parser.add_argument("--format", choices=sorted(READERS), help="format of the captures, if their content shall not tell it")
    parser.add_argument("--har", action="store_true", help="write an extended HAR for each page instead, a JSON document a line for each part of its entries")
    parser.add_argument("--flat", action="store_true", help="write one flat JSON row for each request instead")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("netloom").getOrCreate()
    if given.har or given.flat:
        pages, requests = relation(spark, given.path, given.format)
        if given.har:
            made = to_har(pages, requests).select(F.col("har").alias("value"))
        else:
            made = simple_requests(requests, "page", ["start", "req"]).select(F.to_json(F.struct("*")).alias("value"))
        if given.out:
            made.write.mode("errorifexists").text(given.out)
        else:
            for row in made.toLocalIterator():
                print(row["value"])
        return
    for name, table in load(spark, given.path, given.format).items():
        if given.out:
            table.write.mode("errorifexists").parquet(f"{given.out.rstrip('/')}/{name}")
        else:
            print(name)
            table.show(20, truncate=60)


if __name__ == "__main__":
    main()
