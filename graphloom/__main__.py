"""build FILE... STORE | load STORE [PORT] | profile FILE QUERY | FILE... : make a store, serve one, time a query, or serve files."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .server import Service, serve
from .sources.graph import Graph, Store


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match args:
        case ["build", *files, store] if files:
            print(Store.create(Graph.load(spark, files), store).graph().count(), "triples")
            return 0
        case ["profile", file, text]:
            print(Engine(Graph.load(spark, file)).profile(text))
            return 0
        case ["load", store, *port]:
            service, at = Service(store=Store(spark, store)), int(port[0]) if port else 9080
        case _:
            graph = Graph.load(spark, args)
            service, at = Service(Graph(spark, graph.triples.cache()).counted()), 9080
    print(f"serving on port {at}")
    serve(service, at).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
