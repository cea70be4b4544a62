"""python -m streamloom batch|stream MODULE_OR_FILE [-a ATTRIBUTE] [-f FILE | -d JSON | -i N] [--dot] [--explain]"""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="streamloom", description="Run a dataflow graph on Spark.")
    parser.add_argument("target", choices=("batch", "stream"))
    parser.add_argument("module", help="module name or Python file with a graph")
    parser.add_argument("-a", "--attribute", help="name of the graph in the module")
    parser.add_argument("-f", "--file", help="JSON file of inputs by node name")
    parser.add_argument("-d", "--data", help="inputs as JSON text")
    parser.add_argument("-i", "--iterations", type=int, help="iterations of every root (default 1)")
    parser.add_argument("-o", "--out", default="streamloom-out", help="folder of a stream's results")
    parser.add_argument("--dot", action="store_true", help="print the graph as DOT and stop")
    parser.add_argument("--explain", action="store_true", help="print the plans and stop")
    options = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from .loader import load_graph
    from .plans import run
    from .sources import load_inputs
    from .streaming import run_stream

    graph = load_graph(options.module, options.attribute)
    if options.dot:
        print(graph.to_dot())
        return 0
    flat = graph.flatten()
    inputs = load_inputs(flat, options.file, options.data, options.iterations)
    spark = SparkSession.builder.appName("streamloom").getOrCreate()
    if options.target == "stream":
        run_stream(spark, flat, inputs, path=options.out).wait()
        return 0
    with run(spark, flat, inputs) as results:
        if options.explain:
            for df in results.values():
                df.explain("formatted")
            return 0
        results.execute()
        for (node, port), df in results.items():
            print(f"{node}.{port}")
            df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
