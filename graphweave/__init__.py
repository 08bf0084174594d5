"""Spark-first analytics over source-code graphs: typed nodes and edges, lookups, traversals, maintenance and change feeds."""
