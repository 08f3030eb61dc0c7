"""Record linkage and bipartite overlap analysis over name lists, on Spark DataFrames."""

__version__ = "0.1.0"
