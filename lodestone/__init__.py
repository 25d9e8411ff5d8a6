"""Context analytics on Spark: search, ranking, graph, memory and corpus operators as lazy DataFrame plans."""

__version__ = "0.1.0"
