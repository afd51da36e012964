"""orfweave: a Spark-first engine for compact-genome gene calling."""

__version__ = "0.1.0"
