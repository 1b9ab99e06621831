"""Shot-quality analytics as Spark DataFrame operators and jobs."""

__version__ = "0.1.0"
