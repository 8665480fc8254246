"""Analytics over corpora of token sequences, as Spark DataFrame jobs."""

__version__ = "0.1.0"
