"""lodegraph: a Spark-first analytics engine for typed code graphs and the corpora around them."""

__version__ = "0.1.0"
