"""strataflow: corpus, knowledge-graph and hybrid-retrieval analytics on PySpark."""

__version__ = "0.1.0"
