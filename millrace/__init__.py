"""millrace: a Spark-first analytics engine for source code and document corpora.

Operators are functions from DataFrames to DataFrames.  The core covers the
metadata warehouse, extraction, graph, ranking and chunking operators; the
optional subpackage ``millrace.llm`` holds the training-data operators and is
imported by nothing else in the package.
"""

__version__ = "0.1.0"
