"""inkweft: document-corpus analytics on Spark DataFrames.

Every public operator takes and returns DataFrames.  The subpackage ``llm`` holds the training-data
operators; nothing outside it imports it.
"""

__version__ = "0.1.0"
