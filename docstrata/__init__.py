"""Versioned document analytics on Spark.

The core package holds table access, retrieval, version analytics and snapshot life cycle as DataFrame plans;
the optional subpackage ``llm`` holds the operators for preparing training text. Nothing in the core imports it.
"""

__version__ = "0.1.0"
