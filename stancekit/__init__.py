"""stancekit: argument mining on Spark.

Extraction, cleaning, sentence splitting, stance classification and
evaluation, all expressed as DataFrame transformations so that Catalyst
plans them and the same code runs in batch and in Structured Streaming.
"""

__version__ = "0.1.0"
