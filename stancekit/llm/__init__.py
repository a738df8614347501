"""Training-data operators: formatting, filtering, deduplication, packing,
tokenised output and model scoring. Nothing else in the library imports this
subpackage."""
