"""Training-data operators: sharding, chat formatting, URL rules, main-text extraction, deduplication, classification,
decontamination, quality rules and sampled segmentation.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames, reads only the columns it
names (so extra columns with any name are harmless) and states in its docstring what nulls, empty texts, ties, repeated rows
and empty tables give.
"""
