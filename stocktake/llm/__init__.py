"""Training-data operators: scoring, de-duplication, scanning, packing and sharding of texts.

Nothing outside this subpackage imports it. Every operator takes DataFrames with named columns,
keeps its own general interface, and is applied to the given tables by ``queries``.
"""
