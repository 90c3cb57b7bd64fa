"""Training-data operators: sharding, extraction, scanning, joins, packing.

Nothing outside this subpackage imports it.
"""
