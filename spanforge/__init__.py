"""Interval analytics on Spark: molecules with nested annotations on a coordinate axis."""
