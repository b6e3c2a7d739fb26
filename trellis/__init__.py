"""trellis: warehouse jobs and lineage-graph analytics as Spark DataFrame work."""

__version__ = "0.1.0"
