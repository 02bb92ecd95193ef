"""stratafold: schema-declared document tables, change logs, search and compaction on Spark."""

__version__ = "0.1.0"
