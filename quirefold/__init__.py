"""Document analytics on Spark: ordered tables of pages, lines, blocks and sections."""

__version__ = "0.1.0"
