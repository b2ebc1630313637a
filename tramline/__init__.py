"""tramline: vehicle-trajectory conflict analytics on Spark, plus a text-corpus subpackage."""

__version__ = "0.1.0"
