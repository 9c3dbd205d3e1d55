"""Evidence analytics on Spark: auditable research data as DataFrame plans."""

__version__ = "0.1.0"
