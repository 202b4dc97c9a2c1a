"""concilia: reconciliation of invoice registers on Spark DataFrames."""

from .config import LedgerColumns, ReconConfig, TaxColumns  # noqa: F401

__version__ = "0.1.0"
