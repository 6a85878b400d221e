"""labelspark: label verification, cited retrieval, audit chains and evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
