"""strandlake: biological sequence files and training-corpus operators on PySpark."""

__version__ = "0.1.0"
