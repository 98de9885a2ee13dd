"""quillspark: text-corpus retrieval, enrichment and verification as lazy Spark plans."""

__version__ = "0.1.0"
