"""Quality assurance, redaction, deduplication and cleaning of text corpora as Spark plans."""
