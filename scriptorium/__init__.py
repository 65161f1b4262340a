"""Text forensics and training-data processing as Spark plans."""
