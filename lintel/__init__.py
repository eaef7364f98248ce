"""Rules over text corpora as Spark plans."""
