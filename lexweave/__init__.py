"""lexweave: document retrieval, snapshot and evaluation analytics as Spark plans."""
