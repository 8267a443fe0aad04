"""filigraph: document and graph intelligence as Spark plans."""
