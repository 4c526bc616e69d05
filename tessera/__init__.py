"""Document analytics and hybrid retrieval as Spark DataFrame plans."""
