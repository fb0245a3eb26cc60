"""lexloom: auditable text analytics and hybrid retrieval as Spark DataFrame plans."""
