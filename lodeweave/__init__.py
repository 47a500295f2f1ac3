"""lodeweave: grounded hybrid retrieval, compliance routing and evaluation as Spark DataFrame operators."""
