"""varloom: variant annotation, gene prioritization and corpus preparation on PySpark."""
