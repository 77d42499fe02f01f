"""A Spark-first engine for uniformly sampled recordings and the events scored beside them."""
