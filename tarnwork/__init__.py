"""Analytics operators for retrieval, measurement and text corpora, written as Spark DataFrame transformations."""
