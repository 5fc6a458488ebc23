"""newsloom: news corpus preparation, retrieval and evaluation as Spark jobs."""
