"""corpusloom: a Spark-first engine for building, searching and analysing document corpora."""
