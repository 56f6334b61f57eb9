"""docsift: document retrieval, question answering and corpus preparation on Spark DataFrames."""
