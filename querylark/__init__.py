"""querylark: document search, question answering and corpus preparation on PySpark."""
