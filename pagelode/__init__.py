"""pagelode: Spark-first analytics over page-structured documents and the facts in them."""
