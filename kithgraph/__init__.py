"""kithgraph: linked-account risk analytics expressed as Spark DataFrame operators."""
