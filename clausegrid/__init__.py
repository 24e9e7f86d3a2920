"""Policy analytics as Spark DataFrame jobs: structure, search, graph, answers, logs."""
