"""kinetrace: Spark-native analytics over recorded telemetry, dialogue text and training-data corpora."""
