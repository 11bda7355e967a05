"""concord: a Spark-native record-matching and mastering engine."""
