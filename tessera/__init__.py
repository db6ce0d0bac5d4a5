"""tessera: a Spark-native posting analytics library."""
