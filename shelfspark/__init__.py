"""shelfspark: a Spark-native analytics engine for book catalogues and their readers."""
