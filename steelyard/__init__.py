"""steelyard: a Spark-native engine that weighs annual-report narratives against figures."""
