"""lectern: a Spark-native engine that turns document corpora into reviewed teaching decks."""
