"""lodestone: a Spark-native engine for research vaults of timestamped transcripts."""
