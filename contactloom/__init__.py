"""contactloom: a Spark-native engine for contact data in semi-structured sources."""
