"""A Spark-native engine that fragments RDF datasets into documents."""
