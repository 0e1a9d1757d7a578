"""strataquill: Spark-native analytics over content-addressed, versioned data."""
