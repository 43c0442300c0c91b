"""A PySpark-native engine for the data side of unpaired image-domain learning."""
