"""PySpark-native engine for cataloguing, linking, transforming and annotating collections of objects."""
