"""Part of quillgraph, a PySpark-native analytics engine."""
