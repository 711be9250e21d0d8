"""tessera: a PySpark-native engine for timed text, word sense and labelling analytics."""
