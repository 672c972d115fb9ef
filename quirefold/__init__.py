"""quirefold: PySpark-native analytics for page layouts, transcriptions and text corpora."""
