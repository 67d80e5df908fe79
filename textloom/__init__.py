"""textloom: a Spark-native engine for curating, splitting, pairing and scoring labelled corpora."""

__version__ = "0.1.0"
