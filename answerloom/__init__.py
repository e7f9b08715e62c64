"""Question-answering corpora on Spark: split, index, retrieve, generate, read and score."""
