"""Training-data operators: ten jobs for text corpora, independent of the rest of the library."""
