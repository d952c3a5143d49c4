"""Corpus operators for training-data pipelines; nothing else in the library imports this.

Column names that start with `__tessera_` are reserved for the operators' own use."""
