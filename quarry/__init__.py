"""A document-corpus curation engine on PySpark."""
