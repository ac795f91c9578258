"""Training-data operators.  Nothing outside this folder imports it but the guarded
block of ``__spark_entry__.py`` and ``corpus_pipeline.py``."""
