"""Training-data operators: thirteen corpus-scale operators and their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
