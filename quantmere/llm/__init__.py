"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage; deleting it (with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest working.
"""
