"""Operators for preparing language-model training data.

Nothing outside this package imports it: deleting the folder (together with
``corpus_pipeline.py`` and ``tests/llm``) leaves the rest of the library whole.
"""
