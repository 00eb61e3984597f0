"""Corpus-preparation operators for language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`ledgerlark.llm.registry` wraps them as
named queries over the ``documents`` and ``embeddings`` tables.
"""
