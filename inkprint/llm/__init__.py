"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it.  ``queries.py`` holds the registered
queries and ``sql.py`` their SQL, where SQL can express them.
"""
