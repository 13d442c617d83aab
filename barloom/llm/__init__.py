"""Operators for preparing large text corpora.

Thirteen operators, each with its own general interface, and the thin registered queries
(``queries.py``).  Nothing else in the library imports this package.

Shared conventions
* ``documents`` means any DataFrame with a key column and a text column; every other column
  is carried or ignored, never interpreted, and its name may clash with nothing because
  operators select what they need first.
* a null text is an empty text; a null key is a key like any other;
* a *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.
"""
