"""Operators for preparing training text: de-duplication, filtering, scoring, mixing, tokenising.

Nothing outside this subpackage imports it.  ``catalog`` lists the registered queries.
"""
