"""Training-data operators for text corpora: thirteen operators, their queries and their SQL.

Nothing outside this package imports it. ``queries.py`` holds the registry that the entry
module adds when this package is present.
"""
