"""Training-data operators: decontamination, WARC bundles, near-duplicate joins, filters, classifiers, mixing.

Nothing outside this package imports it.  Each module holds one operator with its own general
interface; ``queries`` holds the thin ``opN_<name>`` queries and their SQL.
"""
