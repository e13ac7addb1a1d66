"""Training-data operators: filtering, deduplication, scoring, redaction and tokenising of large text corpora.

Nothing else in the library imports this subpackage. ``registry`` holds the queries and the SQL that
``__spark_entry__`` adds when the subpackage is present.
"""
