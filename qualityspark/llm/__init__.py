"""Training-data operators (language ID, extraction, scoring, joins, packing).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the folder is present.
"""
