"""Training-data operators: deduplication, decontamination, tokenising, scoring and cleaning of corpora.

Nothing outside this subpackage imports it.
"""
