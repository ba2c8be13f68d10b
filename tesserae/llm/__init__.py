"""Training-data pipeline operators: dedup, decontamination, PII, mixing, sharding and so on.

Nothing outside this subpackage imports it.
"""
