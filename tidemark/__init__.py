"""tidemark: a Spark-native engine for versioned key-value data.

An append-only log of mutations ``(key, seq, type, value)`` is resolved to the
newest visible version of each key.  Everything is a DataFrame; Catalyst picks
the physical strategy.
"""
