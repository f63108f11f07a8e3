"""Failures of a store.  A missing key isn't one: reads return ``None`` or an empty DataFrame."""


class StoreError(Exception):
    """Base of all."""


class InvalidArgument(StoreError):
    """An option or argument that contradicts the store's state."""


class Corruption(StoreError):
    """Stored bytes that can't be right."""


class StoreIOError(StoreError):
    """The store's files can't be reached, or another session holds the store."""


class HistoryLost(StoreError):
    """A sequence number below what compaction has kept."""
