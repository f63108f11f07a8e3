"""Store options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """``write_buffer_size``: bytes of single puts held before they become a log batch.  ``sync``: every call commits.
    ``max_file_size``: bytes of a file of a sorted run, as long as the run has at most ``compact.RUN_FILES`` of them; files of
    larger runs grow up to ``compact.LARGE_FILE``.  The default suits small stores, large ones want 128 MB or more.
    ``block_size`` and ``block_cache_capacity_bytes`` are kept for callers; Parquet's pages and the page cache
    take their place."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 4 << 20
    sync: bool = False
    block_size: int = 4096
    bloom_bits_per_key: int = 10
    block_cache_capacity_bytes: int = 8 << 20
    max_level0_files: int = 4
    max_file_size: int = 2 << 20
    break_lock: bool = False
