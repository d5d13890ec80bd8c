from .recorder import deltas, drain_batches, session_cells, session_counts, windowed_counts
from .stateful import running_cells, snapshot, use_rocksdb, window_snapshot

__all__ = ["deltas", "drain_batches", "running_cells", "session_cells", "session_counts", "snapshot", "use_rocksdb", "window_snapshot", "windowed_counts"]
