"""What the training-data operators share with the rest of the library."""

from vantage.plans.common import connected_components, cut, dense_position, discard, partitions_for, shared_dir, small_side, table, worker_store  # noqa: F401
