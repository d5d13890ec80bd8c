from .algebra import add, downsample, rolled_up, subtract
from .cells import (
    dense_buckets,
    dense_to_cells,
    is_empty,
    non_zero,
    overwrite,
    packed_to_cells,
    record,
    to_dense,
    to_packed,
    validate_packed,
)
from .convert import narrow, narrow_total, widen
from .compare import digests, equality, first_differences
from .mixed import add_mixed, align, dense_to_mixed, downsample_mixed, mixed_to_dense, record_mixed, same_configs, subtract_aligned
from .packed import checked_derived, merge_packed, packed_quantiles, widen_derived, with_derived
from .ranks import (
    bucket_quantile_range,
    buckets,
    cumulate,
    cumulative_to_cells,
    extremes,
    individual_counts,
    mean,
    percentiles,
    quantiles,
    totals,
    with_quantile_ranges,
)

__all__ = [
    "checked_derived", "digests", "equality", "first_differences", "merge_packed", "packed_quantiles", "widen_derived", "with_derived",
    "add", "add_mixed", "align", "dense_to_mixed", "downsample_mixed", "mixed_to_dense", "record_mixed", "same_configs", "subtract_aligned", "bucket_quantile_range", "buckets", "cumulate", "cumulative_to_cells", "dense_buckets", "dense_to_cells", "downsample", "extremes", "individual_counts",
    "is_empty", "mean", "narrow", "narrow_total", "non_zero", "overwrite", "packed_to_cells", "percentiles", "quantiles", "record", "rolled_up", "subtract", "to_dense",
    "to_packed",
    "totals", "validate_packed", "widen", "with_quantile_ranges",
]
