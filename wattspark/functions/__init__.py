"""Column-level helpers: all built from ``pyspark.sql.functions`` (JVM side, codegen)."""

from wattspark.functions.timecols import (
    epoch_us, epoch_seconds, bucket_start, bucket_center, elapsed_ms, round_to_second,
    to_ntz, add_seconds,
)
from wattspark.functions.safe import (
    nz_sum, safe_div, finite_or_zero, nullif_empty, clip_lower, guarded_ratio,
)

__all__ = [
    "epoch_us", "epoch_seconds", "bucket_start", "bucket_center", "elapsed_ms",
    "round_to_second", "to_ntz", "add_seconds",
    "nz_sum", "safe_div", "finite_or_zero", "nullif_empty", "clip_lower", "guarded_ratio",
]
