"""Hash draws: reproducible pseudo-random integers that depend on keys only.

A draw is the first 32 bits of an md5 over ``seed:purpose:key:key…``. It does not depend on the
partitioning, on the order of rows or on a retry after a lost executor, so every sampling
operator built on it is stable, and any other SQL engine can recompute it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32


def as_col(c):
    return c if isinstance(c, Column) else F.col(c)


def draw(seed, purpose, *keys):
    """Uniform integer in [0, 2^32). ``seed`` may be an int or a column (e.g. seed + epoch)."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed.cast("string"), F.lit(purpose)] + [as_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def draw_between(lo, hi, seed, purpose, *keys):
    """Uniform integer in the closed range [lo, hi]."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return lo + draw(seed, purpose, *keys) % (hi - lo + 1)


def draw_bucket(drawn, bits):
    """Order-preserving bucket of a draw: its leading ``bits`` bits."""
    return F.shiftright(as_col(drawn), DRAW_BITS - bits)
