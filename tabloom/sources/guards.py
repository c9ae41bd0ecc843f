"""Guards on source text."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import whole


def _invalid(rows, keys):
    """Whether some string of a row is not valid UTF-8; None for rows without strings."""
    strings = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    strings = [s for s in strings if s not in keys]
    bad = None
    for s in strings:
        one = F.coalesce(~F.is_valid_utf8(F.col(f"`{s}`")), F.lit(False))
        bad = one if bad is None else bad | one
    return bad


def valid_chunk(rows, keys):
    """Whether all strings of a row's chunk are valid, as a window over the chunk's keys."""
    bad = _invalid(rows, keys)
    return F.lit(True) if bad is None else ~F.max(bad).over(whole(keys))


def drop_invalid_text(rows, keys=("table_id", "chunk_id")):
    """Drop every chunk in which some string is not valid UTF-8."""
    bad = _invalid(rows, keys)
    if bad is None:
        return rows
    spoiled = rows.where(bad).select(*keys).distinct()
    return rows.join(spoiled, list(keys), "left_anti")
