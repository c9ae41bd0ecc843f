"""Sample preparation: rows of a chunk become context and query rows with a feature list."""

from dataclasses import dataclass, field
from typing import Optional, Union

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import columns as C
from ..operators import sampling as S
from ..sources.scan import features_of


@dataclass
class SampleConfig:
    """How chunks become samples."""

    fit_size: Optional[Union[int, float]] = None
    query_range: Optional[tuple] = None
    target: Optional[str] = None
    query_chunk: Optional[int] = None
    shuffle: bool = False
    drop_constant: bool = True
    max_columns: int = K.MAX_COLUMNS
    max_features: Optional[int] = None
    pad: Optional[int] = None
    min_rows: int = 2
    max_rows: Optional[int] = None
    auto_target: bool = True
    skip_ineligible: bool = False
    max_null: float = K.MAX_NULL_RATIO
    max_distinct: float = K.MAX_DISTINCT_RATIO
    balanced: bool = False
    keyword: str = K.REGRESSION_KEYWORD
    rows_per_chunk: Optional[int] = None
    seed: int = 42
    times: tuple = field(default_factory=tuple)


BOOKKEEPING = ("pos", "n_rows", "fit_rows")


def prepare(rows, target, config, keys=S.SAMPLE, keep=None):
    """Cap, order and split the rows of each sample and decide its feature columns; samples that are not to
    ``keep`` go.

    Returns the frame and the channel of each column, or (None, None) for a table wider than the
    feature limit. One exchange by sample key serves all steps.
    """
    width = len(features_of(rows, exclude=(*keys, target)))
    if config.max_features is not None and width > config.max_features:
        return None, None
    ordered = S.order_rows(rows, config.seed, keys, config.max_rows, config.shuffle, keep=keep)
    split = S.split_context(ordered, config.seed, config.fit_size, config.query_range, keys)
    return decide_columns(split, target, config, keys)


def decide_columns(split, target, config, keys=S.SAMPLE):
    """Feature columns of samples already split: adds ``columns``, an array of (pos, col, src,
    mask). Data columns become channel values. The list is made once per sample, on its first
    row, and spread by the window."""
    names = [f.name for f in features_of(split, exclude=(*keys, target, *BOOKKEEPING))]
    normal, kind = C.normalise(split, config.times, exclude=(*keys, *BOOKKEEPING))
    flags = F.array(*[F.lit(True) for _ in names])
    if config.drop_constant:
        normal = _spread_flags(normal, names, keys)
        flags = F.array(*[F.col(f"`_keep_{i}`") for i in range(len(names))])
    kept = C.kept_features(flags, names, keys, config.max_columns, config.seed)
    once = F.when(F.col("pos") == 1, kept)
    out = normal.withColumn("_kept", F.max(once).over(S.whole(keys)))
    if config.pad is not None:
        out = out.where(F.size("_kept") <= config.pad)
    out = out.drop(*[f"_keep_{i}" for i in range(len(names))])
    out = out.withColumn("columns", C.sample_columns(F.col("_kept"), names, config.pad)).drop("_kept")
    return out, kind


def _spread_flags(normal, names, keys):
    w = S.whole(keys)
    cols = []
    for i, n in enumerate(names):
        v = F.col(f"`{n}`")
        constant = (F.count(v).over(w) > 0) & (F.min(v).over(w) == F.max(v).over(w))
        cols.append((~F.coalesce(constant, F.lit(False))).alias(f"_keep_{i}"))
    return normal.select("*", *cols)
