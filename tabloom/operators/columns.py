"""Feature columns of a sample: constant drop, feature sampling, padding, column mask."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.channels import channel_value, kinds
from ..functions.draws import draw
from ..sources.scan import features_of
from .sampling import SAMPLE


def normalise(rows, times=(), exclude=()):
    """Replace every data column by its null-preserving channel value."""
    fields = features_of(rows, exclude)
    kind = kinds(T.StructType(fields), times)
    names = {f.name for f in fields}
    values = [channel_value(f.name, f.dataType, kind[f.name]).alias(f.name) for f in fields]
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in names]
    return rows.select(*rest, *values), kind


def keep_flag(value):
    """Aggregate: does the column vary? Exactly one distinct value means no; no value at all
    counts as zero distinct values and stays. Needs min and max only, no distinct count."""
    return ~F.coalesce((F.count(value) > 0) & (F.min(value) == F.max(value)), F.lit(False))


def kept_features(flags, names, keys, max_columns, seed):
    """Source positions of the features a sample keeps, in order, as an array.

    ``flags``: array of booleans by source position. More than max_columns - 1 features are
    thinned to that many at random; the target column always stays.
    """
    if max_columns < 2:
        raise ValueError("at least two columns are needed")
    sources = F.sequence(F.lit(0), F.lit(len(names) - 1))
    varying = F.filter(sources, lambda i: F.get(flags, i))
    if len(names) + 1 <= max_columns:
        return varying
    drawn = F.array(
        *[
            F.struct(draw(seed, "feature", *keys, F.lit(n)).alias("d"), F.lit(i).alias("src"))
            for i, n in enumerate(names)
        ]
    )
    usable = F.array_sort(F.filter(drawn, lambda s: F.get(flags, s["src"])))
    thinned = F.transform(F.slice(usable, 1, max_columns - 1), lambda s: s["src"])
    return F.when(F.size(varying) + 1 > max_columns, thinned).otherwise(varying)


def pad_names(names, width):
    """Names of the padding features 0..width-1, made different from existing names."""
    taken, out = set(names), []
    for i in range(width):
        name = f"{K.PAD_PREFIX}{i:02d}__"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def is_real(col):
    """Column mask: true for real columns, false for padding."""
    return ~F.startswith(F.col(col), F.lit(K.PAD_PREFIX))


def sample_columns(kept, names, width=None):
    """Array of (pos, col, src, mask) of a sample's features; padding has src -1."""
    name_list = F.array(*[F.lit(n) for n in names])
    real = F.transform(
        kept,
        lambda s, p: F.struct(
            p.alias("pos"), F.get(name_list, s).alias("col"), s.alias("src"), F.lit(True).alias("mask")
        ),
    )
    if width is None:
        return real
    if width <= 0:
        raise ValueError("the padded width must be positive")
    pads = F.array(*[F.lit(n) for n in pad_names(names, width)])
    slots = F.sequence(F.lit(0), F.lit(width - 1))
    padding = F.transform(
        F.filter(slots, lambda i: i >= F.size(kept)),
        lambda i: F.struct(
            i.alias("pos"), F.get(pads, i).alias("col"), F.lit(-1).alias("src"), F.lit(False).alias("mask")
        ),
    )
    return F.concat(real, padding)


def column_plan(
    rows,
    target,
    keys=SAMPLE,
    max_columns=K.MAX_COLUMNS,
    pad=None,
    drop_constant=True,
    seed=42,
    times=(),
):
    """Feature list of each sample, one row per feature, without touching rows a second time.

    One aggregation gives a row per sample; the column decisions happen on that row. Samples with
    more features than the padded width are left out, as such tables are skipped.
    """
    normal, _ = normalise(rows, times)
    names = [f.name for f in features_of(normal, exclude=[target, "pos", "n_rows", "fit_rows"])]
    flags = F.array(
        *[keep_flag(F.col(f"`{n}`")) if drop_constant else F.lit(True) for n in names]
    )
    per_sample = normal.groupBy(*keys).agg(flags.alias("_flags"))
    kept = per_sample.select(*keys, kept_features(F.col("_flags"), names, keys, max_columns, seed).alias("_kept"))
    if pad is not None:
        kept = kept.where(F.size("_kept") <= pad)
    return kept.select(*keys, F.inline(sample_columns(F.col("_kept"), names, pad)))


def constant_columns(rows, columns, keys=SAMPLE):
    """(keys, col, is_constant) for each of the columns of each sample."""
    flags = [
        F.struct(F.lit(c).alias("col"), (~keep_flag(F.col(f"`{c}`"))).alias("is_constant"))
        for c in columns
    ]
    one = rows.groupBy(*keys).agg(F.array(*flags).alias("_f"))
    return one.select(*keys, F.inline("_f"))
