"""Cell encodings whose statistics come from context rows only.

Rows of a sample share one hash partition, so statistics are window aggregates over the sample
key: computed once per sample, put on every row, with a single exchange for all columns.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.channels import finite
from ..functions.draws import draw
from .sampling import SAMPLE, whole

HUGE = 1e100
EPS = 2.220446049250313e-16  # double precision unit


def context(x):
    return F.when(~F.col("is_query"), x)


def query(x):
    return F.when(F.col("is_query"), x)


KEPT, GIVEN = "kept", "given"  # a step's statistics stay as columns, or are columns already


def over_sample(rows, keys, state=None, more=None, **aggregates):
    if state == GIVEN:
        return rows
    w = whole(keys)
    more = [x.alias(n) for n, x in (more or {}).items()]
    return rows.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()], *more)


def in_parts(rows, added):
    """``rows.withColumns(added)``, compiled as many short methods.

    A stage compiles its projections into one method, which for some ten columns passes the 8,000 bytes above
    which the JVM never compiles it and interprets it instead. A higher-order function keeps a projection out of
    such stages; here it hands ``is_query`` on.
    """
    handed = F.get(F.transform(F.array("is_query"), lambda v: v), F.lit(0))
    return rows.withColumns({**added, "is_query": handed})


def _name(col, suffix):
    return f"{col}__{suffix}"


def number(x):
    """A double, NaN as null."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def clip(x, lo, hi):
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


# ---- bounds and quantile bins -------------------------------------------------------------


def clamp_inf(rows, columns, keys=SAMPLE, more=None):
    """Replace infinite values by the finite extreme ∓ 1, context and query sides apart.

    A side without any finite value becomes null, as does NaN. Adds ``<col>__clamped``, and ``more``:
    window expressions over the same keys that share the pass.
    """
    aggs, sides = {}, {}
    for c in columns:
        f = finite(F.col(f"`{c}`"))
        for side, pick in (("c", context), ("q", query)):
            own = _name(c, side)
            sides[own] = pick(f)
            aggs[_name(c, f"{side}lo")] = F.min(f"`{own}`")
            aggs[_name(c, f"{side}hi")] = F.max(f"`{own}`")
    added = {}
    for c in columns:
        x = number(F.col(f"`{c}`"))
        lo, hi = (
            F.when(F.col("is_query"), F.col(_name(c, f"q{e}"))).otherwise(F.col(_name(c, f"c{e}")))
            for e in ("lo", "hi")
        )
        added[_name(c, "clamped")] = F.when(lo.isNotNull(), clip(x, lo - 1, hi + 1))
    out = over_sample(in_parts(rows, sides), keys, more=more, **aggs)
    return in_parts(out, added).drop(*aggs, *sides)


def bin_quantiles(x, bins=K.NUM_BINS):
    """Aggregate: the context quantiles at (2i+1)/(2·bins)."""
    return F.percentile(context(x), [(2 * i + 1) / (2 * bins) for i in range(bins)])


def _rounded(values, scale):
    """Quantiles rounded for comparison with engines that differ in the last bit."""
    if scale is None:
        return values
    unit = F.lit(float(10**scale))
    return F.transform(values, lambda v: F.rint(v * unit) / unit)


def sample_edges(rows, column, keys=SAMPLE, bins=K.NUM_BINS, scale=None):
    """Bin edges as a side table, one row per sample: minimum, quantiles, maximum of the context."""
    c = context(F.col(f"`{column}`"))
    stats = rows.groupBy(*keys).agg(
        F.array(F.min(c)).alias("_lo"),
        bin_quantiles(F.col(f"`{column}`"), bins).alias("_mid"),
        F.array(F.max(c)).alias("_hi"),
    )
    return stats.select(*keys, _rounded(F.concat("_lo", "_mid", "_hi"), scale).alias("edges"))


def _count_up_to(edges, n, x):
    """How many of ``n`` edges are at most x; names of columns. Plain comparisons, for a lambda is interpreted."""
    x = f"nanvl(cast(`{x}` as double), cast(null as double))"
    return F.expr(" + ".join(f"if(get(`{edges}`, {i}) <= {x}, 1, 0)" for i in range(n)))


def code_bins(rows, columns, keys=SAMPLE, bins=K.NUM_BINS, scale=None, state=None):
    """Adds ``<col>__code`` (floor, delta, bin) by inner edges; a missing value has floor 63. NaN is missing.

    The outer edges (minimum and maximum) cannot change the result: a value below the first inner
    edge is in the first bin with or without them, one above the last in the last. Edges and
    position are columns of their own steps, so that each is evaluated once per cell.
    """
    mids, places, codes = {}, {}, {}
    for c in columns:
        mids[_name(c, "mid")] = bin_quantiles(number(F.col(f"`{c}`")), bins)
        x, mid, i = number(F.col(f"`{c}`")), F.col(f"`{_name(c, 'mid')}`"), F.col(f"`{_name(c, 'at')}`")
        place = F.least(F.greatest(_count_up_to(_name(c, "mid"), bins, c), F.lit(1)), F.lit(bins - 1))
        places[_name(c, "at")] = F.when(x.isNotNull() & mid.isNotNull(), place)
        lower, upper = F.get(mid, i - 1), F.get(mid, i)
        inside = (x - lower) / F.greatest(upper - lower, F.lit(1e-10))
        delta = F.coalesce(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        codes[_name(c, "code")] = F.struct(
            F.coalesce(i - 1, F.lit(K.MISSING_BIN)).cast("int").alias("floor"),
            F.when(i.isNotNull(), delta).otherwise(F.lit(0.0)).alias("delta"),
            F.when(i.isNotNull(), F.rint(i - 1 + delta)).cast("int").alias("bin"),
        )
    out = over_sample(rows, keys, state, **mids)
    if scale is not None and state != GIVEN:
        out = out.withColumns({m: _rounded(F.col(f"`{m}`"), scale) for m in mids})
    return in_parts(in_parts(out, places), codes).drop(*places, *(() if state == KEPT else mids))


def quantile_bin(rows, columns, keys=SAMPLE, bins=K.NUM_BINS, scale=None, state=None, more=None):
    """Adds ``<col>__code`` for each numeric column, infinite values drawn in first, and ``more`` (``clamp_inf``)."""
    clamped = [_name(c, "clamped") for c in columns]
    out = code_bins(clamp_inf(rows, columns, keys, more), clamped, keys, bins, scale, state)
    named = {_name(k, "code"): _name(c, "code") for c, k in zip(columns, clamped)}
    return out.withColumnsRenamed(named).drop(*clamped)


# ---- standard scaling ---------------------------------------------------------------------


def bounded_number(x):
    """Finite values within ±1e100, all else null."""
    return F.least(F.greatest(finite(x), F.lit(-HUGE)), F.lit(HUGE))


def tame(x):
    f = finite(x)
    return F.when(f.isNotNull(), bounded_number(x))


def fill_mean(rows, columns, keys=SAMPLE, state=None):
    """Missing feature values become the context mean of the unclipped values: ``<col>__filled``."""
    means = {_name(c, "fill"): F.avg(context(finite(F.col(f"`{c}`")))) for c in columns}
    filled = {
        _name(c, "filled"): F.coalesce(finite(F.col(f"`{c}`")), F.col(_name(c, "fill")))
        for c in columns
    }
    out = in_parts(over_sample(rows, keys, state, **means), filled)
    return out if state else out.drop(*means)


def winsor_limits(x, mode="valid"):
    """Aggregate: the two clipping quantiles of the context."""
    return F.percentile(context(x), list(K.WINSOR_LIMITS[mode]))


def standardise(rows, columns, keys=SAMPLE, role="feature", mode="valid", state=None):
    """Adds ``<col>__z``, ``<col>__mean``, ``<col>__std``.

    Winsorise by context limits, fill, centre and scale by context mean and population deviation.
    Features are filled before clipping, with the plain mean; targets after it, with the clipped
    mean. No finite context value gives 0, mean 0, std 1. Without variance the divisor is 1.
    """
    if role == "feature":
        out = fill_mean(rows, columns, keys, state)
        source = {c: tame(F.col(f"`{_name(c, 'filled')}`")) for c in columns}
    else:
        out, source = rows, {c: tame(F.col(f"`{c}`")) for c in columns}
    limits = {_name(c, "lim"): winsor_limits(source[c], mode) for c in columns}
    out = over_sample(out, keys, state, **limits)
    clipped = {}
    for c in columns:
        lim = F.col(_name(c, "lim"))
        clipped[_name(c, "clip")] = clip(source[c], F.get(lim, F.lit(0)), F.get(lim, F.lit(1)))
    out = in_parts(out, clipped)
    if role == "target":
        out = over_sample(
            out, keys, **{_name(c, "cm"): F.avg(context(F.col(_name(c, "clip")))) for c in columns}
        )
        out = out.withColumns(
            {_name(c, "clip"): F.coalesce(_name(c, "clip"), _name(c, "cm")) for c in columns}
        )
    aggs = {}
    for c in columns:
        x = context(F.col(_name(c, "clip")))
        aggs[_name(c, "m")], aggs[_name(c, "s")] = F.avg(x), F.stddev_pop(x)
        aggs[_name(c, "k")] = F.count(x)
    out, scaled = over_sample(out, keys, state, **aggs), {}
    for c in columns:
        m, s, k = (F.col(_name(c, e)) for e in ("m", "s", "k"))
        var = s * s
        flat = var <= k * EPS * var + (k * m * EPS) * (k * m * EPS)
        z = (F.col(_name(c, "clip")) - m) / F.when(flat, F.lit(1.0)).otherwise(s)
        scaled[_name(c, "z")] = F.coalesce(F.when(k > 0, z), F.lit(0.0))
        scaled[_name(c, "mean")] = F.coalesce(m, F.lit(0.0))
        scaled[_name(c, "std")] = F.when(k > 0, s).otherwise(F.lit(1.0))
    out = in_parts(out, scaled)
    extra = ["filled", "clip", "cm"] + ([] if state == KEPT else ["fill", "lim", "m", "s", "k"])
    return out.drop(*[_name(c, e) for c in columns for e in extra])


def scale_stats(rows, columns, keys=SAMPLE, role="feature", mode="valid"):
    """(keys, col, mean, std): one row per sample and column."""
    scaled = standardise(rows, columns, keys, role, mode)
    aggs = [
        F.struct(
            F.lit(c).alias("col"),
            F.any_value(_name(c, "mean")).alias("mean"),
            F.any_value(_name(c, "std")).alias("std"),
        )
        for c in columns
    ]
    one = scaled.groupBy(*keys).agg(F.array(*aggs).alias("_s"))
    return one.select(*keys, F.inline("_s"))


# ---- labels -------------------------------------------------------------------------------


def label_counts(rows, label, keys=SAMPLE, top=K.KEPT_LABELS):
    """Most frequent context labels of each sample, ties by label; ``top=None`` keeps all."""
    counts = (
        rows.where(~F.col("is_query") & F.col(label).isNotNull())
        .groupBy(*keys, F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if top is None:
        return counts
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "label")
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def label_map(counts, seed, keys=SAMPLE):
    """Random codes 0..k-1 of the kept labels of each sample."""
    w = W.partitionBy(*keys).orderBy(draw(seed, "label", *keys, "label"), "label")
    return counts.select(*keys, "label", (F.row_number().over(w) - 1).cast("int").alias("code"))


def encode_labels(rows, mapping, label, keys=SAMPLE, clustering=False, out="code"):
    """Code of each row's label, or the code for other labels when it is rare, new or null.

    The codes of a sample travel as one small map, so the rows keep their partitioning by sample.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("label", "code")))
    maps = mapping.groupBy(*keys).agg(entries.alias("_codes"))
    other = F.lit(K.OTHER_LABEL)
    if clustering:
        other = F.greatest(other, F.size("_codes"))
    found = F.when(F.col(label).isNotNull(), F.try_element_at("_codes", F.col(label)))
    return (
        rows.join(maps, list(keys), "left")
        .withColumn(out, F.coalesce(found, other).cast("int"))
        .drop("_codes")
    )


def code_labels(rows, label, keys=SAMPLE, seed=42, clustering=False, out="code"):
    """``encode_labels`` with the map of ``label_map``, as windows over the sample's own exchange: the rows
    are read once and nothing is joined."""
    y, sample = F.col(f"`{label}`"), whole(keys)
    seen = F.count(context(y)).over(whole(keys, y))
    rows = rows.withColumn("_seen", seen)
    # Labels without a context row rank last, so a rank counts kept labels only.
    place = F.dense_rank().over(sample.orderBy(F.desc("_seen"), y))
    kept = F.col("_seen") > 0
    if not clustering:
        kept = kept & (F.col("_place") <= K.KEPT_LABELS)
    rows = rows.withColumn("_place", place).withColumn("_kept", kept)
    drawn = F.when(F.col("_kept"), draw(seed, "label", *keys, y))
    code = F.dense_rank().over(sample.orderBy(F.desc("_kept"), drawn, y)) - 1
    rows = rows.withColumn("_drawn", F.when(F.col("_kept"), code))
    other = F.lit(K.OTHER_LABEL)
    if clustering:
        other = F.greatest(other, F.coalesce(F.max("_drawn").over(sample) + 1, F.lit(0)))
    return rows.withColumn(out, F.coalesce("_drawn", other).cast("int")).drop("_seen", "_place", "_kept", "_drawn")


def label_texts(rows, label, vector, keys=SAMPLE, row="row_ord", out="label_text"):
    """Label texts told apart where label vectors collide, as windows over the sample's own exchange.

    ``vector`` gives the vector of a text column. With fewer distinct vectors than labels in a sample, a
    text becomes ``ordinal_label``, the ordinal counting labels by first appearance. Null stays null.
    """
    y, sample = F.col(f"`{label}`").cast("string"), whole(keys)
    rows = rows.withColumn("_y", y).withColumn("_first", F.min(row).over(whole(keys, "_y")))
    # One row of each label stands for it, so a vector is made once a label.
    lead = F.col("_y").isNotNull() & (F.col(row) == F.col("_first"))
    rows = rows.withColumn("_v", F.when(lead, vector(F.col("_y"))))
    vectors = F.size(F.collect_set("_v").over(sample))
    labels = F.count(F.when(lead, 1)).over(sample)
    nulls_last = F.when(F.col("_y").isNotNull(), F.col("_first")).asc_nulls_last()
    ordinal = F.dense_rank().over(sample.orderBy(nulls_last)) - 1
    rows = rows.withColumns({"_apart": vectors < labels, "_ordinal": ordinal})
    text = F.when(F.col("_apart") & F.col("_y").isNotNull(), F.concat_ws("_", F.col("_ordinal").cast("string"), "_y")).otherwise(F.col("_y"))
    return rows.withColumn(out, text).drop("_y", "_first", "_v", "_apart", "_ordinal")


def classes(rows, label):
    """Sorted distinct labels."""
    return rows.select(F.col(label).alias("label")).where("label is not null").distinct().orderBy("label")


# ---- targets ------------------------------------------------------------------------------


def hide(x, hidden=K.HIDDEN):
    """Query rows show the hidden marker instead of their target."""
    return F.when(F.col("is_query"), F.lit(hidden)).otherwise(x)


def encode_target(
    rows, target, task, keys=SAMPLE, regression="bins", classification="cross-entropy",
    seed=42, bins=K.NUM_BINS, scale=None, mode="valid",
):
    """Adds target, target_delta (query rows hidden) and truth (the code of every row).

    Regression in bins: floor and delta among context quantiles, truth = rounded bin. Regression
    ``l2``: the standardised value. Classification: random label codes.
    """
    if task == "regression":
        if regression == "l2":
            out = standardise(rows, [target], keys, "target", mode)
            value, delta = F.col(_name(target, "z")), F.lit(0.0)
            label = value
            extra = [_name(target, e) for e in ("z", "mean", "std")]
        else:
            x = finite(F.col(f"`{target}`"))
            out = code_bins(rows.withColumn("_y", x), ["_y"], keys, bins, scale)
            value, delta = F.col("_y__code.floor").cast("double"), F.col("_y__code.delta")
            label = F.col("_y__code.bin").cast("double")
            extra = ["_y", "_y__code"]
    elif task == "classification":
        clustering = classification != "cross-entropy"
        out = code_labels(rows, target, keys, seed, clustering, "_code")
        value, delta = F.col("_code").cast("double"), F.lit(0.0)
        label, extra = value, ["_code"]
    else:
        raise ValueError("task is classification or regression")
    return (
        out.withColumn("truth", label)
        .withColumn("target", hide(value))
        .withColumn("target_delta", hide(delta, 0.0))
        .drop(*extra)
    )
