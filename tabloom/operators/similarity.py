"""Similarity of query rows to context rows.

Pairs are never written out: a block of query vectors meets its context as a matrix product in
an Arrow task and leaves one number per query and class.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vectors import NORM_FLOOR

KINDS = ("cosine", "dot")
BLOCK_ROWS = 1024


def _matrix(column):
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _units(m):
    norm = np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), NORM_FLOOR))
    return m / norm


def _similarities(q, c, kind):
    """Row similarities as the scorer sees them: cosine, or the sigmoid of the dot product.

    Both are symmetric, so averaging with the transpose changes nothing.
    """
    if kind == "cosine":
        return _units(q) @ _units(c).T
    return 1.0 / (1.0 + np.exp(-(q @ c.T)))


def _class_best(sims, codes):
    """Per query and class the best similarity: (distinct codes, matrix of maxima)."""
    order = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[order], return_index=True)
    return found, np.maximum.reduceat(sims[:, order], starts, axis=1)


def _check(kind):
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")


def class_similarity(rows, keys, row, vec, code, kind="cosine"):
    """(keys, row, code, sim): best similarity of each query row to each class of its sample.

    ``rows`` holds samples (chunk-bounded) with is_query; ``code`` is an integer class. Classes
    absent from the context have no row, which stands for minus infinity.
    """
    _check(kind)
    keys = list(keys)
    part = rows.select(*keys, row, "is_query", F.col(vec).alias("_v"), F.col(code).alias("_c"))
    types = {f.name: f.dataType.simpleString() for f in part.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, row]) + ", code bigint, sim double"

    def score(group):
        is_query = group["is_query"].to_numpy(bool)
        ctx, qry = group[~is_query], group[is_query]
        ctx = ctx[ctx["_c"].notna()]
        names = [*keys, row, "code", "sim"]
        if not len(ctx) or not len(qry):
            return pd.DataFrame({n: [] for n in names})
        codes, context = ctx["_c"].to_numpy(np.int64), _matrix(ctx["_v"])
        outs = []
        for at in range(0, len(qry), BLOCK_ROWS):
            block = qry.iloc[at : at + BLOCK_ROWS]
            found, best = _class_best(_similarities(_matrix(block["_v"]), context, kind), codes)
            out = block[[*keys, row]].loc[block.index.repeat(len(found))].reset_index(drop=True)
            out["code"], out["sim"] = np.tile(found, len(block)), best.ravel()
            outs.append(out)
        return pd.concat(outs, ignore_index=True)[names]

    return part.groupBy(*keys).applyInPandas(score, schema)


def nearest_context(rows, keys, row, vec, kind="cosine"):
    """What each query row sees: (keys, row, n_context, nearest, sim) over its context rows only.

    Query rows never see each other. Ties go to the lowest context row.
    """
    _check(kind)
    keys = list(keys)
    part = rows.select(*keys, row, "is_query", F.col(vec).alias("_v"))
    types = {f.name: f.dataType.simpleString() for f in part.schema.fields}
    schema = (
        ", ".join(f"`{k}` {types[k]}" for k in [*keys, row])
        + ", n_context bigint, nearest bigint, sim double"
    )

    def look(group):
        group = group.sort_values(row)
        is_query = group["is_query"].to_numpy(bool)
        ctx, qry = group[~is_query], group[is_query]
        outs = [pd.DataFrame({n: [] for n in [*keys, row, "n_context", "nearest", "sim"]})]
        context, ids = _matrix(ctx["_v"]), ctx[row].to_numpy()
        for at in range(0, len(qry) if len(ctx) else 0, BLOCK_ROWS):
            block = qry.iloc[at : at + BLOCK_ROWS]
            sims = _similarities(_matrix(block["_v"]), context, kind)
            best = sims.argmax(axis=1)
            out = block[[*keys, row]].copy()
            out["n_context"], out["nearest"] = len(ctx), ids[best]
            out["sim"] = sims[np.arange(len(block)), best]
            outs.append(out)
        return pd.concat(outs[1:] or outs, ignore_index=True)

    return part.groupBy(*keys).applyInPandas(look, schema)


def pair_sums(rows, keys, row, vec, label, kind="cosine", context_to_query=False):
    """Per sample: pair count, pair loss sum, and the agreement counts over all row pairs.

    Each task holds one sample and walks it in row blocks; only sums leave the task.
    ``context_to_query`` restricts the loss to pairs of a context row and a query row.
    """
    _check(kind)
    keys = list(keys)
    extra = ["is_query"] if context_to_query else []
    part = rows.select(*keys, row, F.col(vec).alias("_v"), F.col(label).alias("_c"), *extra)
    types = {f.name: f.dataType.simpleString() for f in part.schema.fields}
    schema = (
        ", ".join(f"`{k}` {types[k]}" for k in keys)
        + ", n_pairs bigint, loss_sum double, n_linked bigint, n_agree bigint"
    )

    def walk(group):
        m = _matrix(group["_v"])
        labels = group["_c"].to_numpy()
        is_query = group["is_query"].to_numpy(bool) if context_to_query else None
        unit = _units(m) if kind == "cosine" else m
        pairs, loss_sum, linked, agree = 0, 0.0, 0, 0
        for at in range(0, len(m), BLOCK_ROWS):
            block = slice(at, at + BLOCK_ROWS)
            raw = unit[block] @ unit.T
            same = labels[block][:, None] == labels[None, :]
            if kind == "cosine":
                p = np.clip(np.clip(raw, 0, 1), 1e-7, 1 - 1e-7)
                loss, seen = -np.where(same, np.log(p), np.log(1 - p)), raw > 0.5
            else:
                loss = np.maximum(raw, 0) - raw * same + np.log1p(np.exp(-np.abs(raw)))
                seen = 1.0 / (1.0 + np.exp(-raw)) > 0.5
            if context_to_query:
                use = (~is_query[block])[:, None] & is_query[None, :]
                pairs, loss_sum = pairs + int(use.sum()), loss_sum + float(loss[use].sum())
            else:
                pairs, loss_sum = pairs + loss.size, loss_sum + float(loss.sum())
            linked += int((seen | same).sum())
            agree += int((seen & same).sum())
        out = {k: [group[k].iloc[0]] for k in keys}
        out.update(n_pairs=[pairs], loss_sum=[loss_sum], n_linked=[linked], n_agree=[agree])
        return pd.DataFrame(out)

    return part.groupBy(*keys).applyInPandas(walk, schema)


def pair_log_loss(sums, keys):
    """Three times the mean pair cross-entropy."""
    mean = F.col("loss_sum") / F.greatest(F.col("n_pairs"), F.lit(1))
    return sums.select(*keys, (mean * 3.0).alias("pair_loss"))


def pair_jaccard(sums, keys):
    """Of the pairs linked by prediction or by label, the share linked by both."""
    share = F.col("n_agree") / F.greatest(F.col("n_linked"), F.lit(1))
    return sums.select(*keys, share.alias("pair_jaccard"))


def symmetrise(sims, keys, left="i", right="j", sim="sim"):
    """(s + sᵀ) / 2 of a row × row similarity table, by one aggregation instead of a self-join."""
    a, b = F.least(left, right), F.greatest(left, right)
    mean = sims.groupBy(*keys, a.alias("_a"), b.alias("_b")).agg(F.avg(sim).alias("sim"))
    both = F.array(
        F.struct(F.col("_a").alias(left), F.col("_b").alias(right)),
        F.struct(F.col("_b").alias(left), F.col("_a").alias(right)),
    )
    one = F.array(F.struct(F.col("_a").alias(left), F.col("_b").alias(right)))
    shape = F.when(F.col("_a") == F.col("_b"), one).otherwise(both)
    return mean.select(*keys, F.inline(shape), "sim")


def score_hook(samples, keys, scorer, schema):
    """Run a user scorer on encoded samples: pandas frame of one (sample, bag, query chunk) in,
    scores out. Groups hold one context and one query chunk."""
    return samples.groupBy(*keys).applyInPandas(scorer, schema)
