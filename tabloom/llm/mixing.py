"""Mixing sources to target weights: hierarchical budgets, shortages redistributed, seeded epochs.

A tree of levels (here domain, language, source) carries weights. The token budget flows down level
by level: each node's budget is shared among its children by weight; a child that cannot use its
share (its subtree holds fewer tokens over all allowed epochs) gives the rest to its siblings, and
only what a whole family cannot use has been kept with the families above it, since a node never
receives more than its subtree can hold. Integer arithmetic; rounding leaves fewer tokens than there are siblings.

A leaf spends its budget in epochs. Each epoch orders its documents by a seeded draw; whole epochs
take every document, the last takes the longest run from the start that fits.

The running total of a hot leaf is never sorted in one task: draws fall into buckets of about
``per_bucket`` rows, bucket totals find the one bucket in which the budget ends, and only that
bucket's rows are ranked.

Defined cases: null level values are the node ''; null texts have no tokens; equal rows (id and
text) share a draw and are interchangeable; a leaf without tokens takes its documents once; an
empty table gives no rows; extra columns pass through.
"""

from dataclasses import dataclass, field

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stage
from .words import BLANK_WORD, apart, whole


@dataclass(frozen=True)
class Level:
    """One level of the tree: its column, an SQL expression for it, and integer weights."""

    name: str
    value: str
    weights: dict = field(default_factory=dict)
    default: int = 1

    def weight(self):
        out = F.lit(self.default)
        for key, w in self.weights.items():
            out = F.when(F.col(self.name) == key, F.lit(w)).otherwise(out)
        return out.cast("bigint")


WORK = ("_full", "_rest", "_buckets", "_draw", "_bucket", "_end", "_before", "_upto", "_budget")


@dataclass(frozen=True)
class MixPlan:
    levels: tuple
    budget_percent: int = 80  # of the input's tokens
    max_epochs: int = 2
    seed: int = 42
    per_bucket: int = 256


def share_out(children, parent, node, budget):
    """children (parent columns, node, cap, w) with ``budget`` (a column) shared: adds got.

    Children sorted by cap / w fill up first; the rest split what is left by weight.
    """
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(1))
    order = family.orderBy(F.col("cap") / F.col("w"), node)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out = children.withColumns(
        {
            "_b": budget,
            "_w_all": F.sum("w").over(family),
            "_c_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    fits = F.expr("cap * (_w_all - _w_before) <= w * (_b - _c_before)")
    out = out.withColumn("_full", F.min(fits).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumns(
        {
            "_c_full": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(family),
            "_w_full": F.sum(F.when(F.col("_full"), F.col("w")).otherwise(0)).over(family),
        }
    )
    got = F.expr("CASE WHEN _full THEN cap ELSE (w * (_b - _c_full)) DIV (_w_all - _w_full) END")
    return out.withColumn("got", got).drop("_b", "_w_all", "_c_before", "_w_before", "_full", "_c_full", "_w_full")


def leaf_budgets(leaves, plan):
    """leaves (level columns, tokens) with budget."""
    names = [x.name for x in plan.levels]
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(
        F.expr(f"t * {plan.budget_percent} DIV 100").alias("_budget")
    )
    held = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    above = None
    for depth, level in enumerate(plan.levels):
        path, parent = names[: depth + 1], names[:depth]
        nodes = held.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", level.weight())
        # One row of totals, then one row per parent node: bounded by the tree.
        nodes = nodes.crossJoin(F.broadcast(total)) if above is None else nodes.join(above, parent)
        above = share_out(nodes, parent, level.name, F.col("_budget")).select(*path, F.col("got").alias("_budget"))
    return leaves.join(above.withColumnRenamed("_budget", "budget"), names)


def draw(seed, epoch):
    """Seeded hexadecimal draw of a measured document for an epoch."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_md5")
    return F.md5(key.cast("binary"))


def measure(docs, plan, tokens=None):
    """docs with n_tokens (words, or another column), tree nodes and the text's digest."""
    tokens = F.regexp_count(whole(F.col("text")), F.lit(BLANK_WORD)) if tokens is None else tokens
    nodes = {f"_node{i}": F.coalesce(F.expr(x.value).cast("string"), F.lit("")) for i, x in enumerate(plan.levels)}
    digest = F.md5(whole(F.col("text")).cast("binary"))
    return docs.withColumns({"n_tokens": tokens.cast("bigint"), "_md5": digest, **nodes})


def mix(measured, plan):
    """One row per selected document and epoch: the columns of the measured documents, level
    columns and epoch. Level columns and epoch replace others so named."""
    names = [x.name for x in plan.levels]
    nodes = [f"_node{i}" for i in range(len(names))]
    measured, given = apart(measured, WORK)
    rows = stage(measured, "mix-rows")
    sizes = rows.groupBy(*nodes).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(stage(sizes.withColumnsRenamed(dict(zip(nodes, names))), "mix-leaves"), plan)
    full = F.when(F.col("tokens") > 0, F.least(F.expr("budget DIV tokens"), F.lit(plan.max_epochs))).otherwise(0)
    leaves = leaves.withColumn("full", full).select(
        *[F.col(a).alias(b) for a, b in zip(names, nodes)],
        F.col("full").cast("int").alias("_full"),
        F.when(F.col("full") < plan.max_epochs, F.expr("budget - full * tokens")).alias("_rest"),
        F.ceil(F.col("n_rows") / plan.per_bucket).alias("_buckets"),
    )
    leaves = stage(leaves, "mix-budgets")

    def placed(by_leaf):
        out = rows.join(by_leaf, nodes).withColumn("_draw", draw(plan.seed, F.col("_full")))
        high = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("bigint")
        return out.withColumn("_bucket", F.shiftright(high * F.col("_buckets"), 32))

    # Where each leaf's last epoch ends: the first bucket at whose end the rest is exceeded.
    sums = placed(leaves).filter("_rest is not null").groupBy(*nodes, "_rest", "_bucket").agg(F.sum("n_tokens").alias("s"))
    upto = F.sum("s").over(W.partitionBy(*nodes).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).filter("upto > _rest").groupBy(*nodes)
    ends = ends.agg(F.min("_bucket").alias("_end"), F.min_by(F.col("upto") - F.col("s"), "_bucket").alias("_before"))
    dealt = placed(stage(leaves.join(ends, nodes, "left"), "mix-ends"))

    none = F.array().cast("array<int>")
    epochs = F.when(F.col("_full") > 0, F.sequence(F.lit(0), F.col("_full") - 1)).otherwise(none)
    inside = F.col("_rest").isNotNull() & (F.col("_end").isNull() | (F.col("_bucket") < F.col("_end")))
    keep = [c for c in measured.columns if c not in {*names, *nodes, "epoch", "_md5"}]
    shown = [*[F.col(c) for c in keep], *[F.col(a).alias(b) for a, b in zip(nodes, names)]]
    all_epochs = F.when(inside, F.concat(epochs, F.array("_full"))).otherwise(epochs)
    most = dealt.select(*shown, F.explode(all_epochs).alias("epoch"))
    run = W.partitionBy(*nodes).orderBy("_draw", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    edge = dealt.filter(F.col("_rest").isNotNull() & (F.col("_bucket") == F.col("_end")))
    edge = edge.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(run)).filter("_upto <= _rest")
    return most.union(edge.select(*shown, F.col("_full").alias("epoch"))).withColumnsRenamed(given)


def mix_documents(docs, plan):
    """The documents a plan takes, one row per epoch that takes them, with their own columns alone."""
    work = ("n_tokens", "_md5", "epoch", *(f"_node{i}" for i in range(len(plan.levels))))
    docs, names = apart(docs, work)
    return mix(measure(docs, plan), plan).select(*docs.columns).withColumnsRenamed(names)
