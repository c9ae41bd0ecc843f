"""Vector expressions on array<double> columns; all run inside the JVM."""

from pyspark.sql import functions as F

from .draws import as_col

NORM_FLOOR = 1e-12


def let(value, body):
    """``body(value)`` with the value computed once. Inside a lambda, an outer expression would be
    computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_double(vec):
    return as_col(vec).cast("array<double>")


def dot(a, b):
    products = F.zip_with(to_double(a), to_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b):
    size = lambda v: F.sqrt(F.greatest(dot(v, v), F.lit(NORM_FLOOR)))
    return dot(a, b) / (size(a) * size(b))


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def clipped_logit(p, eps=1e-6):
    """ln(p) - ln(1-p) with p kept off 0 and 1; null or NaN gives -1e4; result within ±1e4."""
    p = as_col(p)
    inner = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    raw = F.when(p.isNull() | F.isnan(p), F.lit(-1e4)).otherwise(F.ln(inner) - F.log1p(-inner))
    return F.least(F.greatest(raw, F.lit(-1e4)), F.lit(1e4))


def softmax_array(scores):
    """Softmax over an array column, shifted by its maximum. Null entries count as absent; with none but
    those the shares are null."""

    def share(weights):
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(weights, lambda x: F.try_divide(x, t)))

    def weigh(held):
        return let(
            F.array_max(held),
            lambda top: F.transform(held, lambda s: F.coalesce(F.exp(s - top), F.lit(0.0))),
        )

    return let(scores, lambda held: let(weigh(held), share))
