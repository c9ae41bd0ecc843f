"""The built-in scorer of encoded cells: query rows against the context rows of their bag.

Two rows are as similar as their features are on average: equal texts count 1, numbers and dates 1 / (1 +
their distance), in units of the encoding (standard deviations or bins) and years.
"""

import numpy as np
import pandas as pd

from .. import constants as K
from ..functions.channels import DATE, TEXT

NEAREST = 16
EPS = 1e-6


def row_similarity(cells):
    """(query row ids, context row ids, similarity matrix) of the cells of one bag and query chunk."""
    queries = np.unique(cells.loc[cells["is_query"], "row_ord"])
    context = np.unique(cells.loc[~cells["is_query"], "row_ord"])
    total, n = np.zeros((len(queries), len(context))), 0
    for _, part in cells[cells["txt"] != K.PAD_VALUE].groupby("col_pos"):
        kind = part["kind"].iloc[0]
        if kind == TEXT:
            value = pd.factorize(part["txt"])[0].astype(float)
        elif kind == DATE:
            value = (part["y"] + part["m"] / 12 + part["d"] / 372).to_numpy(float)
        else:
            # A number is standardised or a bin with a remainder, whichever the encoding did not hide.
            value = np.where(part["z"] != K.HIDDEN, part["z"], part["floor"] + part["delta"])
        asks = part["is_query"].to_numpy(bool)
        q, c = (np.full(len(ids), np.nan) for ids in (queries, context))
        q[np.searchsorted(queries, part["row_ord"][asks])] = value[asks]
        c[np.searchsorted(context, part["row_ord"][~asks])] = value[~asks]
        apart = np.abs(q[:, None] - c[None, :])
        total += np.nan_to_num((apart == 0).astype(float) if kind == TEXT else 1 / (1 + apart))
        n += 1
    return queries, context, total / max(n, 1)


def class_scorer(cells):
    """(row_ord, bag, label, score): the logit of the most similar context row of each label."""
    queries, context, near = row_similarity(cells)
    first = cells[~cells["is_query"]].drop_duplicates("row_ord").set_index("row_ord")["target_text"]
    labels = first.reindex(context)
    out = []
    for label in sorted(labels.dropna().unique()):
        best = np.clip(near[:, (labels == label).to_numpy()].max(axis=1), EPS, 1 - EPS)
        score = np.log(best) - np.log1p(-best)
        out.append(pd.DataFrame({"row_ord": queries, "bag": cells["bag"].iloc[0], "label": label, "score": score}))
    return pd.concat(out) if out else pd.DataFrame(columns=["row_ord", "bag", "label", "score"])


def value_scorer(cells, nearest=NEAREST):
    """(row_ord, bag, pred): mean target of the most similar context rows, weighted by similarity; rows
    of equal similarity come by row number. Context rows without a target do not count."""
    queries, context, near = row_similarity(cells)
    first = cells[~cells["is_query"]].drop_duplicates("row_ord").set_index("row_ord")["target"]
    target = first.reindex(context).to_numpy(float)
    known = ~np.isnan(target) & (target != K.HIDDEN)
    near, target = near[:, known], target[known]
    if not len(target):
        return pd.DataFrame({"row_ord": queries, "bag": cells["bag"].iloc[0], "pred": np.nan})
    top = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
    weight = np.take_along_axis(near, top, axis=1) + EPS
    pred = (weight * target[top]).sum(axis=1) / weight.sum(axis=1)
    return pd.DataFrame({"row_ord": queries, "bag": cells["bag"].iloc[0], "pred": pred})
