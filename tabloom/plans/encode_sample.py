"""Sample encoding: prepared rows become encoded cells plus an encoded target."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.channels import DATE, NUM, TEXT, TIME, date_codes
from ..operators import encode as E
from ..operators import sampling as S


def encode(
    prepared, kind, target, task, keys=S.SAMPLE, regression="bins",
    classification="cross-entropy", mode="valid", seed=42, bins=K.NUM_BINS, scale=None, label_vector=None,
):
    """Encoded cells, one row per (sample row, feature), with the row's encoded target.

    Columns: keys, row_ord, pos, is_query, target, target_delta, truth, target_text (context labels
    of a classification), col_pos, col, mask, kind, txt, floor, delta, z, y, m, d, w. Features without any
    context value are left out. Statistics of all columns share the partitioning the preparation made.
    ``label_vector`` gives the vector of a label's text; labels whose vectors collide are told apart.
    """
    rows = coded(
        prepared, kind, target, task, keys, regression, classification, mode, seed, bins, scale, label_vector
    )
    return lay_out(rows, kind, target, task, keys, regression)


def coded(
    prepared, kind, target, task, keys, regression, classification, mode, seed, bins, scale,
    label_vector=None, state=None,
):
    """Rows with codes, target, label text and presence flags; ``state`` keeps the statistics of
    features as columns."""
    features = [c for c, k in kind.items() if c != target]
    numbers = [c for c in features if kind[c] in (NUM, TIME)]
    rows = prepared
    present = F.array(*[F.count(E.context(F.col(f"`{c}`"))).over(S.whole(keys)) > 0 for c in features])
    if numbers and regression != "l2":
        rows = E.quantile_bin(rows, numbers, keys, bins, scale, state, {"_present": present})
    else:
        rows = rows.withColumn("_present", present)
        if numbers:
            rows = E.standardise(rows, numbers, keys, "feature", mode, state)
    rows = E.encode_target(
        rows, target, task, keys, regression, classification, seed, bins, scale, mode
    )
    if label_vector is not None and task == "classification":
        rows = E.label_texts(rows, target, label_vector, keys, out="_label")
    else:
        rows = rows.withColumn("_label", F.col(f"`{target}`").cast("string"))
    return rows


def lay_out(rows, kind, target, task, keys, regression):
    """Cells of rows whose codes, target, label text, feature list and presence flags are columns."""
    features = [c for c, k in kind.items() if c != target]
    numbers = [c for c in features if kind[c] in (NUM, TIME)]
    hidden = F.lit(K.HIDDEN)
    cells = []
    for c in features:
        is_num, is_date = c in numbers, kind[c] == DATE
        codes = date_codes(F.col(f"`{c}`")) if is_date else {p: F.lit(0) for p in "ymdw"}
        code = F.col(f"`{c}__code`") if is_num and regression != "l2" else None
        z = F.col(f"`{c}__z`") if is_num and regression == "l2" else hidden
        text = F.coalesce(F.col(f"`{c}`"), F.lit(K.NULL_TEXT)) if kind[c] == TEXT else F.lit(None)
        cells.append(_cell(kind[c], text, code, z, codes, hidden))
    filler = _cell(TEXT, F.lit(K.PAD_VALUE), None, hidden, {p: F.lit(0) for p in "ymdw"}, hidden)
    label = F.coalesce("_label", F.lit(K.NULL_TEXT))
    shown = label if task == "classification" else F.lit(None).cast("string")
    rows = rows.withColumn("target_text", F.when(~F.col("is_query"), shown))
    row = [*keys, "row_ord", "pos", "is_query", "target", "target_delta", "truth", "target_text"]
    row += ["fit_rows"] if "fit_rows" in rows.columns else []
    # The list beside the cells is a higher-order function: see in_parts.
    listed = F.filter("columns", lambda c: (c["src"] < 0) | F.get("_present", c["src"]))
    rows = rows.select(*row, listed.alias("_listed"), F.array(*cells, filler).alias("_cells"))
    # Each row's cells are put in feature order on the spot; nothing is copied per cell.
    at = lambda c: F.when(c["src"] < 0, F.lit(len(features))).otherwise(c["src"])
    ordered = F.transform(
        "_listed",
        lambda c: F.named_struct(
            F.lit("col_pos"), c["pos"], F.lit("col"), c["col"], F.lit("mask"), c["mask"],
            F.lit("_cell"), F.get("_cells", at(c)),
        ),
    )
    return rows.select(*row, F.inline(ordered)).select(*row, "col_pos", "col", "mask", "_cell.*")


CELL = ("kind", "txt", "floor", "delta", "z", "y", "m", "d", "w")


def _cell(kind, text, code, z, codes, hidden):
    values = (
        F.lit(kind),
        text.cast("string"),
        (code["floor"] if code is not None else hidden).cast("double"),
        (code["delta"] if code is not None else F.lit(0.0)).cast("double"),
        z.cast("double"),
        *[codes[p].cast("int") for p in "ymdw"],
    )
    return F.named_struct(*[x for name, v in zip(CELL, values) for x in (F.lit(name), v)])
