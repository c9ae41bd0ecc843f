"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters 1 to 3 long, lower-cased and hashed into 2^16 features, weighted by counts times inverse
document frequency (over all training documents) and scaled to one total per text. Weights come from
follow-the-regularised-leader with elastic-net penalties on at most ``max_rows`` labelled texts,
drawn by a seeded hash with equal shares per language; a fifth of them sets the temperature.

The feature table and the weights have a fixed size, so they travel to every task; texts are read
whole, one at a time, and nothing is shuffled but one row per feature.

Defined cases: null texts and texts without a letter are "und" with score 0; with no labelled
training text every prediction is that; a null id counts as the id ''; rows without language are
predicted but not learned from; equal texts get equal predictions; extra columns are ignored. More
than ``max_classes`` languages are an error, not a cut.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

BITS = 16
WIDTH = 1 << BITS
ORDERS = 3
SCALE = 30.0


@dataclass(frozen=True)
class FitSettings:
    max_rows: int = 4_000
    max_classes: int = 1_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    seed: int = 42


def features(text):
    """Feature numbers of all n-grams of a text, with repeats."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out, gram = [], None
    for order in range(min(ORDERS, len(points))):
        gram = points.copy() if gram is None else gram[:-1] * np.uint32(0x01000193) + points[order:]
        out.append((gram * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def fold(docs):
    """Remainder by 4 of the crc32 of the id as text; 2 is held out."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4


def document_frequencies(training):
    """(number of documents, array of documents per feature) over all training texts."""

    def count(batches):
        seen, n = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                mark = np.zeros(WIDTH, dtype=bool)
                mark[features(text.as_py() or "")] = True
                seen += mark
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = training.select("text").mapInArrow(count, "feature long, n long").groupBy("feature")
    table = rows.agg(F.sum("n").alias("n")).toPandas()  # one row per feature
    n = int(table.loc[table.feature == -1, "n"].sum())
    df = np.zeros(WIDTH)
    table = table[table.feature >= 0]
    df[table.feature.to_numpy()] = table.n.to_numpy()
    return n, df


def draw_rows(training, counts, settings):
    """[(language, feature numbers, counts)] of at most max_rows texts, about equal by language."""
    share = settings.max_rows / max(1, len(counts))
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(part)
    drawn = F.xxhash64(F.lit(settings.seed), "doc_id", "text")
    picked = training.withColumn("d", drawn).filter(F.pmod("d", F.lit(1_000_000)) < part * 1_000_000)

    def sparse(batches):
        for batch in batches:
            d, lang, at, n = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                where, counts_here = np.unique(features(text.as_py()), return_counts=True)
                d.append(batch.column(0)[i].as_py())
                lang.append(batch.column(1)[i].as_py())
                at.append(where.astype("<u4").tobytes())
                n.append(counts_here.astype("<f8").tobytes())
            yield pa.RecordBatch.from_pydict({"d": pa.array(d, pa.int64()), "lang": lang, "at": at, "n": n})

    rows = picked.select("d", "lang", "text").mapInArrow(sparse, "d long, lang string, at binary, n binary")
    rows = rows.orderBy("d", "lang").limit(settings.max_rows).collect()
    return [(r.lang, np.frombuffer(r["at"], "<u4"), np.frombuffer(r["n"], "<f8")) for r in rows]


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows, n_classes, settings):
    """(weights, bias) from [(class, features, values)] by FTRL-proximal with elastic net."""
    z, n = np.zeros((WIDTH + 1, n_classes)), np.zeros((WIDTH + 1, n_classes))

    def weights(zz, nn):
        shrunk = np.sign(zz) * settings.l1 - zz
        return np.where(np.abs(zz) <= settings.l1, 0.0, shrunk / ((settings.beta + np.sqrt(nn)) / settings.alpha + settings.l2))

    order = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            target, at, x = rows[i]
            at, x = np.append(at, WIDTH), np.append(x, 1.0)  # the last feature is the bias
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[target] -= 1.0
            g = np.outer(x, p)
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(logits, targets):
    """Divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(targets):
        return 1.0
    logits, targets = np.array(logits), np.array(targets)

    def loss(log_t):
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        return (np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[np.arange(len(targets)), targets]).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Languages, weights by feature (times idf), idf, bias and temperature."""

    languages: list
    table: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text):
        at = features(text)
        total = self.idf[at].sum()
        return self.bias + (self.table[at].sum(axis=0) * (SCALE / total) if total else 0.0)

    def predict(self, text):
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def fit(training, settings=FitSettings()):
    """A model from rows (doc_id, text, lang); rows without text, letter or language do not count."""
    training = training.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    by_lang = training.groupBy("lang").count().limit(settings.max_classes + 1).collect()
    counts = {r[0]: r[1] for r in by_lang}
    if len(counts) > settings.max_classes:
        raise ValueError(f"more than {settings.max_classes} languages")
    languages = sorted(counts)
    n, df = document_frequencies(training)
    idf = np.log((1.0 + n) / (1.0 + df)) + 0.1
    rows = []
    for lang, at, c in draw_rows(training, counts, settings):
        x = c * idf[at]
        if x.size:
            rows.append((languages.index(lang), at, x * (SCALE / x.sum())))
    if not rows:
        return LanguageModel([], np.zeros((WIDTH, 0)), idf, np.zeros(0), 1.0)
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    w, bias = ftrl(used or rows, len(languages), settings)
    t = temperature([bias + x @ w[at] for _, at, x in held], [target for target, _, _ in held])
    return LanguageModel(languages, w * idf[:, None], idf, bias, t)


def predict(docs, model):
    """(doc_id, lang_pred, score, plus the columns passed on) for every row."""

    def score(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(score, f"{kept}, lang_pred string, score double")


def identify(docs, settings=FitSettings()):
    """(doc_id, held_out, lang_pred, score) of every document, learned from the folds not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", fold(docs) == 2)
    model = fit(rows.filter(~F.col("held_out")).drop("held_out"), settings)
    return predict(rows.drop("lang"), model)
