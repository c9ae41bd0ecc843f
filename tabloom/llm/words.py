"""Word arrays and small expression helpers shared by the text operators (built-in functions only)."""

from pyspark.sql import functions as F

BLANK_RUN = r"[\x20\x09-\x0D]+"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
# Words of the licence and benchmark scans before lower-casing: digits, ASCII letters, all beyond ASCII.
PLAIN_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value, body):
    """``body`` with ``value`` computed once per row, also where lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def whole(text):
    """A text column with null read as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text):
    """A-Z in lower case, all else as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def blank_words(text):
    """Runs of anything but blanks, in order; null gives none."""
    return F.array_remove(F.split(whole(text), BLANK_RUN), "")


def plain_words(text):
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case; null gives none."""
    return F.array_remove(F.split(ascii_lower(whole(text)), PLAIN_GAP), "")


def text_key(text):
    """Joins a row with what was found in its text, next to its id; equal rows share it."""
    return F.xxhash64(whole(text), F.length(whole(text)))


def same_row(a, b, key="doc_id"):
    """Join condition over a nullable id and text_key, columns of frames a and b."""
    return a[key].eqNullSafe(b[key]) & (a["text_key"] == b["text_key"])


def beside(docs, names, *columns):
    """Columns of docs by name and others after them, named by place so that no names can clash."""
    chosen = docs.select(*["`" + c.replace("`", "``") + "`" for c in names], *columns)
    return chosen.toDF(*[f"c{i}" for i in range(len(chosen.columns))])


def apart(docs, work):
    """(docs with columns named like a work column, or in need of quotes, renamed; the names that give the
    old ones back)."""
    work = {w.lower() for w in work}
    taken, new = work | {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in work or "." in c or "`" in c:
            name = c.replace(".", "_").replace("`", "_")
            while name.lower() in taken:
                name = f"_{name}_"
            taken.add(name.lower())
            new[c] = name
    return docs.withColumnsRenamed(new), {b: a for a, b in new.items()}
