"""Line-first cleaning: rules per line, then a verdict on how much of the text they took.

A line fails if it is navigation (mostly separators), if punctuation crowds its letters out, if it
is a short fragment without an end mark, or if it is boilerplate. Failing lines go; a document
losing more than ``max_loss`` percent of its non-blank characters is rejected, as is one that fails
the base rules (too few words, or too many words in repeated 3-word windows).

Defined cases: a null text has no words, fails the base rules and stays null; blank lines never
fail; equal rows get equal results; a very long text is one row and is judged whole; an empty table
gives no rows. ``score_lines`` passes other columns through and replaces those named like a new
one; ``clean_documents`` gives back the columns it got, with their own values. A run of words is compared by 64-bit hashes within one document.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from .words import BLANK_RUN, BLANK_WORD, apart, blank_words, let, whole

SCORES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines",
          "lost_chars", "kept", "clean_text")
WORK = ("_words", "_lines", "_left")
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]|>>|::"
MARKS = r"[!-/:-@\[-`{-~»›•·]"
END = r"""[.!?:;…。]["'”’»)\]]*[\x20\x09-\x0D]*$"""
BOILERPLATE = (
    "(?i)all rights reserved|cookie (policy|settings|notice)|uses cookies|accept cookies|privacy policy|"
    "terms (of|and) (use|service|conditions)|javascript (is|must be|seems)|enable javascript|lorem ipsum|"
    "click here|share this (page|post|article)|subscribe (now|to our)|sign up for|back to top|skip to content"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; percentages are whole numbers."""

    min_words: int = 50
    max_repeat: int = 50  # percent of words in repeated 3-word windows
    max_marks: int = 20  # percent of a line's non-blank characters
    mark_words: int = 5  # lines shorter than this are not judged by their marks
    min_separators: int = 3
    words_per_separator: int = 4
    fragment_words: int = 4
    max_loss: int = 50  # percent of a document's non-blank characters


def line_fails(line, rules=QualityRules()):
    """True for a line that navigation, punctuation, fragment or boilerplate rules take out."""
    n_words = F.regexp_count(line, F.lit(BLANK_WORD))
    n_separators = F.regexp_count(line, F.lit(SEPARATORS))
    n_marks = F.regexp_count(line, F.lit(MARKS))
    n_chars = F.length(F.regexp_replace(line, BLANK_RUN, ""))
    navigation = (n_separators >= rules.min_separators) & (
        n_separators * rules.words_per_separator >= n_words
    )
    crowded = (n_words >= rules.mark_words) & (100 * n_marks > rules.max_marks * n_chars)
    fragment = (n_words < rules.fragment_words) & ~line.rlike(END)
    return (n_words > 0) & (fragment | crowded | navigation | line.rlike(BOILERPLATE))


def repeat_words(words):
    """Words that lie in a 3-word window found twice or more."""

    def covered(grams):
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, i: x.h.eqNullSafe(F.get(s, i - 1).h) | x.h.eqNullSafe(F.get(s, i + 1).h),
            ),
        )
        spots = F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(
            F.size(F.array_distinct(spots))
        )

    grams = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - 2, F.lit(0)),
    )
    return let(grams, covered)


def score_lines(docs, rules=QualityRules()):
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, lost_chars, kept and clean_text (the lines left)."""
    docs, names = apart(docs, WORK)
    text = whole(F.col("text"))
    out = docs.withColumn("_words", blank_words(F.col("text"))).withColumn("_lines", F.split(text, "\n"))
    lined = F.filter("_lines", lambda x: x.rlike(BLANK_WORD))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": let(lined, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": let(F.col("_words"), repeat_words).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "_left": F.filter("_lines", lambda x: ~line_fails(x, rules)),
        }
    )
    out = out.withColumns(
        {
            "n_failed_lines": F.col("n_lines") - F.size("_left"),
            "clean_text": F.when(F.col("text").isNotNull(), F.array_join("_left", "\n")),
            "lost_chars": F.col("word_chars")
            - F.length(F.regexp_replace(F.array_join("_left", ""), BLANK_RUN, "")),
            "base_failed": (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words")),
        }
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= rules.max_loss * F.col("word_chars"))
    return out.withColumn("kept", kept).drop(*WORK).withColumnsRenamed(names)


def clean_documents(docs, rules=QualityRules()):
    """Documents that pass, with their failing lines removed and n_chars counted anew."""
    docs, names = apart(docs, (*SCORES, *WORK, "_clean"))
    scored = score_lines(docs, rules)
    # A generator drops the others: a filter would be pushed down and score every text twice.
    passed = F.when(F.col("kept"), F.array(F.struct(F.col("clean_text").alias("_clean"))))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    scored = scored.select(*others, F.inline(passed))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("bigint")}
    return scored.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns]).withColumnsRenamed(names)
