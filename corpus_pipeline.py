"""From raw documents to token files: the training-data operators in a row.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and gives a frame
that ``run`` writes as Parquet and reads back, so that a lost executor repeats one stage at most.

Defined cases: null and empty texts fail the first stage; of rows equal in id and text one is left, rows
with an id in common but other texts are documents of their own; null ids take part; columns of any
name pass through to the last stage; an empty table gives no rows; each stage holds a text whole, as one row.
"""

from tabloom.llm.decontaminate import drop_contaminated
from tabloom.llm.jaccard import first_of_each
from tabloom.llm.mixing import mix_documents
from tabloom.llm.quality import clean_documents
from tabloom.llm.queries import mix_plan, table, vocabulary
from tabloom.llm.tokens import token_files
from tabloom.sources.shared import stage

def quality_rules(spark, docs, sf_dir):
    """Failing lines go, and documents that lose too much or fail the base rules."""
    return clean_documents(docs)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return first_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents with a window of a test item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Documents by target weights, one row per epoch that takes them."""
    return mix_documents(docs, mix_plan("_mix_"))


def token_output(spark, docs, sf_dir):
    """Token files of what is left, read back: one row per document."""
    return token_files(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

# The last stage's ids come from a tokenizer that SQL does not have; tests use a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
