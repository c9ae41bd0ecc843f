"""Licence scan by a positional index of rare licence words.

Every licence word of a file is kept with its position. Of the words of each template that the file
holds, the rarest ones (fewest documents over the whole corpus) are looked up in the template's postings.
Three or more (all, if the template has fewer) that stand at one relative position make the template a
candidate there, and the candidate counts once the template's mandatory key phrase stands word by word where that position puts
it. A notice that stands in a file in full is always found: words are ranked per template, so that no
other notice of the file displaces them. Fixed phrases give the base labels.

The templates are a fixed list, so vocabulary, postings and phrases are bounded and broadcast; a
file's words are never shuffled, only its licence words.

Defined cases: a null text has no words; equal rows get equal results; no licence words give null
positions, empty labels and score 0; an empty table gives no rows; a very long text may leave as many
rows as it has licence words, ranked by distinct words only; extra columns are ignored.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stage
from .words import plain_words

# Phrases with their base labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices of common licences with the phrase each must contain.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "apache license version 2 0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        "binary forms",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "cc-attribution": ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "gpl-3": ("licensed under the gnu general public license version 3", "public license version 3"),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        "terms of the gnu general public license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "copy modify",
    ),
    "lgpl": ("terms of the gnu lesser general public license as published", "gnu lesser general public license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "hereby granted free",
    ),
    "mit-notice": ("released under the mit license", "mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "reserved": ("all rights reserved", "rights reserved"),
    "unlicense": ("free and unencumbered software released into the public domain", "public domain"),
}
COMMON = set("a all and any are as by can for in into is it may not of or that the this to under use with without you".split())
RARE_WORDS = 5
MIN_SHARED = 3


def key_offset(template):
    """Where the key phrase of a template stands in it."""
    text, key = (x.split() for x in TEMPLATES[template])
    return next(i for i in range(len(text)) if text[i : i + len(key)] == key)


def _phrases():
    out = [("base", label, i, k, w, len(p.split()), 0) for i, (p, label) in enumerate(BASE.items()) for k, w in enumerate(p.split())]
    for i, (label, (_, key)) in enumerate(TEMPLATES.items()):
        width, at = len(key.split()), key_offset(label)
        out += [("key", label, len(BASE) + i, k, w, width, at) for k, w in enumerate(key.split())]
    return out


def _postings():
    return [(label, k, w) for label, (text, _) in TEMPLATES.items() for k, w in enumerate(text.split()) if w not in COMMON]


def looked_up_words(rare_words=RARE_WORDS):
    """{template: most words of it that are looked up}."""
    return {t: min(rare_words, len({w for u, _, w in _postings() if u == t})) for t in TEMPLATES}


VOCABULARY = sorted({p[4] for p in _phrases()} | {p[2] for p in _postings()})
LOOKED_UP = sorted({p[2] for p in _postings()})


def licence_words(docs):
    """(row, doc_id, n_words, hits) with hits the (pos, word) of each vocabulary word, in order."""
    cut = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    placed = F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    found = F.filter(placed, lambda h: h.word.isin(VOCABULARY))
    return cut.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("bigint").alias("n_words"),
        found.alias("hits"),
    )


def scan_licences(docs, rare_words=RARE_WORDS, min_shared=MIN_SHARED):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates)."""
    spark = docs.sparkSession
    files = stage(licence_words(docs), "licence-words")  # row numbers are read, not drawn, from here on
    hits = files.select("row", F.inline("hits"))
    phrases = F.broadcast(
        spark.createDataFrame(_phrases(), "kind string, label string, phrase int, k int, word string, width int, offset int")
    )
    postings = spark.createDataFrame(_postings(), "template string, at int, word string")

    of = ("row", "kind", "label", "phrase", "width", "offset", (F.col("pos") - F.col("k")).alias("start"))
    places = hits.join(phrases, "word").groupBy(*of).agg(F.count(F.lit(1)).alias("n")).filter("n = width")
    base = places.filter("kind = 'base'").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"),
        F.min("start").cast("bigint").alias("first_word"),
        F.max("start").cast("bigint").alias("last_word"),
        F.collect_set("label").alias("base_set"),
    )
    keys = places.filter("kind = 'key'").select(
        "row", F.col("label").alias("template"), (F.col("start") - F.col("offset")).alias("shift")
    )

    looked_up = hits.filter(F.col("word").isin(LOOKED_UP))
    present = looked_up.select("row", "word").distinct()
    spread = present.groupBy("word").agg(F.count(F.lit(1)).alias("n_files"))  # at most the vocabulary
    rank = F.row_number().over(W.partitionBy("row", "template").orderBy("n_files", "word"))
    rare = present.join(F.broadcast(spread), "word").join(F.broadcast(postings.select("template", "word").distinct()), "word")
    rare = rare.withColumn("rank", rank).filter(F.col("rank") <= rare_words).select("row", "template", "word")
    met = rare.join(looked_up, ["row", "word"]).join(F.broadcast(postings), ["template", "word"])
    met = met.select("row", "template", (F.col("pos") - F.col("at")).alias("shift"), "word")
    met = met.unionByName(keys.withColumn("word", F.lit(None).cast("string")))
    # A null word stands for the key phrase; words are counted without it.
    votes = met.groupBy("row", "template", "shift").agg(
        F.count_distinct("word").alias("shared"), F.bool_or(F.col("word").isNull()).alias("keyed")
    )
    most = F.create_map(*[F.lit(x) for pair in looked_up_words(rare_words).items() for x in pair])
    votes = votes.withColumn("most", F.element_at(most, F.col("template")))
    votes = votes.filter(F.col("keyed") & (F.col("shared") >= F.least(F.lit(min_shared), F.col("most"))))
    share = F.max(F.col("shared") / F.col("most"))
    verified = votes.groupBy("row").agg(F.collect_set("template").alias("names"), share.alias("best"))

    none = F.array().cast("array<string>")
    out = files.select("row", "doc_id", "n_words").join(base, "row", "left").join(verified, "row", "left")
    base_set, names = F.coalesce("base_set", none), F.coalesce("names", none)
    return out.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, names)), ",").alias("labels"),
        F.when(F.size(base_set) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.size(names).cast("bigint").alias("n_templates"),
    )
