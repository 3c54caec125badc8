"""License scan by diagonal voting.

A template is a known phrase or notice. Every rolling k-gram of a text is hashed and joined with the templates'
grams; a hit at word `pos` of the text and word `at` of the template votes for the diagonal pos - at. Votes of a
diagonal stand for words in the same order at the same distance, so a phrase is there where its diagonal has
all votes. In longer notices words may be added, left out or changed, which moves the rest to a diagonal nearby:
BAND neighbouring diagonals are merged (every two neighbouring bands, so no cut falls into a notice), and a span is
verified by the share of the template's grams that are met in it.

Only DataFrame functions are used. The grams of a text are exploded beside each other and meet the templates, a
fixed table of a few hundred rows, in a broadcast hash join; the words of a hit are compared in the join, so a hash
collision votes for nothing. What is shuffled are hits, summed per diagonal before: the votes are bits of the gram's
place in its template, joined by OR, so a text made of one phrase alone is no large group.

Defined results: a null text is empty; texts without words have no labels and score 0. Rows with equal ids are
rows of their own. Overlapping phrases each count. Very long texts are scanned as a whole; their words are an
array in one row, about three times the text. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.llm.exact_dedup import normalised

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram; phrases of two words are one gram of two.
GRAM = 3
#: Neighbouring diagonals that are merged, and the least share of a notice's grams.
BAND, SHARE = 8, 0.6
#: Grams of one template, bits of a long; words from which a template is a notice.
MOST, NOTICE = 62, 12

# The phrases that every scan counts, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Public license names and notices, with their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this "
    "work": "cc0",
    "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any "
    "means": "reserved",
}


ROW = ("uid", "id", "n_words")
TEMPLATE = ("template", "label", "base", "exact", "size")


@dataclass(frozen=True)
class Templates:
    """Phrases (all of their words, and counted) and notices (SHARE of their grams), each with a label."""

    phrases: dict[str, str]
    notices: dict[str, str]


STANDARD = Templates(PHRASES, NOTICES)


def gram_rows(templates: Templates) -> list[tuple]:
    """template, label, base, exact, size (grams), at, w0, w1, w2 (null in phrases of two words)."""
    rows = []
    every = [(t, label, True) for t, label in templates.phrases.items()]
    every += [(t, label, False) for t, label in templates.notices.items()]
    for number, (text, label, base) in enumerate(every):
        words = text.split()
        size = max(1, len(words) - GRAM + 1)
        if len(words) < 2 or size > MOST:
            raise ValueError(f"a template needs two words at least and may have {MOST} grams: {text}")
        # Names are met word for word; notices may differ in places.
        exact = base or len(words) < NOTICE
        for at in range(size):
            rows.append((number, label, base, exact, size, at, *[*words[at : at + GRAM], None][:GRAM]))
    return rows


def _grams(spark: SparkSession, templates: Templates) -> DataFrame:
    kind = "template int, label string, base boolean, exact boolean, size int, at int, w0 string, w1 string, w2 string"
    return spark.createDataFrame(gram_rows(templates), kind).withColumn("gram", F.xxhash64("w0", "w1"))


def hits(docs: DataFrame, templates: Templates = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row and diagonal with votes, and at least one per row (without a template if there are none).

    uid (row), id, n_words, template, label, base, exact, size, diagonal, votes (bits of the grams met).
    """
    words = F.regexp_extract_all(normalised(F.col(f"`{text_col}`")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), words.alias("w"), F.monotonically_increasing_id().alias("uid"))
    rolled = F.arrays_zip(
        F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"), F.expr("slice(w, 3, size(w))").alias("c")
    )
    grams = rows.select("uid", "id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(rolled).alias("pos", "g"))
    grams = grams.select("uid", "id", "n_words", "pos", "g.*").withColumn("key", F.xxhash64("a", "b"))
    known = F.broadcast(_grams(docs.sparkSession, templates))
    met = (
        (F.col("key") == F.col("gram")) & (F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1"))
        & (F.col("w2").isNull() | (F.col("c") == F.col("w2")))
    )
    found = grams.join(known, met, "left").filter("template IS NOT NULL OR COALESCE(pos, 0) = 0")
    diagonal = (F.col("pos") - F.col("at")).cast("long")
    return found.groupBy(*ROW, *TEMPLATE, diagonal.alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("votes")
    )


def _merged(votes: DataFrame, share: float) -> DataFrame:
    """Adds up the votes of neighbouring diagonals of notices: first (word), similarity, and whether that is enough."""
    band = f"CAST(floor(diagonal / {BAND}) AS LONG)"
    bands = F.expr(f"IF(exact OR template IS NULL, array(diagonal), array({band} - 1, {band}))")
    merged = votes.withColumn("band", F.explode(bands)).groupBy(*ROW, *TEMPLATE, "band").agg(
        F.bit_or("votes").alias("votes"), F.greatest(F.min("diagonal"), F.lit(0)).alias("first")
    )
    merged = merged.withColumn("similarity", F.expr("bit_count(votes) / size"))
    return merged.withColumn("found", F.expr(f"template IS NOT NULL AND similarity >= IF(exact, 1D, {share}D)"))


def spans(docs: DataFrame, templates: Templates = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified places of templates: id, label, base, first (word), similarity.

    Phrases and names have one row per place; notices one per pair of bands that hold enough of their grams.
    """
    found = _merged(hits(docs, templates, id_col, text_col), SHARE).filter("found")
    return found.select(F.col("id").alias(id_col), "label", "base", "first", "similarity")


def scanned(docs: DataFrame, templates: Templates = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word: number, least and largest start of the places of `phrases`. score: the
    largest similarity of a verified place, 0 without one.
    """
    places = _merged(hits(docs, templates, id_col, text_col), SHARE)
    labels = lambda where: F.array_join(
        F.array_sort(F.collect_set(F.expr(f"IF({where}, label, NULL)"))), ","
    )
    return places.groupBy(*ROW).agg(
        F.count_if(F.expr("found AND base")).alias("n_base"),
        F.min(F.expr("IF(found AND base, first, NULL)")).alias("first_word"),
        F.max(F.expr("IF(found AND base, first, NULL)")).alias("last_word"),
        labels("found AND base").alias("base_labels"),
        labels("found").alias("labels"),
        F.max(F.expr("IF(found, similarity, 0D)")).alias("score"),
    ).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
