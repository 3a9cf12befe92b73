"""License scans by diagonal voting, in DataFrame operations only.

Every word 3-gram hash of every text is joined to the template positions that have it (templates are constants of this
module, so the broadcast is bounded). A hit votes for a diagonal: text position less template position; a position votes once,
however often its row is repeated. Diagonals of one template that lie at most SLIP apart are merged, for words put in or left
out. Each cluster with enough votes is verified on the text's words: a phrase has all its 3-grams, of a notice, whose 3-grams
break where words are left out (three for a word) and where some are put in (two for a place), a fifth of its words is enough. A phrase counts where all its words stand consecutively, which the verification compares
word by word; a notice counts where at least COVER of its words stand on its cluster's diagonals.

Defined cases: a null or empty text has no words, no labels and score 0; the empty table gives an empty result; rows that
share a doc_id are told apart by text, and equal rows get equal results; null doc_ids are kept; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, maybe_in

#: Phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Well-known notices and their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]

GRAM = 3
SLIP = 2
COVER = 0.8
#: The votes that a notice needs to be looked at: two, or one for so many of its words.
WORDS_A_VOTE = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are in lower case, to be counted only.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a column: ASCII letters in lower case, runs of them, digits and characters beyond ASCII."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, exact, t_words: the phrases and notices."""
    rows = [(k, label, exact, re.findall(WORD, text)) for k, (label, text, exact) in enumerate([*((*x, True) for x in PHRASES), *((*x, False) for x in NOTICES)])]
    return spark.createDataFrame(rows, "template int, label string, exact boolean, t_words array<string>")


def grams(df: DataFrame, keys: list[str], arr: str, pos: str) -> DataFrame:
    """keys, pos and gram: a row for each 3-gram of words and its hash."""
    n = F.size(arr)
    shifted = [F.slice(arr, F.lit(k + 1), F.greatest(n - (GRAM - 1), F.lit(0))).alias(f"w{k}") for k in range(GRAM)]
    each = df.where(n >= GRAM).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias(pos, "g"))
    return each.select(*keys, pos, F.xxhash64(*[F.col(f"g.w{k}") for k in range(GRAM)]).alias("gram"))


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``.

    score is the best verified cover of any template: 1 where a phrase or a whole notice stands.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_h"), F.col(text).cast("string").alias("text"))
    known = templates(spark)
    spots = F.broadcast(grams(known.withColumn("size", F.size("t_words")), ["template", "size", "exact"], "t_words", "t_pos"))
    hits = grams(rows.select("doc_id", "text_h", words("text").alias("w")), ["doc_id", "text_h"], "w", "pos").join(spots, "gram")

    votes = hits.groupBy("doc_id", "text_h", "template", "size", "exact", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.count_distinct("pos").alias("votes"))
    # neighbouring diagonals of a notice become one cluster; a phrase allows no slip, so each of its diagonals stands alone
    by = Window.partitionBy("doc_id", "text_h", "template").orderBy("diagonal")
    gap = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > SLIP, F.lit(True))
    numbered = votes.withColumn("cluster", F.sum(gap.cast("int")).over(by))
    found = numbered.groupBy("doc_id", "text_h", "template", "cluster").agg(F.sort_array(F.collect_set("diagonal")).alias("diagonals"), F.sum("votes").alias("votes"), F.first("size").alias("size"), F.first("exact").alias("exact"))
    enough = F.when(F.col("exact"), F.col("votes") >= F.col("size") - (GRAM - 1)).otherwise(F.col("votes") >= F.greatest(F.lit(2), F.floor(F.col("size") / WORDS_A_VOTE)))
    spans = cut(found.where(enough).select("doc_id", "text_h", "template", "diagonals"), slim=True)

    # only texts with a cluster are split again, and shuffled
    asked = cut(spans.select("doc_id", "text_h").distinct(), slim=True)
    marked = maybe_in(rows, F.xxhash64("doc_id", "text_h"), asked, F.xxhash64("doc_id", "text_h")).alias("r")
    marked = marked.join(asked.alias("a"), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.text_h") == F.col("a.text_h")), "left_semi")
    full = marked.dropDuplicates(["doc_id", "text_h"]).select("doc_id", "text_h", words("text").alias("w"))
    s, f = spans.alias("s"), full.alias("f")
    checked = s.join(f, F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("s.text_h") == F.col("f.text_h"))).select("s.*", "f.w").join(F.broadcast(known), "template")
    covered = F.expr("""size(filter(sequence(0, size(t_words) - 1), i -> exists(diagonals, d -> i + d >= 0 and i + d < size(w) and w[i + d] = t_words[i]))) / size(t_words)""")
    verified = checked.select("doc_id", "text_h", "label", "exact", F.col("diagonals")[0].alias("start"), covered.alias("cover")).where(F.when(F.col("exact"), F.col("cover") == 1).otherwise(F.col("cover") >= COVER))

    joined = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))
    base = lambda c: F.when(F.col("exact"), F.col(c))
    marks = verified.groupBy("doc_id", "text_h").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).cast("long").alias("first_word"), F.max(base("start")).cast("long").alias("last_word"),
        joined(base("label")).alias("base_labels"), joined("label").alias("labels"), F.max("cover").alias("score"),
    )
    a, m = rows.select("doc_id", "text_h", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)).cast("long").alias("n_words")).alias("a"), cut(marks, slim=True).alias("m")
    out = a.join(m, F.col("a.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("a.text_h") == F.col("m.text_h")), "left")
    return out.select(
        "a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
