"""Licence scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of these k-grams in the templates.
A hit votes for the diagonal (place in the document minus place in the template). Neighbouring diagonals of a template
are merged into spans (words put in or left out move the diagonal), which drift by no more than the template's length.
A span is verified in order: of each of the template's k-grams one hit counts, if it stands after that of the k-gram
before, and COVERAGE of all k-grams must count. Hits of unequal words under an equal hash are dropped before they vote.

Spans that share words are one place, and the best covered template names it (then the longer one, then by label), so
that a version 3 notice is no version 2 notice as well. BASE phrases must stand in full, count everywhere, and don't compete.

Edge cases: a null or empty text has no words, no places, empty labels and score 0; rows equal in id and text get
equal results, once a row; overlapping base places all count; ids may be null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.common import row_key, stored, words

COVERAGE = 0.6
#: Diagonals at most that far apart are neighbours.
NEIGHBOUR = 3

#: The phrases that must stand in full, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and texts of public licences, and their labels. A label may have several.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("creative-commons", "licensed under a creative commons attribution 4 0 international license"),
    ("creative-commons", "licensed under the creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """A row for each k-gram hash of the templates: h2, h3 (one of them null), gram, at (template, place, grams)."""
    rows = [(label, text, True) for text, label in BASE.items()] + [(label, text, False) for label, text in NOTICES]
    array = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(a).alias("label"), F.lit(t).alias("text"), F.lit(b).alias("base")) for i, (a, t, b) in enumerate(rows)])
    table = spark.range(1).select(F.inline(array)).withColumn("w", words(F.col("text")))
    k = F.least(F.lit(3), F.size("w"))
    grams = table.withColumn("k", k).select(
        "tid", "label", "base", "k", (F.size("w") - k + 1).alias("n_grams"), F.posexplode(F.expr("transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))")).alias("tpos", "gram")
    )
    part = F.split("gram", " ")
    hashed = grams.withColumn("h3", F.when(F.col("k") == 3, F.xxhash64(part[0], part[1], part[2]))).withColumn("h2", F.when(F.col("k") == 2, F.xxhash64(part[0], part[1])))
    return hashed.groupBy("h2", "h3", "gram").agg(F.collect_list(F.struct("tid", "label", "base", "tpos", "n_grams")).alias("at"))


def short_firsts() -> list[str]:
    """First words of the templates of two words."""
    return sorted({t.split()[0] for t in [*BASE, *(t for _, t in NOTICES)] if len(t.split()) == 2})


def hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The stored hits of one pass over the texts: _id, _th, pos, at (template places), n_words. The first word of each
    row of docs has a row (a text without words has one of null pos), with n_words; other words only if they hit."""
    grams = template_grams(docs.sparkSession)
    threes = F.broadcast(grams.where("h3 is not null").select("h3", F.col("gram").alias("gram3"), F.col("at").alias("at3")))
    twos = F.broadcast(grams.where("h2 is not null").select("h2", F.col("gram").alias("gram2"), F.col("at").alias("at2")))
    firsts = ", ".join(f"'{x}'" for x in short_firsts())
    keyed = row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    rolling = F.expr(f"transform(w, (x, i) -> struct(xxhash64(x, get(w, i + 1), get(w, i + 2)) as h3, if(x in ({firsts}), xxhash64(x, get(w, i + 1)), null) as h2))")
    places = (
        keyed.select("_id", "_th", words(F.col("_text")).alias("w"))
        .select("_id", "_th", "w", F.posexplode_outer(rolling).alias("pos", "h"))
        .select("_id", "_th", "w", "pos", "h.h3", "h.h2")
    )
    begins = "coalesce(pos, 0) = 0"
    found = places.join(threes, "h3", "left").join(twos, "h2", "left").where(f"gram3 is not null or gram2 is not null or {begins}")
    same = "coalesce(array_join(slice(w, pos + 1, {k}), ' ') = gram{k}, false)"
    at = f"concat(if({same.format(k=3)}, at3, array()), if({same.format(k=2)}, at2, array())) as at"
    return stored(found.selectExpr("_id", "_th", "pos", at, f"if({begins}, cast(size(w) as long), null) as n_words"), "license-hits")


def votes(found: DataFrame) -> DataFrame:
    """A row a hit: _id, _th, pos, tid, label, base, tpos, n_grams, diagonal."""
    return found.select("_id", "_th", "pos", F.inline("at")).withColumn("diagonal", F.col("pos") - F.col("tpos"))


def exact_spans(hits_: DataFrame) -> DataFrame:
    """The places of BASE phrases: diagonals for which every k-gram of the phrase voted."""
    per = hits_.where("base").groupBy("_id", "_th", "tid", "label", "n_grams", "diagonal").agg(F.count_distinct("tpos").alias("n"))
    return per.where("n = n_grams").select("_id", "_th", "label", F.lit(True).alias("base"), F.col("diagonal").alias("first"), F.lit(1.0).alias("coverage"))


def merged_spans(hits_: DataFrame) -> DataFrame:
    """Verified spans of merged diagonals: _id, _th, label, first, last (place of the first and last k-gram), n_grams, coverage."""
    key = ["_id", "_th", "tid"]
    along = Window.partitionBy(*key).orderBy("diagonal", "tpos")
    span = [*key, "label", "n_grams", "span", "part"]
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOUR, F.lit(True)).cast("int")
    numbered = hits_.where("not base").withColumn("_opens", opens).withColumn("span", F.sum("_opens").over(along))
    start = F.min("diagonal").over(Window.partitionBy(*key, "span"))
    placed = numbered.withColumn("part", F.floor((F.col("diagonal") - start) / F.col("n_grams")).cast("int"))
    one = placed.groupBy(*span, "tpos").agg(F.min("pos").alias("pos"))
    ordered = F.coalesce(F.col("pos") > F.lag("pos").over(Window.partitionBy(*key, "span", "part").orderBy("tpos")), F.lit(True)).cast("int")
    per = one.withColumn("_ordered", ordered).groupBy(*span).agg(F.sum("_ordered").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return per.withColumn("coverage", F.col("held") / F.col("n_grams")).where(F.col("coverage") >= COVERAGE)


def best_of_place(loose: DataFrame) -> DataFrame:
    """Of the spans of a row that share words, or chain to each other by that, the best."""
    order = Window.partitionBy("_id", "_th").orderBy("first", "last", "tid")
    reach = F.max(F.col("last") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = loose.withColumn("_opens", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_opens").over(order))
    best = Window.partitionBy("_id", "_th", "_island").orderBy(F.desc("coverage"), F.desc("n_grams"), "label", "first")
    kept = islands.withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
    return kept.select("_id", "_th", "label", F.lit(False).alias("base"), "first", "coverage")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans of stored hits: _id, _th, label, base, first (its first word's place), coverage."""
    flat = votes(found)
    return exact_spans(flat).unionByName(best_of_place(merged_spans(flat)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    stored_hits = hits(docs, id_col, text_col)
    found = spans(stored_hits)
    place = F.when(F.col("base"), F.col("first"))
    per = found.groupBy("_id", "_th").agg(
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    ).withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    counted = stored_hits.where("n_words is not null").select("_id", "_th", "n_words")
    return counted.join(per, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
