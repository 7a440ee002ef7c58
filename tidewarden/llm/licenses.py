"""License scans by diagonal voting, in DataFrame operations only.

All rolling word pairs of every text are hashed and joined with the pairs of the templates at their positions. Each
match votes for a diagonal (text position minus template position); votes are counted by document, template and
diagonal; neighbouring diagonals are merged, so that a few inserted or missing words do no harm; and spans are
verified. A base phrase needs every pair of its words on one diagonal, which proves that its words stand consecutively
(hashes are checked against the words themselves); a longer template needs MIN_SHARE of its distinct pairs in one run of diagonals
at most NEAR apart. `spans` gives the verified spans, `scan` one row per document.

Defined cases: null text counts as empty and has no words; documents without a match have nulls and empty labels;
repeated doc_ids are scanned row by row; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

#: Words in a rolling window; the shortest phrase has as many.
K = 2
#: Diagonals at most this far apart are one passage of a longer template.
NEAR = 4
#: Share of a longer template's positions that must be found near one diagonal.
MIN_SHARE = 0.6

#: Base phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Sentences by which a license is known, matched in part, and labels.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd",
    ),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
#: Whole license texts, lower-cased and without signs, and labels.
WHOLE_TEXTS = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but "
        "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be "
        "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
        "use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is "
        "provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
        "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
        "way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this "
        "software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as "
        "such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)

#: Templates that are matched in part.
TEMPLATES = (*SENTENCES, *WHOLE_TEXTS)

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text="text"):
    """Array of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased.

    lower() also changes letters outside ASCII, in length only within a word; the Kelvin sign, the one whose lower
    case is ASCII, is kept apart beforehand."""
    low = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("")))
    return F.filter(F.split(low, _GAP), lambda w: w != "")


def template_rows(phrases=PHRASES, templates=TEMPLATES) -> list[tuple]:
    """(template, position, pair, positions in the template, whole, label)."""
    rows = []
    for n, (phrase, label) in enumerate((*phrases, *templates)):
        w = phrase.split()
        rows += [(n, i, " ".join(w[i : i + K]), len(w) - K + 1, n < len(phrases), label) for i in range(len(w) - K + 1)]
    return rows


def template_frame(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """The rows of `template_rows` with the pair's words and hash, and one row, template -1, that the end of each text meets."""
    made = spark.createDataFrame(template_rows(phrases, templates), "template int, at int, pair string, n int, whole boolean, label string")
    word = lambda i: F.element_at(F.split("pair", " "), i)
    made = made.select("template", "at", word(1).alias("t_a"), word(2).alias("t_b"), "n", "whole", "label")
    end = spark.createDataFrame([(-1, 0, "", None, 0, None, None)], made.schema)
    return made.unionByName(end).withColumn("gram", F.xxhash64("t_a", "t_b"))


def hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, rid, n_words, template, at, n, whole, label, diagonal: the matches of all rolling pairs with template positions,
    and one row of template -1 for each document. Staged, so that rid, the row's number, stays."""
    split = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("rid"), words().alias("words"))
    rolled = split.select("doc_id", "rid", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "a"))
    rolled = rolled.withColumn("b", F.get("words", F.col("pos") + 1)).withColumn("gram", F.xxhash64("a", "b"))
    known = F.broadcast(template_frame(docs.sparkSession, phrases, templates))  # as many rows as the templates have words
    met = rolled.join(known, "gram").where((F.col("a") == F.col("t_a")) & F.col("b").eqNullSafe(F.col("t_b")))
    return c.stage(
        met.select(
            "doc_id", "rid", F.size("words").alias("n_words"), "template", "at", "n", "whole", "label",
            (F.col("pos") - F.col("at")).alias("diagonal"),
        ),
        "license-hits",
    )


def _spans(met: DataFrame, near: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Spans of phrases and of longer templates: rid, template, label, first_word, last_word, share."""
    met = met.where(F.col("template") >= 0)
    by_diagonal = met.where("whole").groupBy("rid", "template", "n", "label", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    exact = (
        by_diagonal.where(F.col("votes") == F.col("n"))
        .select(
            "rid", "template", "label", F.col("diagonal").cast("long").alias("first_word"),
            (F.col("diagonal") + F.col("n") + K - 2).cast("long").alias("last_word"), F.lit(1.0).alias("share"),
        )
    )
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > near, F.lit(True)).cast("int")
    voted = met.where(~F.col("whole")).groupBy(
        "rid", "template", "n", "label", "diagonal",
    ).agg(F.collect_set("at").alias("ats"))  # at most n positions
    runs = voted.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(line))
    place = runs.select("rid", "template", "n", "label", "passage", "diagonal", F.explode("ats").alias("at"))
    found = (
        place.groupBy("rid", "template", "n", "label", "passage")
        .agg(
            (F.count_distinct("at") / F.col("n")).alias("share"), F.min(F.col("diagonal") + F.col("at")).alias("a"),
            F.max(F.col("diagonal") + F.col("at")).alias("b"),
        )
    )
    found = found.where(F.col("share") >= min_share)
    return exact, found.select(
        "rid", "template", "label", F.col("a").cast("long").alias("first_word"), (F.col("b") + K - 1).cast("long").alias("last_word"), "share",
    )


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, near: int = NEAR, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, rid (of the row), template (text), label, first_word, last_word, share: every verified span."""
    met = hits(docs, phrases, templates)
    exact, part = _spans(met, near, min_share)
    names = F.array(*(F.lit(t) for t, _ in (*phrases, *templates)))
    ids = met.where("template < 0").select("doc_id", "rid")
    return (
        exact.unionByName(part).join(ids, "rid")
        .select("doc_id", "rid", F.get(names, F.col("template")).alias("template"), "label", "first_word", "last_word", "share")
    )


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, near: int = NEAR, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    met = hits(docs, phrases, templates)
    exact, part = _spans(met, near, min_share)
    places = (
        exact.groupBy("rid")
        .agg(
            F.count(F.lit(1)).alias("n_base"), F.min("first_word").alias("first_word"), F.max("first_word").alias("last_word"),
            F.collect_set("label").alias("base"),
        )
    )
    own = part.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    out = met.where("template < 0").select("doc_id", "rid", "n_words").join(places.join(own, "rid", "full"), "rid", "left")
    none = F.array().cast("array<string>")
    text = lambda x: F.array_join(F.array_sort(x), ",")
    base_set, own_set = F.coalesce("base", none), F.coalesce("own", none)
    n_base = F.coalesce("n_base", F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.col("n_words").cast("long"), n_base.alias("n_base"), "first_word", "last_word",
        text(base_set).alias("base_labels"), text(F.array_union(base_set, own_set)).alias("labels"),
        F.greatest(F.when(n_base > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("share", F.lit(0.0))).alias("score"),
    )
