"""Licence scans: a positional index of the rare words of licence notices, met by the rare words of each text."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouch.functions.text import let
from vouch.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text whose A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE = 6  # words of a notice with the highest IDF that are looked up
SHARE = 0.75  # of their IDF that must stand at one relative position

# Phrases that name a licence wherever they stand.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Label, words of a common notice, and the key phrase in it that must stand in the text whole.
NOTICES = [
    ("agpl-3", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance",
        "apache license version 2 0",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that",
        "redistribution and use in source and binary forms",
    ),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    (
        "cc-by-nc",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
        "creative commons attribution noncommercial",
    ),
    (
        "cc-by-sa",
        "licensed under a creative commons attribution sharealike 4 0 international license",
        "creative commons attribution sharealike",
    ),
    ("cc0", "to the extent possible under law waived all copyright and related or neighboring rights", "waived all copyright"),
    ("gpl", "under the terms of the gnu general public license as published by the free software", "gnu general public license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        "permission to use copy modify and or distribute",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated",
        "permission is hereby granted free of charge",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
]


@dataclass(frozen=True)
class Phrase:
    """Words that are verified around their rarest one, ``anchor``, which is word number ``at``."""

    words: str
    anchor: str
    at: int

    @classmethod
    def of(cls, words: str, rank: dict[str, int]) -> Phrase:
        split = words.split()
        anchor = min(split, key=rank.__getitem__)
        return cls(words, anchor, split.index(anchor))


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), 0)


def licence_idf(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[tuple[str, float]]:
    """The words of ``vocabulary`` by falling IDF over all of ``docs``, ties by word.

    ``ln((rows + 1) / (rows with the word + 1))``; as many values as the notices have words, whatever the data.
    """
    held = F.array_distinct(F.filter(_words(docs[text_col]), lambda w: w.isin(vocabulary)))
    # a row more for each text counts the texts
    counts = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    df = {row["word"]: row["count"] for row in counts.collect()}
    idf = [(word, math.log((df.get("", 0) + 1) / (df.get(word, 0) + 1))) for word in vocabulary]
    return sorted(idf, key=lambda r: (df.get(r[0], 0), r[0]))


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of literals."""
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    return spark.range(1).select(F.inline(F.array(*[row(values) for values in rows])))


def _hits(words: Column, rare: list[str]) -> Column:
    """``at, word`` of the rare words in a text."""
    found = F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word"))))
    return F.filter(found, lambda h: h.isNotNull())


def _places(words: Column, hits: Column, phrases: list[Phrase]) -> Column:
    """``phrase, start`` of every place of every phrase, found at its anchor and compared word by word."""

    def of(number: int, p: Phrase) -> Column:
        start = lambda h: h["at"] - p.at
        same = lambda h: F.array_join(
            F.slice(words, F.greatest(start(h), F.lit(0)) + 1, len(p.words.split())), " "
        )
        there = F.filter(hits, lambda h: (h["word"] == p.anchor) & (start(h) >= 0) & (same(h) == p.words))
        return F.transform(there, lambda h: F.struct(F.lit(number).alias("phrase"), start(h).alias("start")))

    return F.concat(*[of(number, p) for number, p in enumerate(phrases)])


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str, str]] = NOTICES,
    rare: int = RARE,
    share: float = SHARE,
) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``, one row per row of ``docs``.

    A phrase gives its label wherever its words stand consecutively: ``n_base`` places, the first and last start
    in ``first_word`` and ``last_word`` (null without any).  A notice gives its label if, with the notice laid on the text at one
    place, words with ``share`` of the IDF of its ``rare`` rarest words meet, and its key phrase stands there whole.
    ``score`` is 1 with a phrase, else the largest share met by a notice, 0 without any.  Labels are distinct,
    sorted and joined by commas.

    Null and empty texts, and those without words, have no labels; rows without id and repeated rows are each judged
    for themselves.  Other columns are ignored.  An empty table gives no rows.

    The corpus is read twice: for the IDF of the notices' words, and for the places of the rare ones in each text.
    Only these places meet the postings of the notices (a table of fixed size), grouped by text, notice and relative position.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for words, _ in phrases for w in words.split()} | {w for n in notices for w in n[1].split()})
    idf = licence_idf(docs, text_col, vocabulary)
    rank, weight = {w: i for i, (w, _) in enumerate(idf)}, dict(idf)
    places = [Phrase.of(words, rank) for words, _ in phrases] + [Phrase.of(key, rank) for _, _, key in notices]
    chosen = [sorted(set(words.split()), key=rank.__getitem__)[:rare] for _, words, _ in notices]
    wanted = sorted({w for some in chosen for w in some} | {p.anchor for p in places})

    seen = let(
        _words(F.col("text")),
        lambda words: let(
            _hits(words, wanted),
            lambda hits: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                hits.alias("hits"),
                _places(words, hits, places).alias("places"),
            ),
        ),
    )
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    scanned = materialize(
        own.select("id", seen.alias("seen")).select(F.monotonically_increasing_id().alias("row"), "id", "seen.*"), "scan"
    )

    # the positional index: word, notice, its place there, its IDF
    postings = [
        (w, number, at, weight[w])
        for number, (_, words, _) in enumerate(notices)
        for at, w in enumerate(words.split())
        if w in chosen[number]
    ]
    index = _small(spark, postings, ["word", "notice", "place", "idf"])
    total = [sum(p[3] for p in postings if p[1] == number) for number in range(len(notices))]
    rules = _small(
        spark,
        [
            (number, label, max(total[number], 1e-9), len(phrases) + number, f" {words} ".split(f" {key} ")[0].count(" "))
            for number, (label, words, key) in enumerate(notices)
        ],
        ["notice", "label", "total", "phrase", "key_at"],
    )
    laid = (
        scanned.select("row", F.inline("hits"))
        .join(F.broadcast(index), "word")
        .groupBy("row", "notice", (F.col("at") - F.col("place")).alias("offset"))
        .agg(F.sum("idf").alias("met"))
        .join(F.broadcast(rules), "notice")
        .withColumn("met", F.round(F.col("met") / F.col("total"), 6))
        .where(F.col("met") >= share)
    )
    keys = scanned.select(F.col("row").alias("r"), F.inline("places"))
    sure = laid.join(
        keys,
        (F.col("row") == F.col("r"))
        & (laid["phrase"] == keys["phrase"])
        & (F.col("offset") + F.col("key_at") == F.col("start")),
    )
    judged = sure.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("met").alias("best"))

    base = F.filter("places", lambda p: p["phrase"] < len(phrases))
    starts = F.transform("base", lambda p: p["start"].cast("bigint"))
    label_of = F.array(*[F.lit(label) for _, label in phrases])
    labels = F.sort_array(F.array_distinct(F.transform("base", lambda p: F.get(label_of, p["phrase"]))))
    all_labels = F.sort_array(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0))))
    return (
        scanned.select("row", "id", "n_words", base.alias("base"))
        .join(judged, "row", "left")
        .select("id", "n_words", "base", starts.alias("starts"), labels.alias("base_list"), "more", "best")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.size("base").cast("bigint").alias("n_base"),
            F.array_min("starts").alias("first_word"),
            F.array_max("starts").alias("last_word"),
            F.array_join("base_list", ",").alias("base_labels"),
            F.array_join(all_labels, ",").alias("labels"),
            score.alias("score"),
        )
    )
