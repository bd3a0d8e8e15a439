"""Exact phrase hits of many phrases: a dictionary of their rarest words meets the words of the texts.

A phrase that occurs in a text puts each of its words inside one token of the text: a
word with phrase characters on both sides is the whole token, one at the start of the
phrase ends it, one at the end starts it, and a phrase that is a single word lies
anywhere in it.  So each word of a phrase is a way to look it up in the vocabulary; the way
that meets the fewest documents is taken.  The tokens found make the dictionary, which the
distinct tokens of the texts are joined with, and only the texts met are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouch.functions.text import TOKEN, let, tokenize
from vouch.operators.bm25 import Index
from vouch.operators.exact import COPY_PREFIX, TOUCHED, has_variant
from vouch.session import SMALL_BYTES, SMALL_ROWS, file_bytes, materialize, small_rows
from vouch.sources.tables import keyed_join

_EDGE = r"[\p{L}\p{N}]"

# a word that is part of more tokens than this says little: its phrases are compared with each text
MOST_TERMS = 1_000

# characters of a word that are looked up; the rest is compared afterwards
_LOOKED_UP = {"head": 4, "tail": 4, "inside": 4}


def _words(variant: Column) -> Column:
    """The words of a phrase with the way each is found: whole, tail, head or inside."""
    words = F.regexp_extract_all(variant, F.lit(TOKEN), 1)
    count = F.size(words)
    opens, closes = variant.rlike(f"^{_EDGE}"), variant.rlike(f"{_EDGE}$")

    def word(text: Column, i: Column) -> Column:
        first, last = (i == 0) & opens, (i == count - 1) & closes
        how = (
            F.when(first & last, "inside").when(first, "tail").when(last, "head").otherwise("whole")
        )
        return F.struct(how.alias("how"), text.alias("word"))

    return F.transform(words, word)


def _piece(how: Column, word: Column) -> Column:
    """The part of a word that is matched by equality."""
    return (
        F.when(how == "tail", F.right(word, F.lit(_LOOKED_UP["tail"])))
        .when(how == "head", F.substring(word, 1, _LOOKED_UP["head"]))
        .when(how == "inside", F.substring(word, 1, _LOOKED_UP["inside"]))
        .otherwise(word)
    )


def ways(queries: DataFrame) -> DataFrame:
    """``variant, how, word``: every word by which each distinct phrase could be looked up; nulls where it has none."""
    variants = queries.select(F.explode("variants").alias("variant")).distinct()
    return variants.select("variant", F.explode_outer(_words(F.col("variant"))).alias("way")).select("variant", "way.*")


def _part(how: str, piece: Column) -> Column:
    return F.struct(F.lit(how).alias("how"), piece.alias("piece"))


def _inside(term: Column, size: int) -> Column:
    last = F.length(term) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: _part("inside", F.substring(term, i, F.lit(size))))
    return F.array_distinct(pieces)


def _pieces(term: Column, sizes: dict[str, list[int]]) -> Column:
    """The parts of a token that an anchor of the given kinds and sizes could equal."""
    size_of = F.length(term)
    heads = [F.when(size_of >= n, _part("head", F.substring(term, 1, n))) for n in sizes.get("head", [])]
    tails = [F.when(size_of >= n, _part("tail", F.right(term, F.lit(n)))) for n in sizes.get("tail", [])]
    inside = [_inside(term, size) for size in sizes.get("inside", [])]
    return F.concat(F.array_compact(F.array(_part("whole", term), *heads, *tails)), *inside)


def dictionary(terms: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, variant``, written: the tokens of which a text that holds the phrase has one; and phrases without such tokens.

    ``terms(term, df)`` is the vocabulary.  Of the words of a phrase the one whose tokens are in the
    fewest documents counts.  A phrase with a word that fits no token occurs nowhere and is left out.  A phrase
    without words, or whose word fits over ``MOST_TERMS`` tokens, is in the second table (``variant``) instead, so that the
    first one follows the phrases and not the vocabulary.
    """
    how, word = F.col("how"), F.col("word")
    looked_up = materialize(
        options.filter(word.isNotNull()).select("how", "word").distinct().withColumn("piece", _piece(how, word)), "lookups"
    )
    # a handful of kinds and lengths, whatever the number of phrases
    lengths = looked_up.groupBy("how").agg(F.collect_set(F.length("piece")).alias("sizes"))
    sizes = {row["how"]: sorted(row["sizes"]) for row in lengths.collect()}
    term = F.col("term")
    fits = (
        F.when(how == "head", term.startswith(word))
        .when(how == "tail", term.endswith(word))
        .when(how == "inside", F.contains(term, word))
        .otherwise(F.lit(True))
    )
    parts = terms.select("term", "df", F.inline(_pieces(term, sizes)))
    small = file_bytes(looked_up) <= SMALL_BYTES
    met = parts.join(F.broadcast(looked_up) if small else looked_up, ["how", "piece"]).filter(fits)
    # a token has each part once, and each word one part
    met = materialize(met.select("how", "word", "term", "df"), "met")
    weight = met.groupBy("how", "word").agg(F.sum("df").alias("documents"), F.count("*").alias("terms"))
    way = F.struct(F.coalesce("documents", F.lit(0)).alias("documents"), (-F.length("word")).alias("size"), how, word, F.col("terms"))
    rarest = materialize(
        options.filter(word.isNotNull())
        .join(weight, ["how", "word"], "left")
        .groupBy("variant")
        .agg(F.min(way).alias("way"))
        .select("variant", "way.how", "way.word", "way.terms"),
        "rarest",
    )
    broad = rarest.filter(F.col("terms") > MOST_TERMS).select("variant")
    few = rarest.filter(F.col("terms") <= MOST_TERMS).select("variant", "how", "word")
    looked = materialize(few.join(met, ["how", "word"]).select("term", "variant").distinct(), "dictionary")
    return looked, materialize(options.filter(word.isNull()).select("variant").unionByName(broad), "broad")


def _met(tokens: DataFrame, words: DataFrame, salts: int = 32) -> DataFrame:
    """``doc_id, variants`` of the documents whose ``tokens(doc_id, term)`` meet the dictionary.

    A small dictionary is broadcast.  A larger one is joined by shuffle, each word cut into ``salts`` parts so
    that no task gets all the documents of a frequent one.
    """
    if file_bytes(words) <= SMALL_BYTES:
        rows = small_rows(words.select("term").distinct(), 1000)
        if rows is not None:  # listed in the scan filter, so that an index reads only their pages
            tokens = tokens.filter(F.col("term").isin([row["term"] for row in rows]))
        met = tokens.join(F.broadcast(words), "term")
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
        every = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = tokens.withColumn("salt", salt).join(every, ["term", "salt"])
    return met.groupBy("doc_id").agg(F.collect_set("variant").alias("variants"))


def _confirmed(maybe: DataFrame, reviews: DataFrame, queries: DataFrame, broad: DataFrame) -> DataFrame:
    """Touched reviews: those of ``maybe(doc_id, variants)`` that hold a phrase, and those with a phrase of ``broad(variant)``."""
    texts = reviews.select(
        *[c for c in ("shard", "review_id", "place_id", "place_name", "text") if c in reviews.columns]
    )
    columns = ["review_id", "place_id", "place_name", F.substring("text", 1, COPY_PREFIX).alias("copy_key")]
    holds = lambda phrases: let(
        F.lower("text"), lambda low: F.filter(phrases, lambda v: has_variant(low, v))
    )
    found, maybe = None, maybe.withColumnRenamed("doc_id", "review_id")
    # a phrase without letters or digits has no word to look up, that of a few characters no use of it
    blocks = -(-broad.count() // (SMALL_ROWS // 2))  # each a constant of bounded length in the tasks of a scan
    for number in range(blocks):
        signs = broad.filter(F.pmod(F.xxhash64("variant"), F.lit(blocks)) == number).agg(F.collect_list("variant")).scalar()
        if number:
            scanned = texts.withColumn("variants", signs)
        else:  # along with the phrases looked up, so that the rows of a review stay together
            looked = F.coalesce("variants", F.array().cast("array<string>"))
            scanned = texts.join(maybe, "review_id", "left").withColumn("variants", F.concat(looked, signs))
        part = scanned.select(*columns, F.explode(holds(F.col("variants"))).alias("variant"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = keyed_join(maybe, texts, "review_id").select(*columns, F.explode(holds(F.col("variants"))).alias("variant"))
    asked = queries.select("qid", F.explode("variants").alias("variant"))
    return (
        found.join(asked, "variant")
        .groupBy("qid", "review_id")
        .agg(
            F.first("place_id").alias("place_id"),
            F.first("place_name").alias("place_name"),
            F.first("copy_key").alias("copy_key"),
            F.array_sort(F.collect_list("variant")).alias("found"),
        )
        .withColumn("score", F.lit(None).cast("double"))
        .select(*TOUCHED)
    )


def touched_by_index(index: Index, reviews: DataFrame, queries: DataFrame) -> DataFrame:
    """What ``touched_reviews`` finds by scanning, without text hits, through the postings of a saved index of these reviews."""
    if index.stop or index.vocab is not None:
        raise ValueError("phrases need an index of all words as written")
    options = materialize(ways(queries), "ways")
    words, broad = dictionary(index.terms, options)
    tokens = index.postings.filter(F.col("term") != "").select("doc_id", "term")
    return _confirmed(_met(tokens, words), reviews, queries, broad)


def touched_by_words(reviews: DataFrame, queries: DataFrame) -> DataFrame:
    """The same without an index: the distinct tokens of each text are written once, for the vocabulary and the join."""
    options = materialize(ways(queries), "ways")
    held = reviews.select(
        F.col("review_id").alias("doc_id"), F.array_distinct(tokenize(F.col("text"))).alias("tokens")
    )
    tokens = materialize(held, "tokens").select("doc_id", F.explode("tokens").alias("term"))
    words, broad = dictionary(tokens.groupBy("term").agg(F.count("*").alias("df")), options)
    return _confirmed(_met(tokens, words), reviews, queries, broad)
