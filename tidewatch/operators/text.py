"""Overlap of word n-grams between texts, and integrity of referenced keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

SIZES = (6, 7, 8, 10)
_WORD = "[a-z]+"


def words(text: Column | str) -> Column:
    """Lower-case runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def distinct_ngrams(word_list: str, n: int) -> Column:
    """The distinct n-grams of one text, as strings."""
    count = F.size(word_list) - (n - 1)
    grams = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(word_list, i, n), " ")
    )
    return F.when(count >= 1, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def with_ngrams(texts: DataFrame, key: str, text: str, sizes: Sequence[int] = SIZES) -> DataFrame:
    """``(key, n, grams)``: one row per text and size, computed inside the row."""
    worded = texts.select(key, words(text).alias("_words"))
    rows = F.array(*[F.struct(F.lit(n).alias("n"), distinct_ngrams("_words", n).alias("grams")) for n in sizes])
    return worded.select(key, F.inline(rows))


def heads(word_list: Column | str, n: int) -> Column:
    """A hash of the ``n`` words that start at each place; every word is hashed once."""

    def runs(hashes: Column) -> Column:
        starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, n)]))

    # An array of one element, so that the words' hashes are computed once and not for each place.
    return F.get(F.transform(F.array(F.transform(word_list, lambda w: F.xxhash64(w))), runs), F.lit(0))


def _held(
    texts: DataFrame, key: str, text: str, known: DataFrame, sizes: Sequence[int], salts: int, most_known: int
) -> DataFrame:
    """``(key, _row, n, gram, _total, _hit)``: the distinct n-grams of each text that may be among ``known``, marked if they are.

    A place is looked up by the hash of its first words, as many as the smallest size has; only places that
    some known n-gram may start at, and one more row per text for its totals, become strings and meet ``known``.
    A text in which no hash comes twice has as many distinct n-grams as places; only the others are listed to be counted.
    ``known`` must be stored and hold, with an n-gram, its first words as one of the smallest size.
    """
    least, most = min(sizes), max(sizes)
    worded = texts.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    looked = worded.select(key, "_words", heads("_words", least).alias("_heads"))
    again = F.size(F.array_distinct("_heads")) < F.size("_heads")
    totals = [
        F.when(again, F.size(distinct_ngrams("_words", n))).otherwise(F.greatest(F.size("_words") - (n - 1), F.lit(0)))
        for n in sizes
    ]
    salt = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt")
    places = looked.select(
        key, F.monotonically_increasing_id().alias("_row"), salt, "_words", F.array(*totals).alias("_totals"), "_heads"
    ).select(key, "_row", "_salt", "_words", "_totals", F.posexplode_outer("_heads").alias("_place", "_head"))
    starts = known.where(F.col("n") == least).select(heads(F.split("gram", " "), least)[0].alias("_head")).distinct()
    few = known.count() <= most_known

    def marked(rows: DataFrame, wanted: DataFrame, on: list[str], mark: str) -> DataFrame:
        wanted = wanted.withColumn(mark, F.lit(1))
        if few:
            return rows.join(F.broadcast(wanted), on, "left")
        repeated = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return rows.join(repeated.hint("merge"), [*on, "_salt"], "left")

    first = F.coalesce(F.col("_place"), F.lit(0)) == 0
    near = marked(places, starts, ["_head"], "_near").where(F.col("_near").isNotNull() | first)
    near = near.select(
        key, "_row", "_salt", F.when(first, F.col("_totals")).alias("_totals"),
        F.when(F.col("_near").isNotNull(), F.slice("_words", F.col("_place") + 1, F.lit(most))).alias("_run"),
    )
    each = [
        F.struct(
            F.lit(n).alias("n"),
            F.when(F.size("_run") >= n, F.array_join(F.slice("_run", 1, n), " ")).alias("gram"),
            F.get("_totals", F.lit(k)).alias("_total"),
        )
        for k, n in enumerate(sizes)
    ]
    grams = near.select(key, "_row", "_salt", F.inline(F.array(*each))).where("gram IS NOT NULL OR _total IS NOT NULL")
    return marked(grams, known, ["n", "gram"], "_hit").groupBy(key, "_row", "n", "gram").agg(
        F.max("_total").alias("_total"), F.max("_hit").alias("_hit")
    )


def ngram_overlap(
    texts: DataFrame,
    key: str,
    text: str,
    sources: DataFrame,
    source_key: str,
    source_text: str,
    sizes: Sequence[int] = SIZES,
    salts: int = 8,
    most_known: int = 500_000,
) -> DataFrame:
    """Per text and size: distinct n-grams, those also in any source, and their share in percent.

    Distinct n-grams of a text are counted in its row.  Those of the sources are written and
    counted: up to ``most_known`` are broadcast, and nothing but hits and counts per text moves.
    Beyond that the joins shuffle, salted by text, because boilerplate shared by a large
    part of the texts would otherwise send them all to one task; the sources' n-grams are
    repeated once per salt.
    """
    known = with_ngrams(sources, source_key, source_text, sizes).select("n", F.explode("grams").alias("gram")).distinct()
    return (
        _held(texts, key, text, cut_lineage(known), sizes, salts, most_known).groupBy(key, "n")
        .agg(F.max("_total").alias("n_grams"), F.count("_hit").alias("n_shared"))
        .withColumn("share_pct", F.col("n_shared") * 100.0 / F.greatest(F.col("n_grams"), F.lit(1)))
    )


def shared_ngrams(
    texts: DataFrame,
    key: str,
    text: str,
    sources: DataFrame,
    source_key: str,
    source_text: str,
    n: int = 7,
    salts: int = 8,
    most_known: int = 500_000,
) -> DataFrame:
    """Every n-gram a source shares with any text, with the number of texts that hold it.

    Texts' n-grams are held against the sources' first: up to ``most_known`` of these are broadcast, beyond that the join
    is salted by text. Only what both sides hold is counted, per task first, so the counts' shuffle grows with the hits and no (text, source)
    pairs arise. Counts are repeated per salt and sources spread over the salts, so an n-gram in a large part
    of the sources is not one task.
    """
    wanted = with_ngrams(sources, source_key, source_text, [n]).select(source_key, "n", F.explode("grams").alias("gram"))
    known = cut_lineage(wanted.select("n", "gram").distinct())
    held = _held(texts, key, text, known, [n], salts, most_known).where("_hit = 1")
    shared = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"))
    repeated = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(source_key), F.lit(salts)).cast("int")
    return wanted.withColumn("_salt", salt).join(repeated, ["gram", "_salt"]).select(source_key, "gram", "n_texts")


def key_integrity(
    mentions: DataFrame, order: str, text: str, pattern: str, records: DataFrame, record_key: str
) -> DataFrame:
    """Keys mentioned in texts against keys on record.

    ``(key, first_seen, mentions, status)``; ``first_seen`` orders keys by first
    appearance.  Mentions are counted per key before the join, so a key mentioned
    everywhere is one row in it.
    """
    found = mentions.select(
        F.col(order).alias("_order"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("key")
    )
    used = found.groupBy("key").agg(F.min("_order").alias("first_seen"), F.count(F.lit(1)).alias("mentions"))
    known = records.select(F.col(record_key).cast("string").alias("key"), F.lit(True).alias("_known")).distinct()
    status = (
        F.when(F.col("_known").isNull(), "no_record").when(F.col("mentions").isNull(), "never_used").otherwise("matched")
    )
    return used.join(known, "key", "full_outer").select(
        "key", "first_seen", F.coalesce("mentions", F.lit(0).cast("bigint")).alias("mentions"), status.alias("status")
    )
