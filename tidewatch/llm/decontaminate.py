"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``window`` consecutive words, ``window - gram + 1`` word grams are hashed and the least
hash is the window's fingerprint. Equal windows have equal fingerprints, so joining the
fingerprints of documents and benchmark items misses no shared run of ``window`` words or more.
Documents with hits are then compared window by window, as words, which extends each hit to
all the windows that really occur.

An item of fewer words, but not none, is one window of its own length; the
lengths that occur (at most ``window - 1`` numbers) get fingerprints of their own.

Defined cases: null text has no words and is never contaminated; a document row is known
by its id and a hash of its text, so null and repeated ids are kept apart and repeated rows get
equal results; a null item id counts for hits and is not listed; an empty benchmark hits nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.columns import ahead, first_of, let, lowered, raw_words
from tidewatch.llm.rows import sized, stored


def _hashed(rows: DataFrame, text: Column, gram: int, window: int, short: list[int]) -> DataFrame:
    """``rows`` with n_words and ``prints``, the distinct fingerprints, of ``text``."""
    hashes = F.transform(raw_words(text), lambda w: F.xxhash64(lowered(w)))

    def grams(words: Column, length: int, *first: Column) -> Column:
        return F.transform(first_of(words, F.size(words) - (length - 1)), lambda w, i: F.xxhash64(*first, w, *ahead(words, i, length - 1)))

    def least(hashed: Column) -> Column:
        span = window - gram
        return F.transform(first_of(hashed, F.size(hashed) - span), lambda g, i: F.least(g, *ahead(hashed, i, span)) if span else g)

    def prints(words: Column) -> Column:
        parts = [let(grams(words, gram), least), *(grams(words, k, F.lit(k)) for k in short)]
        return F.struct(F.size(words).cast("long").alias("n_words"), F.array_distinct(F.concat(*parts) if short else parts[0]).alias("prints"))

    return rows.withColumn("hashed", let(hashes, prints)).select("*", "hashed.*").drop("hashed")


def _windows(words: Column, lengths: list[int]) -> Column:
    """All runs of so many words, each with its first place."""
    def of(length: int) -> Column:
        return F.transform(
            first_of(words, F.size(words) - (length - 1)),
            lambda w, i: F.struct(
                i.alias("start"), F.lit(length).alias("length"), F.concat_ws(" ", F.slice(words, i + 1, F.lit(length))).alias("run")
            ),
        )

    return F.concat(*map(of, lengths)) if len(lengths) > 1 else of(lengths[0])


def contamination(
    docs: DataFrame, benchmark: DataFrame, gram: int = 7, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) of every document; ``items`` are the sorted ids of the items that occur."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item_id"), F.transform(raw_words(F.col(f"`{item_text_col}`")), lowered).alias("words")
    ).where(F.size("words") > 0)
    items = stored(items.withColumn("length", F.least(F.size("words"), F.lit(window))))
    short = sorted(r["length"] for r in items.where(F.col("length") < window).select("length").distinct().collect())

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    prints = stored(_hashed(rows, F.col("text"), gram, window, short).drop("text"))

    # Items have fingerprints by the same rule; those of fewer words only that of their own length.
    item_text = F.concat_ws(" ", "words")
    long_prints = _hashed(items.where(F.col("length") == window).select(item_text.alias("t")), F.col("t"), gram, window, []).select("prints")
    sides = [long_prints]
    for k in short:
        sides.append(items.where(F.col("length") == k).select(F.array(F.xxhash64(F.lit(k), *[F.xxhash64(F.col("words")[j]) for j in range(k)])).alias("prints")))
    all_prints = sides[0]
    for side in sides[1:]:
        all_prints = all_prints.unionByName(side)
    item_prints = stored(all_prints.select(F.explode("prints").alias("print")).distinct())
    key = ["doc_id", "text_hash"]
    hit = stored(
        prints.select(*key, F.explode("prints").alias("print")).join(sized(item_prints), "print", "left_semi").select(*key).distinct()
    )

    lengths = sorted({*short, window})
    runs = stored(
        items.select("item_id", F.explode(_windows(F.col("words"), lengths)).alias("w"), F.col("length").alias("own"))
        .where("w.length = own").select("item_id", F.col("w.run").alias("run")).distinct()
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    small = sized(hit)
    found = rows.join(small, same(rows, small), "left_semi").dropDuplicates(key)
    all_windows = let(F.transform(raw_words(F.col("text")), lowered), lambda words: _windows(words, lengths))
    found = found.select(*key, F.explode(all_windows).alias("w")).select(*key, "w.*")
    found = stored(found.join(sized(runs.select("run").distinct()), "run", "left_semi"))

    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    # Places in order; each adds what lies behind the furthest end so far.
    covered = F.aggregate(
        ends,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    n_hit = found.groupBy(*key).agg(covered.alias("n_hit"))
    named = found.select(*key, "run").distinct().join(sized(runs), "run").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    results = stored(n_hit.join(named, n_hit["doc_id"].eqNullSafe(named["doc_id"]) & (n_hit["text_hash"] == named["text_hash"]))
                     .select(n_hit["doc_id"], n_hit["text_hash"], "n_hit", "items"))
    counts, results = prints.select(*key, "n_words"), sized(results)
    return counts.join(results, same(counts, results), "left").select(
        counts["doc_id"], counts["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit: Column, n_words: Column, share: float = 0.05) -> Column:
    """Hit words make up at least ``share`` of a document's words."""
    return (n_hit > 0) & (n_hit * round(1 / share) >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, benchmark, **options)
    bad = stored(bad.where(contaminated(F.col("n_hit"), F.col("n_words"), share)).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    return docs.join(
        sized(bad),
        docs[f"`{id_col}`"].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("_bad_hash")),
        "left_anti",
    )
