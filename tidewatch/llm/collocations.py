"""Phrases whose words belong together, counted in counting quotient filters.

1. Words are counted per language. The id of a (language, word) is the leading bits of a hash; that no two of them share an id
   is checked on the counted vocabulary, else a longer id or another seed is taken. So ids need no table in the tasks.
2. Phrases of two words, then of three, are counted: a task packs the ids of each phrase into a key, and hands on one quotient
   filter per shard of the key space; the filters of a shard are merged in order. A phrase can only reach the least count
   if all its words, and both its pairs, do: a bit table of a fixed size holds what does, so most rare phrases are never
   handed on. Wrong answers of that table only cost time; the counts that matter are exact.
3. Scores, the suppression by longer phrases and the ranks are joins and windows over phrases that reach the least count.

A very frequent word or phrase is one entry of each filter, whatever its count; shards grow in number with the corpus, not in
size, and scrambled keys fill them evenly.

Arithmetic: counts are 64-bit, products decimals of 38 digits, exact while ``scale`` * a * a is below 10 ** 38 (a up to some 10 ** 16).

Defined cases: null text is empty, null languages are ``und`` and are one with that value; ids are never used, so null and repeated ids
and repeated rows just count each; texts without words give nothing; ties in score and count go by the phrase's bytes; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import quotient_filter
from tidewatch.llm.rows import stored
from tidewatch.llm.spans import LOWER, by_value, byte_set, mix, slices, strings, words

#: Words in a phrase, at most.
LONGEST = 3
#: Positions of the bit table that holds what is frequent (8 MB).
TABLE_BITS = 26
#: Phrases that a shard holds, at most, were they all different.
SHARD_PHRASES = 1 << 21
SLICE = 1 << 23
UNKNOWN = "und"

#: What ends a piece, and what parts words within one.
_ENDS = byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_BREAKS = _ENDS | byte_set((0x20, 0x20), (0x09, 0x09))


def word_runs(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of each slice of texts: its different words, the index of each word in turn, and whether it follows the word before it in one piece."""
    for _, _, data, offsets in slices(column, SLICE):
        data = LOWER[data]
        starts, ends, begin = words(data, offsets, _BREAKS)
        if not len(starts):
            continue
        found = strings(data, starts, ends).dictionary_encode()
        piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
        follows = np.zeros(len(starts), bool)
        follows[1:] = piece[1:] == piece[:-1]
        follows[begin[:-1][begin[:-1] < len(starts)]] = False
        yield found.dictionary, found.indices.to_numpy(), follows


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, part in by_value(batch, "lang"):
            held = []
            for known, at, _ in word_runs(part.column("text")):
                held.append(pa.table({"word": known, "n": np.bincount(at, minlength=len(known))}))
            if held:
                counted = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
                for piece in counted.to_batches():
                    columns = [pa.array([lang] * piece.num_rows, pa.string()), piece.column("word").cast(pa.string()), piece.column("n_sum")]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(str(seed)), F.col("lang"), F.col("word"))


def _hashes(seed: int, lang: str, known: pa.Array) -> np.ndarray:
    """The same number as ``_hash`` for one language's words: each column's hash seeds the next one's."""
    up = xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(str(seed), 42))
    return np.fromiter((xxhash.xxh64_intdigest(w, up) for w in known.to_pylist()), np.uint64, len(known))


def vocabulary(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """A stored table (lang, word, n, id), the bits of an id, and the seed. No two rows share an id."""
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    bits = min(64, max(16, 8 * -(-(2 * counted.count().bit_length() + 4) // 8)))
    seed = 0
    while True:
        named = counted.withColumn("id", F.shiftrightunsigned(_hash(seed), 64 - bits))
        if named.groupBy("id").count().where("count > 1").isEmpty():
            return named, bits, seed
        bits, seed = (bits + 8, seed) if bits < 64 else (bits, seed + 1)


def _places(key: list[np.ndarray]) -> np.ndarray:
    """Positions in the bit table."""
    out = mix(key[0] + np.uint64(len(key)))
    for part in key[1:]:
        out = mix(out ^ part)
    return (out >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def frequent_table(phrases: DataFrame, k: int) -> np.ndarray:
    """The bit table of the keys id1 .. idk; its size is fixed, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places([c.to_numpy().view(np.uint64) for c in batch.columns])
            slot = np.unique(at >> 6)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, np.searchsorted(slot, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    marked = phrases.select([f"id{j + 1}" for j in range(k)]).mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[marked.column("slot").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return out


def _listed(table: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
    at = _places(key)
    return (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _distinct(codes: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different tuples of codes below ``size``, and how often each occurs."""
    packed, width = codes[0].astype(np.int64), size
    heads = [None] * len(codes)
    for k, part in enumerate(codes[1:], 1):
        if width * size >= 1 << 62:  # too wide for one number: what is packed so far is numbered anew
            heads[k], packed = np.unique(packed, return_inverse=True)
            width = max(len(heads[k]), 1)
        packed, width = packed * size + part, width * size
    found, counts = np.unique(packed, return_counts=True)
    out = []
    for k in range(len(codes) - 1, 0, -1):
        out.append(found % size)
        found = found // size
        if heads[k] is not None:
            found = heads[k][found]
    return [found, *out[::-1]], counts


def phrase_counts(rows: DataFrame, k: int, table, bits: int, seed: int, n_words: int, least: int) -> DataFrame:
    """(id1 .. idk, a) of the phrases of k words with a count of ``least`` or more; ``table`` knows the frequent phrases of k - 1 words."""
    shards = max(-(-n_words // SHARD_PHRASES), 1)
    shard_bits = min((shards - 1).bit_length(), bits - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in by_value(batch, "lang"):
                for known, at, follows in word_runs(part.column("text")):
                    ids = _hashes(seed, lang, known) >> np.uint64(64 - bits)
                    if k == 2:
                        ok = _listed(table.value, [ids])[at]
                    else:
                        own = ids[at]
                        ok = np.zeros(len(at), bool)
                        ok[:-1] = follows[1:] & _listed(table.value, [own[:-1], own[1:]])
                    ok[:-1] &= ok[1:] & follows[1:]  # both parts of k - 1 words are frequent
                    where = np.flatnonzero(ok[:-1] if k == 2 else ok[:-2]) if len(at) >= k else np.zeros(0, np.int64)
                    if not len(where):
                        continue
                    codes, counts = _distinct([at[where + j] for j in range(k)], len(known))
                    key = quotient_filter.permuted([ids[c] for c in codes], bits)
                    order = quotient_filter.in_order(key)
                    key, counts = [x[order] for x in key], counts[order]
                    shard = (key[0] >> np.uint64(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(order), np.int64)
                    cuts = np.flatnonzero(np.diff(shard)) + 1
                    spans = list(zip([0, *cuts], [*cuts, len(shard)]))
                    data = [quotient_filter.packed([x[a:b] for x in key], counts[a:b], bits, shard_bits) for a, b in spans]
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array(data, pa.binary())], names=["shard", "filter"])

    names = [f"id{j + 1}" for j in range(k)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None

        def whole():
            key, counts = quotient_filter.merged(held, bits, shard_bits)
            often = counts >= least
            key = quotient_filter.permuted([x[often] for x in key], bits, back=True)
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in key), pa.array(counts[often])], names=[*names, "a"])

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != shard and held:
                    yield whole()
                    held = []
                shard = at
                held.append(data.as_py())
        if held:
            yield whole()

    filters = rows.mapInArrow(count, "shard int, filter binary")
    dealt = filters.repartition(1 << shard_bits, "shard") if shard_bits > 3 else filters.repartition("shard")
    return stored(dealt.sortWithinPartitions("shard").mapInArrow(merge, ", ".join(f"{n} long" for n in [*names, "a"])))


def _score(scale: int) -> Column:
    """floor(scale * a * a / (l * r)), exact."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    up = (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, scale: int = 1_000_000, text_col: str = "text", lang_col: str = "lang", salts: int = 16
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    known, bits, seed = vocabulary(rows)
    sizes = stored(known.groupBy("lang").agg(F.sum("n").alias("n")))
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    often = stored(known.where(F.col("n") >= least).select("id", "lang", "word", F.col("n").alias("f")))
    context = docs.sparkSession.sparkContext
    pairs = phrase_counts(rows, 2, context.broadcast(frequent_table(often.select(F.col("id").alias("id1")), 1)), bits, seed, n_words, least)
    triples = phrase_counts(rows, LONGEST, context.broadcast(frequent_table(pairs, 2)), bits, seed, n_words, least)

    one = lambda k, out: often.select(F.col("id").alias(f"id{k}"), F.col("f").alias(out))
    two = lambda j, k, out: pairs.select(F.col("id1").alias(f"id{j}"), F.col("id2").alias(f"id{k}"), F.col("a").alias(out))
    # A phrase goes if a longer one around it has its share of the count.
    inside = [triples.select(F.col(f"id{j}").alias("id1"), F.col(f"id{j + 1}").alias("id2"), F.col("a").alias("longer")) for j in (1, 2)]
    longest = inside[0].unionByName(inside[1]).groupBy("id1", "id2").agg(F.max("longer").alias("longer"))
    left = pairs.join(longest, ["id1", "id2"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share).drop("longer")
    short = left.join(one(1, "l"), "id1").join(one(2, "r"), "id2").withColumn("score", _score(scale))
    cut = lambda l, r: F.struct(_score(scale).alias("score"), F.lit(l).alias("k"), "l", "r")  # noqa: E731, E741
    long = triples.join(one(1, "l"), "id1").join(two(2, 3, "r"), ["id2", "id3"]).withColumn("x", cut(1, 2)).drop("l", "r")
    long = long.join(two(1, 2, "l"), ["id1", "id2"]).join(one(3, "r"), "id3").withColumn("y", cut(2, 1))
    long = long.withColumn("x", F.least("x", "y"))
    whole = short.select("id1", "id2", F.lit(None).cast("long").alias("id3"), "a", "l", "r", "score")
    whole = whole.unionByName(long.select("id1", "id2", "id3", "a", "x.l", "x.r", "x.score"))
    whole = whole.join(often.select(F.col("id").alias("id1"), "lang", F.col("word").alias("w1")), "id1")
    # Within each language, first by parts of it; ties with the last one are kept until the phrases are known.
    best = [F.desc("score"), F.desc("a")]
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("id1", "id2", "id3"), F.lit(salts)))
    near = salted.withColumn("p", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("p") <= top)
    near = stored(near.withColumn("p", F.rank().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("p") <= top).drop("salt", "p"))
    word = lambda k: often.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"))
    named = near.join(word(2), "id2").join(word(3), "id3", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
