"""Language by prediction by partial matching: code lengths under one frozen byte context tree per language.

Each language has a tree of contexts of up to ``order`` bytes. A byte is coded in the longest known context that the
text so far ends with; where that has never seen the byte, an escape is paid and the next shorter context is asked, without
the bytes that the longer one knew; the last resort is an even choice among the bytes that were never seen. Escape
probabilities are those of method C: distinct followers / (occurrences + distinct followers). Statistics stay as they
were learned, so a byte's code length depends on its context alone: all languages share one automaton whose states are the
contexts, texts are read in pieces of equal length side by side, and each (state, byte) is priced once. Prices
are whole 65536ths of a bit, so sums are exact whatever their order. The shortest code wins.

What is coded: A-Z in lower case, and each run of other ASCII characters as one space; every text starts after a space.

Defined cases: a text that is null or has no letter (a character of Unicode's class L) is ``und`` with score 0, and so is
every text if nothing can be learned; ties go to the least name; rows without a language, held-out rows and texts without letters are
not learned from; equal texts of one language are learned once; null and repeated ids give one row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.rows import held_out, stored
from tidewatch.llm.spans import LOWER, by_value, slices

#: Longest context in bytes. A context below ``SEEN`` occurrences in a language is no node of its tree.
ORDER, SEEN = 4, 2
#: What is learned from: so many different texts of a language at most, and so many bytes of all languages together, shared evenly.
SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 1 << 21
#: Texts are read in pieces of so many bytes side by side.
PIECE = 64
#: A price unit is this part of a bit.
UNIT = 1 << 16
UNDECIDED = "und"

_SPACE = 0x20
_FORM = LOWER.copy()
_FORM[[b for b in range(128) if not chr(b).isalpha()]] = _SPACE
#: Symbols that the form has: the space, a-z, and every byte beyond ASCII.
SYMBOLS = len(np.unique(_FORM))


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded form of texts that lie one after another, and its offsets."""
    form = _FORM[data]
    space = form == _SPACE
    again = space.copy()
    again[1:] &= space[:-1]
    border = offsets[:-1][offsets[:-1] < len(data)]
    again[border] = space[border]  # a text starts after a space
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~again, out=kept[1:])
    return form[~again], kept[offsets]


def _keys(data: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` bytes as numbers, with the length above them."""
    if len(data) < size:
        return np.zeros(0, np.int64)
    n = len(data) - size + 1
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = key << 8 | data[k : k + n]
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    return (key | size << 48)[owner[:n] == owner[size - 1 :]]


def grams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one to ``order`` + 1 bytes of the coded texts, each with a space before it, and their counts."""
    found = []
    for _, _, data, offsets in slices(column):
        data, offsets = coded(data, offsets)
        led = np.insert(data, offsets[:-1], _SPACE)
        found += [_keys(led, offsets + np.arange(len(offsets)), size) for size in range(1, order + 2)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Trees:
    """All languages' trees over one automaton; arrays of one line per language."""

    languages: list[str]
    step: np.ndarray  # state x class of byte -> state
    kind: np.ndarray  # byte -> class; 0 for bytes that were never seen
    state_key: np.ndarray  # sorted: a state's context as a number; state 0 is the empty one
    suffix: np.ndarray  # state -> state of the context without its first byte
    grams: list[np.ndarray]  # per language, sorted runs
    counts: list[np.ndarray]
    total: np.ndarray  # language x state -> occurrences of the context with a follower, 0 if it is no node
    kinds: np.ndarray  # ... its distinct followers
    left_total: np.ndarray  # ... the same two numbers of its suffix without the followers it has itself
    left_kinds: np.ndarray


def _value(key: np.ndarray) -> np.ndarray:
    return key & ((1 << 48) - 1)


def _shorter(key: np.ndarray) -> np.ndarray:
    """Without the first byte."""
    size = key >> 48
    return np.where(size > 0, (size - 1) << 48 | _value(key) & ((1 << 8 * np.maximum(size - 1, 0)) - 1), 0)


def _longer(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return ((key >> 48) + 1) << 48 | _value(key) << 8 | byte


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def grow(samples: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, seen: int = SEEN) -> Trees:
    """Trees from (sorted runs, counts) of each language."""
    languages = sorted(samples)
    per = []
    for name in languages:
        runs, counts = samples[name]
        context = (runs >> 48) - 1 << 48 | _value(runs) >> 8  # without the last byte
        context = np.where(runs >> 48 == 1, 0, context)
        nodes, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, counts, len(nodes)).astype(np.int64)
        kept = (total >= seen) | (nodes == 0)
        # a node's suffix is a node too: it occurs at least as often
        per.append((runs[kept[at]], counts[kept[at]].astype(np.int64), nodes[kept], total[kept], np.bincount(at, minlength=len(nodes))[kept]))
    state_key = np.unique(np.concatenate([np.zeros(1, np.int64), *(x[2] for x in per)]))
    n = len(state_key)
    suffix = _find(state_key, _shorter(state_key))[0]
    total, kinds, left_total, left_kinds = (np.zeros((len(languages), n), np.int64) for _ in range(4))
    for k, (runs, counts, nodes, sums, distinct) in enumerate(per):
        at = np.searchsorted(state_key, nodes)
        total[k, at], kinds[k, at] = sums, distinct
        # how often the suffix has the followers that the longer context knows
        context = np.searchsorted(state_key, np.where(runs >> 48 == 1, 0, (runs >> 48) - 1 << 48 | _value(runs) >> 8))
        own = np.flatnonzero(runs >> 48 > 1)
        below, there = _find(runs, _shorter(runs[own]))
        shared = np.bincount(context[own], np.where(there, counts[below], 0), n).astype(np.int64)
        left_total[k] = np.where(kinds[k] > 0, total[k, suffix] - shared, 0)
        left_kinds[k] = np.where(kinds[k] > 0, kinds[k, suffix] - kinds[k], 0)
    symbols = np.unique(np.concatenate([x[0] & 255 for x in per]))
    kind = np.zeros(256, np.int32)
    kind[symbols] = np.arange(1, len(symbols) + 1)
    step = np.zeros((n, len(symbols) + 1), np.int32)
    # States are sorted by length, so the step of a suffix is known before that of the state.
    for size in range(int(state_key[-1] >> 48) + 1):
        level = np.flatnonzero(state_key >> 48 == size)
        if size:
            step[level] = step[suffix[level]]
        if size < order:
            for symbol in symbols:
                at, there = _find(state_key, _longer(state_key[level], symbol))
                step[level[there], kind[symbol]] = at[there]
    return Trees(languages, step, kind, state_key, suffix, [x[0] for x in per], [x[1] for x in per], total, kinds, left_total, left_kinds)


def prices(trees: Trees, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """languages x pairs: the code length of each byte after each state, in units."""
    out = np.zeros((len(trees.languages), len(state)), np.int64)
    cost = lambda x: np.rint(-np.log2(x) * UNIT).astype(np.int64)
    for k in range(len(trees.languages)):
        at, of = state.copy(), np.full(len(state), -1)  # the context asked, and the one escaped from
        live = np.arange(len(state))
        while len(live):
            node = at[live]
            total = np.where(of[live] < 0, trees.total[k, node], trees.left_total[k, of[live]])
            kinds = np.where(of[live] < 0, trees.kinds[k, node], trees.left_kinds[k, of[live]])
            known = trees.kinds[k, node] > 0
            place, there = _find(trees.grams[k], _longer(trees.state_key[node], byte[live]))
            there &= known
            hit = live[there]
            out[k, hit] += cost(trees.counts[k][place[there]] / (total + kinds)[there])
            escape = known & ~there & (kinds > 0)
            out[k, live[escape]] += cost(kinds[escape] / (total + kinds)[escape])
            of[live[known]] = node[known]
            rest = ~there & (node > 0)
            last = live[~there & (node == 0)]
            if len(last):
                out[k, last] += int(cost(1 / max(SYMBOLS - trees.kinds[k, 0], 1)))
            live = live[rest]
            at[live] = trees.suffix[at[live]]
    return out


class Reader:
    """Code lengths of texts; keeps the prices it has worked out."""

    def __init__(self, trees: Trees, order: int):
        self.trees, self.order = trees, order
        self.slot = np.full(trees.step.size, -1, np.int32)
        self.price = np.zeros((len(trees.languages), 0), np.int32)
        self.first = int(trees.step[0, trees.kind[_SPACE]])

    def pairs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The index of (state, class of byte) at every byte."""
        width, kind = self.trees.step.shape[1], self.trees.kind[data]
        step = self.trees.step.ravel()
        out = np.zeros(len(data), np.int32)
        lengths = np.diff(offsets)
        pieces = -(-lengths // PIECE)
        begin = np.repeat(offsets[:-1], pieces)
        rank = np.arange(len(begin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, end = begin + rank * PIECE, np.minimum(begin + (rank + 1) * PIECE, np.repeat(offsets[1:], pieces))
        order = np.argsort(at - end, kind="stable")  # longest first
        at, end, rank = at[order], end[order], rank[order]
        state = np.full(len(at), self.first, np.int32)
        inner = np.flatnonzero(rank)  # the state before a later piece follows from the bytes before it
        state[inner] = 0
        for k in range(self.order, 0, -1):
            state[inner] = step[state[inner] * width + kind[at[inner] - k]]
        size = end - at
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -k, side="left"))
            here = at[:live] + k
            pair = state[:live] * width + kind[here]
            out[here] = pair
            state[:live] = step[pair]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """languages x texts."""
        data, offsets = coded(data, offsets)
        pair = self.pairs(data, offsets)
        slot = self.slot[pair]
        # bytes of class 0 are priced as the byte 255, which no text in UTF-8 has: unknown to every context
        missing = np.unique(pair[slot < 0])
        if len(missing):
            width = self.trees.step.shape[1]
            byte_of = np.full(width, 255, np.int64)
            byte_of[self.trees.kind[self.trees.kind > 0]] = np.flatnonzero(self.trees.kind)
            self.slot[missing] = self.price.shape[1] + np.arange(len(missing), dtype=np.int32)
            new = prices(self.trees, (missing // width).astype(np.int64), byte_of[missing % width])
            self.price = np.hstack([self.price, new.astype(np.int32)])
            slot = self.slot[pair]
        out = np.zeros((len(self.trees.languages), len(offsets) - 1), np.int64)
        sums = np.zeros(len(data) + 1, np.int64)
        for k, line in enumerate(self.price):
            np.cumsum(line[slot], out=sums[1:])
            out[k] = sums[offsets[1:]] - sums[offsets[:-1]]
        return out


def shares(lengths: np.ndarray) -> np.ndarray:
    """Of each text, the share of the shortest code among 2 ** -length of all languages."""
    with np.errstate(under="ignore"):
        return 1 / np.exp2(np.maximum((lengths.min(0) - lengths) / UNIT, -1000.0)).sum(0)


def learn(
    docs: DataFrame, mod: int, remainder: int, order: int, seen: int, texts: int, size: int, id_col: str, text_col: str, lang_col: str
) -> Trees | None:
    """The trees of a bounded sample: of each language the different texts with the least hashes, while they fit."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), mod, remainder) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("hash"))
    # About twice as many as wanted pass by their hash; copies have one hash, so they count once.
    share = (2.0 * texts / F.approx_count_distinct("hash", 0.05)).alias("share")
    passing = rows.join(F.broadcast(rows.groupBy("lang").agg(share)), "lang").where(F.pmod("hash", F.lit(1 << 32)) < F.col("share") * float(1 << 32))
    found = passing.groupBy("lang", "hash").agg(F.max(F.octet_length("text")).alias("bytes"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 32)), "hash"))).where(F.col("rank") <= texts)
    ranked = stored(ranked)  # ``texts`` rows of each language at most
    known = ranked.select("lang").distinct().count()
    upto = F.sum("bytes").over(Window.partitionBy("lang").orderBy("rank"))
    chosen = stored(ranked.withColumn("upto", upto).where((F.col("upto") * known <= size) | (F.col("rank") == 1)).select("lang", "hash"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text is passed on once by a task."""
        had: set = set()
        for batch in batches:
            new = []
            for k, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if pair not in had:
                    had.add(pair)
                    new.append(k)
            yield batch.take(pa.array(new, pa.int64()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in by_value(batch, "lang"):
                runs, times = grams(part.column("text"), order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs), pa.array(times)], names=["lang", "run", "n"])

    one = rows.join(F.broadcast(chosen), ["lang", "hash"]).select("lang", "hash", "text").mapInArrow(once, "lang string, hash long, text string")
    counted = one.dropDuplicates(["lang", "hash"]).select("lang", "text").mapInArrow(count, "lang string, run long, n long")
    table = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample's bytes
    samples = {}
    for lang, part in ((x, p) for batch in table.combine_chunks().to_batches() for x, p in by_value(batch, "lang")):
        runs, times = part.column("run").to_numpy(), part.column("n").to_numpy()
        if lang in samples:
            runs, times = np.concatenate([samples[lang][0], runs]), np.concatenate([samples[lang][1], times])
        by_run = np.argsort(runs)
        samples[lang] = runs[by_run], times[by_run]
    return grow(samples, order, seen) if samples else None


def languages(
    docs: DataFrame, mod: int = 4, remainder: int = 2, order: int = ORDER, seen: int = SEEN, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, code_bits) of every document; ``code_bits`` is the length of the best language's code."""
    trees = learn(docs, mod, remainder, order, seen, texts, size, id_col, text_col, lang_col)
    # Plain arrays, bounded by the sample's bytes whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(None if trees is None else [getattr(trees, f.name) for f in fields(Trees)])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None if shared.value is None else Reader(Trees(*shared.value), order)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best, score, bits = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if reader is not None:
                for first, last, data, offsets in slices(batch.column("text")):
                    lengths = reader.lengths(data, offsets)
                    best[first:last], score[first:last], bits[first:last] = lengths.argmin(0), shares(lengths), lengths.min(0) / UNIT
            best[~letters], score[~letters], bits[~letters] = -1, 0, 0
            names = [*(reader.trees.languages if reader else []), UNDECIDED]
            told = pa.array(names).take(pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), told.cast(pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "code_bits"])

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    told = rows.mapInArrow(tell, "doc_id long, lang_pred string, score double, code_bits double")
    return told.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "lang_pred", "score", "code_bits")
