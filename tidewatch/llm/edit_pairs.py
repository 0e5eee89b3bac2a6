"""Spelling variants: pairs of words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself.

Words are partitioned by what the edit leaves alone. All words of c or c + 1 code points (c is the shorter length of a pair)
start as one group; an edit lies in the first or in the last half of them, so a pair agrees on the other half, and each half makes
a finer group. A group of more than ``group_words`` words is halved again in what is still open, as long as that is longer than
a code point; so no task gets a group that grows with the vocabulary, unless words differ in nearly nothing else.

In a group, all words have come to one initial state of the acceptor. From there a minimised acyclic acceptor of what is open
is composed with the transducer and with itself: both sides walk the same states until the edit (a replaced or an inserted code point at
the first place where the words differ), and equal symbols after it. Results are memoised per pair of states, words are
numbered by the counts of words below the states. A pair that agrees on both halves belongs to the group of its first one.

Defined cases: texts that are null or have no runs give no words; null ids count as empty in the check value; repeated rows count
each; of near words with equal counts the least in code-point order is the form; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import id_and_text, stored
from tidewatch.llm.spans import LOWER, byte_set, slices, strings, words

LENGTH, COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point, by the check value of its document and itself.
EVERY = 199
#: Words of a group that one task composes.
GROUP_WORDS = 20_000
_LETTERS = byte_set((65, 90), (97, 122))
#: Runs up to so many bytes are checked side by side.
_SIDE = 64
#: The lead byte in UTF-8 of all code points U+00C0 to U+00FF, and of no other.
_LEAD = 0xC3
_CHECKS = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def check_values(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte range behind a text of which ``before`` is the crc32."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(starts - ends, kind="stable")
    size = (ends - starts)[order]
    long = int(np.searchsorted(-size, -_SIDE, side="left"))
    for k in order[:long]:
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    order, size = order[long:], size[long:]
    value, at = before[order] ^ np.uint32(0xFFFFFFFF), starts[order]
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        now = value[:live]
        value[:live] = _CHECKS[(now ^ data[at[:live] + step]) & np.uint32(255)] ^ now >> np.uint32(8)
    out[order] = value ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(column: pa.Array, doc_ids: list) -> Iterator[pa.Table]:
    """(word, n) of the runs of each slice of texts, one code point deleted where the check value says so; only those long enough."""
    for first, last, data, offsets in slices(column):
        inside = _LETTERS[data] | (data == _LEAD)
        inside[1:] |= data[:-1] == _LEAD
        form = np.where(inside, LOWER[data], 0x20).astype(np.uint8)
        starts, ends, begin = words(form, offsets, byte_set((0x20, 0x20)))
        points = np.zeros(len(form) + 1, np.int64)
        np.cumsum(form != _LEAD, out=points[1:])
        length = points[ends] - points[starts]
        owner = np.repeat(np.arange(last - first), np.diff(begin))
        kept = np.flatnonzero(length >= LENGTH)
        starts, ends, length, owner = starts[kept], ends[kept], length[kept], owner[kept]
        heads = np.array([zlib.crc32(("" if d is None else str(d)).encode() + b":") for d in doc_ids[first:last]], np.uint32)
        check = check_values(heads[owner], form, starts, ends)
        struck = check % EVERY == 0
        if len(starts):
            whole = strings(form, starts[~struck], ends[~struck]).dictionary_encode()
            yield pa.table({"word": whole.dictionary, "n": np.bincount(whole.indices.to_numpy(), minlength=len(whole.dictionary))})
        changed = []
        for k in np.flatnonzero(struck & (length > LENGTH)):
            run, at = form[starts[k] : ends[k]].tobytes().decode(), int(check[k] % length[k])
            changed.append(run[:at] + run[at + 1 :])
        if changed:
            yield pa.table({"word": pa.array(changed, pa.large_string()), "n": np.ones(len(changed), np.int64)})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (word, n) of the words of ``LENGTH`` code points and ``COUNT`` occurrences or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = list(letter_runs(batch.column("text"), batch.column("doc_id").to_pylist()))
            if tables:
                for part in pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).to_batches():
                    yield pa.RecordBatch.from_arrays([part.column("word").cast(pa.string()), part.column("n_sum")], names=["word", "n"])

    counted = id_and_text(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= COUNT))


class Acceptor:
    """A minimised acyclic acceptor of sorted, different words; states are numbers, 0 the initial one."""

    def __init__(self, listed: list[str]):
        self.out: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.below: list[int] = []  # accepted from here on
        known: dict = {}

        def settled(node) -> int:
            """The state equal to a finished node."""
            arcs, final = node
            key = (final, *arcs.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.out)
                self.out.append(arcs)
                self.final.append(final)
                self.below.append(final + sum(self.below[s] for s in arcs.values()))
            return state

        path: list = [[{}, False]]  # nodes of the last word, not yet settled
        last = ""
        for word in listed:
            same = 0
            while same < len(last) and same < len(word) and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                node = path.pop()
                path[-1][0][last[depth - 1]] = settled(node)
            for _ in word[same:]:
                path.append([{}, False])
            path[-1][1] = True
            last = word
        for depth in range(len(last), 0, -1):
            node = path.pop()
            path[-1][0][last[depth - 1]] = settled(node)
        self.start = settled(path[0])

    def arcs(self, state: int) -> list[tuple[str, int, int]]:
        """(symbol, next state, number of the first word behind it, counted from this state)."""
        found, number = [], int(self.final[state])
        for symbol, following in self.out[state].items():  # in the order of the words
            found.append((symbol, following, number))
            number += self.below[following]
        return found


def composed(listed: list[str], limit: int) -> list[tuple[int, int]]:
    """Places (u, v) of the pairs of words one edit apart whose first difference is before place ``limit``.

    u and v have one length and u < v, or v is longer.
    """
    auto = Acceptor(listed)
    memo: dict = {}
    arcs_of: dict = {}

    def arcs(state):
        if state not in arcs_of:
            arcs_of[state] = auto.arcs(state)
        return arcs_of[state]

    def common(p: int, q: int, but: str | None = None) -> list[tuple[int, int]]:
        """Numbers, from p and from q, of the words that both accept; ``but`` is no first symbol."""
        key = (p, q, but)
        if key not in memo:
            pairs, todo = [], [(p, q, 0, 0, but)]
            while todo:
                a, b, i, j, but = todo.pop()
                if a == b and but is None:
                    pairs += [(i + k, j + k) for k in range(auto.below[a])]
                    continue
                if auto.final[a] and auto.final[b]:
                    pairs.append((i, j))
                others = {symbol: (state, number) for symbol, state, number in arcs(b)}
                for symbol, state, number in arcs(a):
                    if symbol in others and symbol != but:
                        todo.append((state, others[symbol][0], i + number, j + others[symbol][1], None))
            memo[key] = pairs
        return memo[key]

    edits: dict = {}

    def edited(state: int) -> list[tuple[int, int]]:
        """Pairs of words from ``state`` on that differ by one edit at their first symbol."""
        if state not in edits:
            here, found = arcs(state), []
            for k, (_, p, i) in enumerate(here):
                for _, q, j in here[k + 1 :]:
                    found += [(i + a, j + b) for a, b in common(p, q)]
            for symbol, q, j in here:  # ``symbol`` is inserted before what another word from here has
                found += [(a, j + b) for a, b in common(state, q, symbol)]
            edits[state] = found
        return edits[state]

    found, todo = [], [(auto.start, 0, 0)]
    while todo:  # both sides on one state, no edit yet
        state, number, depth = todo.pop()
        if depth >= limit or auto.below[state] < 2:
            continue
        found += [(number + a, number + b) for a, b in edited(state)]
        todo += [(following, number + offset, depth + 1) for _, following, offset in arcs(state)]
    return found


def _near_in_group(listed: list[str], counts: list[int], lengths: list[int], short: int, limit: int):
    """(place, near words, the best one's place) of the words of a group that have any."""
    near: dict[int, list] = {}
    for u, v in composed(listed, limit):
        if lengths[u] > short and lengths[v] > short:
            continue  # a pair of the next group
        for a, b in ((u, v), (v, u)):
            entry = near.setdefault(a, [0, b])
            entry[0] += 1
            if (counts[b], entry[1]) > (counts[entry[1]], b):  # larger, or as large and less
                entry[1] = b
    return near


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups, sorted by group, to (word, n_near, best_n, best)."""

    def solved(rows: list) -> Iterator[tuple]:
        rows.sort(key=lambda r: r[0])
        short, before, limit = rows[0][3:6]
        near = _near_in_group([r[0] for r in rows], [r[2] for r in rows], [len(r[1]) for r in rows], short, limit - before)
        for k, (count, best) in near.items():
            yield rows[k][1], count, rows[best][2], rows[best][1]

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    held: list = []
    group = None
    for batch in batches:
        out: list = []
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for row in zip(c["short"], c["before"], c["behind"], c["edge"], c["fixed"], c["word"], c["n"]):
            if row[:5] != group:
                if len(held) > 1:
                    out += solved(held)
                held, group = [], row[:5]
            word = row[5]
            held.append((word[row[1] : len(word) - row[2]], word, row[6], row[0], row[1], row[3]))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)
    if len(held) > 1:
        out = list(solved(held))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)


_GROUP = ["short", "before", "behind", "edge", "fixed"]


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the two groups of its halves: that which fixes the first half of what is open, and that which fixes the last.

    ``before`` and ``behind`` count the code points that are fixed; a pair of the group agrees on less than the first ``edge``.
    """
    half = F.floor((F.col("short") - F.col("before") - F.col("behind")) / 2).cast("int")
    first = F.struct((F.col("before") + half).alias("before"), F.col("behind"), F.col("edge"))
    last = F.struct(F.col("before"), (F.col("behind") + half).alias("behind"), (F.col("before") + half).alias("edge"))
    out = rows.select("word", "n", "short", F.explode(F.array(first, last)).alias("g")).select("word", "n", "short", "g.*")
    word, size = F.col("word"), F.char_length("word")
    return out.withColumn("fixed", F.concat(F.left(word, F.col("before")), F.lit(" "), F.substring(word, size - F.col("behind") + 1, F.col("behind"))))


def near_words(known: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of a stored table (word, n) that have near words; best by n, then the least."""
    size = F.char_length("word")
    none = F.lit(0)
    rows = known.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).where(F.col("short") >= LENGTH)
    rows = _halved(rows.withColumns({"before": none, "behind": none, "edge": F.lit(2**31 - 1)}))
    parts = []
    while True:
        counts = rows.groupBy(_GROUP).count().where("count > 1")
        counts = stored(counts)
        open_ = F.col("short") - F.col("before") - F.col("behind")
        large = counts.where((F.col("count") > group_words) & (open_ > 1)).drop("count")
        small = counts.where((F.col("count") <= group_words) | (open_ <= 1)).drop("count")
        parts.append(rows.join(small, _GROUP, "left_semi"))
        if large.isEmpty():
            break
        rows = stored(_halved(rows.join(large, _GROUP, "left_semi").drop("fixed")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    dealt = every.select("word", "n", *_GROUP).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = dealt.mapInArrow(_compose, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): forms are followed to the last, twice as far with every round.

    A form has several times the occurrences of its word, so there are no circles and the chains are short.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    known = vocabulary(docs, id_col, text_col)
    rows = stored(known.join(near_words(known, group_words), "word", "left"))
    formed: Column = F.col("best_n") >= F.col("n") * ratio
    last = roots(stored(rows.where(formed).select("word", F.col("best").alias("form"))))
    rows = rows.join(last, "word", "left")
    return rows.select(
        "word", F.when(formed, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"),
    )
