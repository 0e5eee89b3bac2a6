"""Near duplicates by an exact Jaccard join on word shingles: prefix filter, sketches, full verification.

Two sets of n and m shingles with a Jaccard similarity of at least t share at least T shingles, and
T is no less than t * n. An inverted list per shingle says which sets have it. Only the n - T + 1 shortest lists
of a set are written, since one of them must hold every partner; the T - 1 long ones are neither written nor probed,
and occurrences are not counted. Candidates from the lists are compared in full, both texts' sets,
and those that reach the required overlap are kept.

A posting also says how large a partner may be: at the first shingle that two sets share in the common order, neither has
fewer shingles left than they must share. Members of a list that are in reach of no other member are not kept; a list that is dealt
to several tasks keeps all.

* Lists are ordered short to long by counters over all texts, which shingles share (a fixed number of them, so
  other shingles blur a counter; that changes the work, never the result), ties by hash.
* Equal sets are one candidate, found by a 128-bit key of the set.
* A candidate pair is first compared by two sketches of four to eight bits per shingle, which bound from
  below how much the sets differ; only pairs that pass are compared in full.
* Short lists are spread over the cluster by shingle. A list of many members isn't expanded
  into pairs: in each of a few rounds its members are compared with one of them, and members
  already known to be in one component are not compared. Members of different components that are
  then still on one list are compared by their sketches inside the task that holds the list (or two
  parts of it), which hands on only the pairs that are close; so the components are exact.

Shingles are known by 64-bit hashes. Defined cases: a text of fewer words than a shingle, but
some, is one shingle of all its words; null texts and texts without words have empty sets, link with
nothing and are their own components. Nodes of the search are distinct sets, each known by the least 61-bit
hash of its texts. For ``near_duplicates`` rows that share an id are one node, linked by any of
their texts. Rows with a null id take part like others, and the component of one is the least
id it reaches, null if none. An empty table gives an empty result; other columns are
ignored.

The search ends with components and skips pairs that are already in one. ``near_links`` counts the links
themselves: every two different sets of a component are compared in full, once. A component of many sets is dealt to parts,
and each pair of parts is one piece of work that hands on sums, so no list of pairs is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.links import components
from tidewatch.llm.rows import FILE_TEXTS, few, id_and_text, sized, stored, stored_in_batches
from tidewatch.llm.spans import LOWER, WHITE, mix, shingle_hashes, slices, word_hashes, words

#: Nodes are hashes of texts modulo this.
NODES = 1 << 61
#: Bytes of texts that are taken at once; their words and hashes take some thirty times as much.
SLICE = (1 << 19) - 1
#: Shingles of a stretch, and postings of a batch that is handed on.
STRETCH, POSTS = 1 << 20, 1 << 18
#: Counters (a power of two) that all shingles of all texts share; they order the lists. Their size is fixed, whatever the input.
FREQUENT = 1 << 22
#: Counters travel in so many pieces.
PIECES = 64
#: A list of more members is dealt to several tasks.
LIST_ROWS = 4096
#: Rounds in which long lists are compared with one member.
ROUNDS = 2
#: Sets of one part of a component when its links are counted.
PART = 256


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for first, last, data, offsets in slices(column, SLICE):
        data = LOWER[data]
        starts, ends, begin = words(data, offsets, WHITE)
        shingles, texts = shingle_hashes(word_hashes(data, starts, ends), begin, size)
        border = np.searchsorted(texts, np.arange(last - first + 1))
        for k in range(last - first):
            own = np.sort(shingles[border[k] : border[k + 1]])
            if len(own):
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield first + k, own


def _key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        pair = (mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return tuple(int(np.uint64(x).astype(np.int64)) for x in pair)


def odd_sketch(own: np.ndarray) -> bytes:
    """One bit for each residue of the shingles modulo a power of two, set if an odd number of shingles have it.

    Every shingle that is in one of two sets alone flips one bit, so two sketches never differ in more
    bits than the sets differ in shingles.
    """
    bits = max(256, 4 << (len(own) - 1).bit_length())
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_FIRST = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary())])
_POST = pa.schema([("shingle", pa.int64()), ("salt", pa.int32()), ("k1", pa.int64()), ("n", pa.int32()), ("reach", pa.int32())])


def _survey(size: int, counters: int):
    """Rows of kind 0: a text's set size and key; of kind 1: a piece of the task's counters of shingles in different sets."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        count, sums = 0, np.zeros(counters, np.uint32)

        for batch in batches:
            ids, n, k1, k2, sketch = batch.column(0), [], [], [], []
            for _, own in sets_of(batch.column(1), size):
                key = _key(own)
                n.append(len(own)), k1.append(key[0]), k2.append(key[1]), sketch.append(odd_sketch(own) if len(own) else None)
                if counters and len(own) and key not in seen:
                    seen.add(key)
                    np.add.at(sums, _counter(own, counters), np.uint32(1))
                    count += len(own)
                if count > STRETCH:
                    count = 0
                    seen.clear()
            yield _batch({"kind": np.zeros(len(n), np.int32), "doc": batch.column(2), "id": ids, "n": n, "k1": k1, "k2": k2, "sketch": sketch}, _FIRST)
        if sums.any():
            found = np.minimum(sums, 65535, out=sums).astype("<u2").reshape(PIECES, -1)
            found = [_packed(x) for x in found]
            blank = np.zeros(PIECES, np.int64)
            yield _batch({"kind": np.ones(PIECES, np.int32), "doc": [None] * PIECES, "id": blank, "n": blank, "k1": np.arange(PIECES), "k2": blank, "sketch": found}, _FIRST)

    return survey


def _counter(own: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each shingle."""
    return (mix(own) & np.uint64(counters - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counters of 16 bits: as they are, or the places and values of those that aren't 0 where that is shorter and places have 16 bits too."""
    at = np.flatnonzero(counts)
    return counts.tobytes() if 2 * len(at) >= len(counts) or len(counts) > 1 << 16 else np.concatenate([at.astype("<u2"), counts[at]]).tobytes()


def _summed_pieces(counters: int):
    """Rows (piece, packed counters) to one row per piece with the sums; a task holds one sum per piece."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(data.as_py(), "<u2")
                total = sums.setdefault(piece, np.zeros(counters // PIECES, "<u4"))
                if len(own) == len(total):
                    total += own
                else:
                    at, counts = own.reshape(2, -1)
                    total[at] += counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "sums"])

    return add


def _postings(size: int, percent: int, common, list_rows: int):
    """(shingle, salt, k1, n, reach) for the short lists of each set, once per stretch of a task for equal sets.

    ``reach`` is the largest set that may link with this one and share this shingle as the first of all; rounded up, so that it repeats.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = common.value
        usual = int(np.median(times))  # what other shingles add to a counter
        seen: set = set()
        shingles, keys, salts, sizes, reaches, held = [], [], [], [], [], 0

        def posted() -> pa.RecordBatch:
            return _batch(
                {"shingle": np.concatenate(shingles).view(np.int64), "salt": np.concatenate(salts), "k1": np.concatenate(keys), "n": np.concatenate(sizes), "reach": np.concatenate(reaches)}, _POST
            )

        for batch in batches:
            for _, own in sets_of(batch.column(1), size):
                n = len(own)
                if not n:
                    continue
                key = _key(own)
                if key in seen:
                    continue
                seen.add(key)
                short = n + (-percent * n // 100) + 1  # n - T + 1
                often = times[_counter(own, len(times))]
                # One order of all shingles for all sets: by counter, ties by hash.
                order = np.argsort(often, kind="stable")[:short]
                own, often = own[order], np.maximum(often[order].astype(np.int64) - usual, 0)
                long = often > list_rows
                parts = np.where(long, often // list_rows + 1, 1)
                shingles.append(own)
                salts.append(((key[0] & 0x7FFFFFFFFFFFFFFF) % parts + long).astype(np.int32))
                keys.append(np.full(short, key[0], np.int64))
                sizes.append(np.full(short, n, np.int32))
                step = n // 32 + 1
                reach = (n - np.arange(short)) * (100 + percent) // percent - n
                reaches.append((-(-reach // step) * step).astype(np.int32))
                held += short
                if held > POSTS:
                    yield posted()
                    shingles, keys, salts, sizes, reaches, held = [], [], [], [], [], 0
            if len(seen) > 50_000:
                seen.clear()
        if shingles:
            yield posted()

    return post


def _verify(size: int, percent: int):
    """Pairs (a, b, ta, tb) whose whole sets reach the overlap."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for (k, x), (_, y) in zip(sets_of(batch.column(2), size), sets_of(batch.column(3), size)):
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or 100 * len(x) < percent * len(y):
                    continue
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return verify


def _close(percent: int):
    """Pairs (a, b) whose sketches differ in no more bits than sets of that similarity may differ in shingles."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(6))
            keep = [
                (100 + percent) * _differ(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (100 - percent) * (m + n)
                for m, n, x, y in zip(na, nb, sa, sb)
            ]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return close


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _close_in_list(node, label, n, side, sketch, percent: int, nearest: bool) -> tuple[set, bool]:
    """Pairs of members of one list, of two components, whose sketches are close; of two parts if there are two sides.

    With ``nearest``, one pair for each member that has any: that with the closest other. Also whether there are more pairs than these.
    """
    found, count = set(), 0
    order = np.argsort(n, kind="stable")
    node, label, n, side, sketch = node[order], label[order], n[order], side[order], [sketch[k] for k in order]
    length = np.array([len(x) for x in sketch])
    own, folded, place = {}, {}, np.zeros(len(n), np.int64)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        place[at] = np.arange(len(at))
        own[size] = np.frombuffer(b"".join(sketch[k] for k in at), np.uint8).reshape(len(at), size)
        folded[size] = own[size][:, : size // 2] ^ own[size][:, size // 2 :]
    two = side.min() != side.max()
    last = np.searchsorted(n, 100 * n // percent, side="right")
    least, best = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), -1)
    for k in range(len(n)):
        others = np.arange(k + 1, last[k])
        others = others[(label[others] != label[k]) & ((side[others] != side[k]) | (not two))]
        if not len(others):
            continue
        mine = own[length[k]][place[k]]
        for table, size in ((own, length[k]), (folded, 2 * length[k])):
            some = others[length[others] == size]
            if len(some):
                differ = np.bitwise_count(table[size][place[some]] ^ mine).sum(1, dtype=np.int64)
                close = (100 + percent) * differ <= (100 - percent) * (n[k] + n[some])
                some, differ = some[close], differ[close]
                count += len(some)
                if not nearest:
                    found.update((node[k], node[j]) if node[k] < node[j] else (node[j], node[k]) for j in some)
                elif len(some):
                    better = differ < least[some]
                    least[some[better]], best[some[better]] = differ[better], k
                    if differ.min() < least[k]:
                        least[k], best[k] = differ.min(), some[differ.argmin()]
    for k in np.flatnonzero(best >= 0):
        a, b = node[k], node[best[k]]
        found.add((a, b) if a < b else (b, a))
    return found, count > len(found)


_FOUND = pa.schema([*_PAIRS, ("shingle", pa.int64()), ("p", pa.int32()), ("q", pa.int32())])


def _search_lists(percent: int, nearest: bool):
    """Rows of lists, sorted by list, to the close pairs (a, b) of each, and (shingle, p, q) of those that hold more close pairs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def searched(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            columns = [table.column(k).to_numpy() for k in range(3, 7)]
            sketch = table.column(7).to_pylist()
            pairs, open_lists = set(), []
            for a, b in zip([0, *cuts], [*cuts, table.num_rows]):
                found, more = _close_in_list(*(c[a:b] for c in columns), sketch[a:b], percent, nearest)
                pairs |= found
                if more:
                    open_lists.append(key[:, a])
            no_list, no_pair = [None] * len(pairs), [None] * len(open_lists)
            ends = {"a": [x for x, _ in pairs] + no_pair, "b": [y for _, y in pairs] + no_pair}
            return _batch(ends | {c: no_list + [x[k] for x in open_lists] for k, c in enumerate(("shingle", "p", "q"))}, _FOUND)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            turn = np.flatnonzero((key != key[:, -1:]).any(0))
            # the last list may go on in the next batch
            whole = int(turn[-1]) + 1 if len(turn) else 0
            if whole:
                yield searched(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield searched(pa.Table.from_batches(held))

    return search


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, doc): the hash of the text, the text, the row's own id."""
    return id_and_text(docs, id_col, text_col).select(F.pmod(F.xxhash64("text"), F.lit(NODES)).alias("id"), "text", F.col("doc_id").alias("doc"))


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, size: int = 5, percent: int = 80, frequent: int = FREQUENT, list_rows: int = LIST_ROWS, rounds: int = ROUNDS
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame | None]:
    """Two stored tables, and what fetches texts.

    (doc, id, n, node, root) of every row: its id, the hash of its text, its set's size and node, and the least node which
    that reaches; no node and no root without words. A function from a stored table (node) to the stored (id, text) of these. (node, root) of
    the nodes that reach a lesser one; None if there are no links.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    first = stored_in_batches(rows.mapInArrow(_survey(size, frequent), "kind int, doc long, id long, n long, k1 long, k2 long, sketch binary"))
    sets = first.where("kind = 0").select("doc", "id", "n", "k1", "k2")

    # How often shingles occur over all texts, by counters that they share; any counts give the same result.
    pieces = first.where("kind = 1").select(F.col("k1").alias("piece"), "sketch").repartition("piece")
    # A row may take 128 kB, and there is one per task and piece.
    table = stored_in_batches(pieces.mapInArrow(_summed_pieces(frequent), "piece long, sums binary"), PIECES).collect()  # 16 MB, whatever the input
    times = np.frombuffer(b"".join(bytes(r["sums"]) for r in sorted(table)), "<u4") if table else np.zeros(1, np.uint32)
    common = spark.sparkContext.broadcast(times)

    n_rows = sets.count()
    classes = first.where("kind = 0 and n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "doc")).alias("least"), F.any_value("sketch").alias("sketch"))
    classes = stored(few(classes.select("k1", "k2", "n", F.col("least.id").alias("node"), F.col("least.doc").alias("doc"), "sketch"), n_rows))
    posts = rows.select("id", "text").mapInArrow(_postings(size, percent, common, list_rows), "shingle long, salt int, k1 long, n int, reach int")
    # Equal sets of several stretches once; then those that a larger member may link with, or a smaller one.
    by_size = Window.partitionBy("shingle", "salt").orderBy("n", "k1")
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    listed = posts.withColumn("again", F.lag("k1").over(by_size) == F.col("k1")).where("again is null or not again")
    listed = listed.select("*", F.lead("n").over(by_size).alias("next"), F.max("reach").over(before).alias("reached"), F.min("n").over(before).alias("least"))
    listed = stored_in_batches(listed.where("salt > 0 or next <= reach or (reached >= n and least <= reach)").select("shingle", "salt", "k1"))
    nodes, most = sized(classes.select("k1", "node", F.col("n").alias("n_set"))), listed.count()
    listed = listed.join(nodes, "k1").select("shingle", "salt", "node", "n_set").distinct()
    # Lists with the same members say the same: one of each is kept.
    whole = listed.groupBy("shingle").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("g")
    )
    chosen = whole.where("c > 1").groupBy("c", "h", "g").agg(F.min("shingle").alias("shingle")).select("shingle")
    listed = stored(few(listed.join(chosen, "shingle", "left_semi"), most))
    most = listed.count()

    wanted = sized(stored(few(listed.select("node").distinct(), most)))
    sketches = stored(few(classes.join(wanted, "node", "left_semi").select("node", "n", "sketch"), n_rows))

    def texts_of(some: DataFrame) -> DataFrame:
        source = sized(stored(few(classes.join(sized(some), "node", "left_semi").select("node", F.col("doc").alias("of")), some.count())))
        texts = stored(rows.join(source, (rows["id"] == source["node"]) & rows["doc"].eqNullSafe(source["of"]), "left_semi").select("id", "text"))
        if not texts.groupBy("id").count().where("count > 1").isEmpty():
            texts = stored(texts.dropDuplicates(["id"]))  # rows that repeat both id and text
        return texts

    def verified(near: DataFrame) -> DataFrame:
        """The stored pairs (a, b) that reach the similarity; only their texts are fetched, from the rows themselves."""
        count = near.count()
        if not count:
            return near
        texts = texts_of(stored(few(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * count)))
        x, y = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        both = few(near.join(x, "a").join(y, "b").select("a", "b", "ta", "tb"), count, FILE_TEXTS)
        return stored_in_batches(both.mapInArrow(_verify(size, percent), "a long, b long"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the similarity; texts are fetched only for those whose sketches are close."""
        x, y = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        near = few(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb"), 2 * most)  # a row of the lists is in two pairs at most
        return verified(stored(near.mapInArrow(_close(percent), "a long, b long")))

    def grown(roots: DataFrame | None, new: DataFrame) -> DataFrame | None:
        if new.isEmpty():
            return roots
        return components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    near = F.least("n_set", "o_set") * 100 >= F.greatest("n_set", "o_set") * percent
    roots = None
    current = listed.withColumn("label", F.col("node"))
    for turn in range(rounds):
        # One member of each list, another each round; salted parts of a long list first, then their chosen ones.
        other = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "label", "n_set"))
        stars = current.withColumn("o", other.over(Window.partitionBy("shingle", "salt")))
        tops = stars.where("salt > 0").select("shingle", "o").distinct().select("shingle", "o", F.min("o").over(Window.partitionBy("shingle")).alias("t"))
        tops = tops.select(F.col("o.node").alias("x"), F.col("o.label").alias("xl"), F.col("t.node").alias("y"), F.col("t.label").alias("yl"), F.col("o.n_set").alias("n_set"), F.col("t.n_set").alias("o_set"))
        stars = stars.select(F.col("node").alias("x"), F.col("label").alias("xl"), F.col("o.node").alias("y"), F.col("o.label").alias("yl"), "n_set", F.col("o.n_set").alias("o_set"))
        pairs = stars.unionByName(tops).where((F.col("xl") != F.col("yl")) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        roots = grown(roots, linked(pairs))
        current = _mixed(listed, roots, most)
    # Whatever is still apart on one list: each pair of its parts is one piece of work. First every member is
    # compared with its nearest of another component, which joins most that belong together; then all that are left, in those
    # pieces that hold more close pairs than the nearest ones.
    pieces = None
    for nearest in (True, False):
        parts = current.groupBy("shingle").agg(F.array_sort(F.collect_set("salt")).alias("salts"))
        rest = current.join(parts, "shingle").withColumn("o", F.explode("salts"))
        rest = rest.select("shingle", F.least("salt", "o").alias("p"), F.greatest("salt", "o").alias("q"), "node", "label", F.col("salt").alias("side"))
        if pieces is not None:
            rest = rest.join(pieces, ["shingle", "p", "q"], "left_semi")
        rest = rest.join(sketches, "node").select("shingle", "p", "q", "node", "label", "n", "side", "sketch")
        rest = rest.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q")
        searched = stored(rest.mapInArrow(_search_lists(percent, nearest), "a long, b long, shingle long, p int, q int"))
        count = searched.count()
        roots = grown(roots, verified(stored(few(searched.where("a is not null").select("a", "b").distinct(), count))))
        if nearest:
            pieces = stored(few(searched.where("a is null").select("shingle", "p", "q"), count))
            if pieces.isEmpty():
                break
            pieces = sized(pieces)
            current = _mixed(listed, roots, most)

    sizes = classes.select("k1", "k2", "n", "node")
    if roots is not None:
        roots = stored(roots)
        sizes = sizes.join(sized(roots), "node", "left").select("k1", "k2", "n", "node", F.coalesce("root", "node").alias("root"))
    else:
        sizes = sizes.withColumn("root", F.col("node"))
    found = stored(sets.join(sized(stored(sizes)), ["k1", "k2", "n"], "left").select("doc", "id", "n", "node", "root"))
    return found, texts_of, roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; two rows link at ``percent`` hundredths or more."""
    found, _, _ = _grouped(docs, id_col, text_col, **options)
    # An id with several texts is one node: the components of its texts are joined.
    shared = found.where("doc is not null").groupBy("doc").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.count("root") < F.count("*")).alias("blank"))
    n_rows = found.count()
    shared = stored(few(shared.where("low < high or low is not null and blank").select("doc", "low"), n_rows))
    out = found.select("doc", "n", "root")
    if not shared.isEmpty():
        out = stored(out.join(sized(shared), "doc", "left"))
        merged = sized(stored(components(out.where("root > low").select(F.col("root").alias("a"), F.col("low").alias("b"))).withColumnRenamed("root", "top")))
        out = out.select("doc", "n", F.coalesce("root", "low").alias("node")).join(merged, "node", "left").select("doc", "n", F.coalesce("top", "node").alias("root"))
    least = out.where("root is not null").groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("c")).where("c > 1").select("root", "least")
    least = stored(few(least, n_rows))
    out = out.join(sized(least), "root", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64())])


def _links_in_piece(node, weight, side, texts: pa.Array, two: bool, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a piece and how many rows each links with; between its two sides only, if it is of ``two`` parts."""
    own = [x for _, x in sets_of(texts, size)]
    n = np.array([len(x) for x in own])
    order = np.argsort(n, kind="stable")
    node, weight, side, n = node[order], weight[order], side[order], n[order]
    known, held = np.unique(np.concatenate([own[k] for k in order]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(n)])
    # a larger set can't reach the similarity
    last = np.searchsorted(n, 100 * n // percent, side="right")
    links, mark = np.zeros(len(n), np.int64), np.zeros(len(known), bool)
    for k in range(len(n)):
        a, b = k + 1, last[k]
        if a >= b:
            continue
        mine = held[start[k] : start[k + 1]]
        mark[mine] = True
        shared = np.add.reduceat(mark[held[start[a] : start[b]]], start[a:b] - start[a], dtype=np.int64)
        mark[mine] = False
        hit = 100 * shared >= percent * (n[k] + n[a:b] - shared)
        if two:
            hit &= side[a:b] != side[k]
        links[k] += weight[a:b][hit].sum()
        links[a:b][hit] += weight[k]
    return node, links


def _count_links(size: int, percent: int):
    """Rows (root, p, q, node, weight, side, text), sorted by piece, to (node, links)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pieces(table: pa.Table):
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            columns = [table.column(k).to_numpy() for k in range(3, 6)]
            for a, b in zip([0, *cuts], [*cuts, table.num_rows]):
                text = table.column(6).slice(a, b - a).combine_chunks()
                node, links = _links_in_piece(*(c[a:b] for c in columns), text.chunk(0) if isinstance(text, pa.ChunkedArray) else text, bool(key[1, a] != key[2, a]), size, percent)
                yield _batch({"node": node, "links": links}, _LINKS)

        for batch in batches:
            held.append(batch)
            ends = [np.array([x.column(k)[at].as_py() for k in range(3)]) for x, at in ((held[0], 0), (batch, batch.num_rows - 1))]
            if (ends[0] == ends[1]).all():
                continue  # one piece so far
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(k).to_numpy() for k in range(3)])
            whole = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1
            yield from pieces(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield from pieces(pa.Table.from_batches(held))

    return count


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, **options) -> DataFrame:
    """(doc_id, n_shingles, class_id, class_size, n_links) of every row.

    A class are the rows with one set, known by their least id (null if none has one); ``n_links`` are all other rows that reach
    the similarity, those of the class included. Rows count, also those that repeat an id. A row without words is a class of its own.
    """
    found, texts_of, roots = _grouped(docs, id_col, text_col, **options)
    classes = found.where("node is not null").groupBy("node").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    if roots is None:
        classes = classes.withColumn("links", F.lit(0).cast("long"))
    else:
        classes = stored(classes)
        members = roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))
        dealt = sized(stored(roots.groupBy("root").agg((F.count("*") / part + 1).cast("int").alias("parts"))))
        members = members.join(dealt, "root").withColumn("side", F.pmod(F.xxhash64("node", F.lit(part)), F.col("parts")).cast("int"))
        members = stored(members.join(sized(classes), "node").select("root", "node", F.col("class_size").alias("weight"), "side", "parts"))
        texts = texts_of(stored(members.select("node")))
        pieces = members.join(texts, members["node"] == texts["id"]).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pieces = pieces.select("root", F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "node", "weight", "side", "text")
        pieces = pieces.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
        size, percent = options.get("size", 5), options.get("percent", 80)
        links = pieces.mapInArrow(_count_links(size, percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
        classes = classes.join(sized(stored_in_batches(links)), "node", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    out = found.select("doc", "n", "node").join(sized(stored(classes)), "node", "left")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce(F.col("class_size") - 1 + F.col("links"), F.lit(0).cast("long")).alias("n_links"),
    )


def _mixed(listed: DataFrame, roots: DataFrame | None, most: int) -> DataFrame:
    """The lists whose members are of more than one component, with each member's component; ``most`` rows at most."""
    if roots is None:
        labelled = listed.withColumn("label", F.col("node"))
    else:
        labelled = listed.join(sized(roots), "node", "left").select("shingle", "salt", "node", "n_set", F.coalesce("root", "node").alias("label"))
    several = labelled.groupBy("shingle").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("shingle")
    return stored(few(labelled.join(several, "shingle", "left_semi"), most))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with exactly one row of each component of texts: that with the least id, null ids last, ties by the text's hash.

    Decided per text, so a repeated id doesn't join its texts: each goes or stays by what it says. Of rows that repeat both id and
    text one stays. Rows without words all stay.
    """
    found, _, _ = _grouped(docs, id_col, text_col, **options)
    rank = F.struct(F.col("doc").isNull(), "doc", "id")
    best = found.where("root is not null").groupBy("root").agg(F.count("*").alias("c"), F.min(rank).alias("best"))
    best = best.where("c > 1").select("root", F.col("best.doc").alias("keep_doc"), F.col("best.id").alias("keep_id"))
    n_rows = found.count()
    groups = stored(few(best, n_rows))
    first = F.col("doc").eqNullSafe(F.col("keep_doc")) & (F.col("id") == F.col("keep_id"))
    members = found.join(sized(groups), "root").groupBy("doc", "id").agg(F.bool_or(first).alias("kept"), F.count("*").alias("c"))
    marked = members.where("not kept or c > 1").select(F.col("doc").alias("_near_doc"), F.col("id").alias("_near_hash"), F.col("kept").alias("_near_kept"))
    marked = stored(few(marked, n_rows))
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col("_near_doc")) & (F.pmod(F.xxhash64(text), F.lit(NODES)) == F.col("_near_hash"))
    if marked.where("_near_kept").isEmpty():
        return docs.join(sized(marked), same, "left_anti")
    rows = docs.join(sized(marked), same, "left")
    # Only rows that repeat both the id and the text that stay are ranked.
    ranked = rows.where("_near_kept").withColumn("_near_rank", F.row_number().over(Window.partitionBy("_near_doc", "_near_hash").orderBy(F.lit(0))))
    return rows.where("_near_kept is null").unionByName(ranked.where("_near_rank = 1").drop("_near_rank")).drop("_near_doc", "_near_hash", "_near_kept")
