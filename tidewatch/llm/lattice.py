"""Subword-lattice likelihood of documents.

A word, with a mark for the space before it, can be cut into vocabulary pieces in many ways. The model gives
each piece a probability, and a word's probability is the sum over all its segmentations, computed by the
forward recursion in logarithms over the lattice of pieces; a document's is the product over its words and one end.
A word of the training texts has one more way through its lattice, as a piece of its own, weighted by its count;
all other ways share the probability of a new word.

The weights start from the vocabulary's own scores (for a vocabulary ordered by merges a score is
minus a rank, and the weight falls with the rank) and are re-estimated once from the
training texts: expected piece counts by the forward and backward recursions over all
distinct training words, with the first weights as prior. Beside it stands the plain word model with add-one counts.

Both need each word's count in all training texts. Tasks gather the distinct words of a stretch of documents
with the places they are at, packed as bytes and dealt by a hash of the word; each bucket then knows the
counts of its words, scores each distinct word once, and sends back sums per document, packed per stretch.

Defined cases: null and empty texts, and white space alone, have no words and one end; with no training text
counts are 0 and the weights stay the vocabulary's; null ids count as empty text for the split and stay null;
repeated rows give one row each, and each counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import held_out, id_and_text, stored
from tidewatch.llm.spans import LOWER, WHITE, mix, slices, word_hashes, words
from tidewatch.llm.token_counts import Trie, build_trie

#: A task gathers so many bytes of text before it hands on what it found; at most 65,535 texts.
STRETCH_BYTES, STRETCH_TEXTS = 16 << 20, 60_000
#: Text bytes per bucket of words: bounds what a task merges.
BUCKET_BYTES = 32 << 20
#: Cells of a lattice batch.
CELLS = 1 << 18
#: How many pieces the vocabulary's own weights count for beside the training texts.
PRIOR = 10_000.0


def scored_pieces(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a leading space for the mark, and their log weights from the scores of the vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    best: dict[bytes, float] = {}
    last = float(model.get_piece_size())
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        # single bytes are the way out for what no piece covers: rarer than any piece
        raw, rank = (bytes([int(piece[3:5], 16)]), 4 * last) if model.is_byte(i) else (piece.replace("▁", " ").encode(), -model.get_score(i))
        if b" " in raw[1:] or not 0 <= rank < 1e8:
            continue
        best[raw] = min(best.get(raw, rank), rank)
    for b in range(256):
        best.setdefault(bytes([b]), 4 * last)
    pieces = sorted(best)
    weight = np.log(1.0 / (np.array([best[p] for p in pieces]) + 50.0))
    return pieces, weight - np.log(np.exp(weight).sum())


def _by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of words of one length, in batches of bounded size."""
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cut):
        if len(same):
            each = max(1, CELLS // (int(lengths[same[0]]) + 2))
            for a in range(0, len(same), each):
                yield same[a : a + each]


def _lattice(trie: Trie, weight: np.ndarray, text: np.ndarray, arcs: list | None) -> np.ndarray:
    """Forward log sums at each place of words of one length (rows of ``text``, the space included); ``arcs`` gets the lattice."""
    n, length = text.shape
    ahead = np.full((length + 1, n), -np.inf)
    ahead[0] = 0.0
    row, table, entry = trie.row, trie.table, trie.entry
    everyone = np.arange(n)
    for i in range(length):
        live, state = everyone, np.zeros(n, np.int32)
        for j in range(i, length):
            state = table[row[state], text[live, j]]
            on = state > 0
            if not on.all():
                live, state = live[on], state[on]
            if not len(live):
                break
            piece = entry[state]
            full = piece >= 0
            at, piece = (live, piece) if full.all() else (live[full], piece[full])
            if len(at):
                ahead[j + 1, at] = np.logaddexp(ahead[j + 1, at], ahead[i, at] + weight[piece])
                if arcs is not None:
                    arcs.append((i, j + 1, at, piece))
    return ahead


def _matrix(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    text = np.empty((len(starts), length + 1), np.uint8)
    text[:, 0] = 0x20
    text[:, 1:] = data[starts[:, None] + np.arange(length)]
    return text


def word_log_probabilities(trie: Trie, weight: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's sum over segmentations."""
    out = np.empty(len(starts))
    for same in _by_length(lengths):
        out[same] = _lattice(trie, weight, _matrix(data, starts[same], int(lengths[same[0]])), None)[-1]
    return out


def expected_counts(trie: Trie, weight: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``times`` times."""
    total = np.zeros(len(weight))
    for same in _by_length(lengths):
        arcs: list = []
        ahead = _lattice(trie, weight, _matrix(data, starts[same], int(lengths[same[0]])), arcs)
        behind = np.full_like(ahead, -np.inf)
        behind[-1] = 0.0
        for i, j, at, piece in reversed(arcs):
            behind[i, at] = np.logaddexp(behind[i, at], behind[j, at] + weight[piece])
        for i, j, at, piece in arcs:
            share = np.exp(ahead[i, at] + weight[piece] + behind[j, at] - ahead[-1, at])
            total += np.bincount(piece, share * times[same[at]], minlength=len(weight))
    return total


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their kinds and sizes as bytes."""
    head = np.array([(ord(a.dtype.kind), a.dtype.itemsize, len(a)) for a in arrays], np.int64)
    return np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * count, 8).reshape(count, 3)
    out, at = [], 8 + 24 * count
    for kind, size, n in head.tolist():
        out.append(np.frombuffer(raw, np.dtype(f"{chr(kind)}{size}"), n, at))
        at += size * n
    return out


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


_GATHERED = "kind int, slot long, data binary"
_GATHERED_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("data", pa.binary())])
WORDS, TEXTS = 0, 1


def _gather(buckets: int):
    """Rows of kind TEXTS: the documents of a stretch; of kind WORDS: a bucket's distinct words of the stretch and where they are."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = number = 0

        def hand_on():
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            ids, out, texts, column = table.column(0), table.column(1), table.num_rows, table.column(2)
            bytes_, lens, hashes, owners, counts = [], [], [], [], np.zeros(texts, np.int64)
            for first, last, data, offsets in slices(column):
                data = LOWER[data]
                starts, ends, begin = words(data, offsets, WHITE)
                counts[first:last] = np.diff(begin)
                hashed = word_hashes(data, starts, ends)
                # a word's bytes are kept once a slice; below once a stretch
                unique, one, same = np.unique(hashed, return_index=True, return_inverse=True)
                owner = np.repeat(np.arange(first, last), np.diff(begin))
                spot, tf = np.unique(same.astype(np.int64) * texts + owner, return_counts=True)
                hashes.append((unique, spot // texts, spot % texts, tf))
                span = ends[one] - starts[one]
                bytes_.append(data[np.repeat(starts[one] - np.cumsum(span) + span, span) + np.arange(span.sum())])
                lens.append(span)
            # what one stretch is called follows from what it holds and its number in the task
            name = int(mix(np.array([hash_rows(ids, counts, number)], np.uint64)).view(np.int64)[0])
            number += 1
            yield TEXTS, name, _pack(ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()).astype(np.uint8), np.asarray(out).astype(np.uint8), counts)
            if not hashes:
                return
            base = np.concatenate([[0], np.cumsum([len(h[0]) for h in hashes])])
            every = np.concatenate([h[0] for h in hashes])
            word = np.concatenate([h[1] + b for h, b in zip(hashes, base)])
            owner, tf = np.concatenate([h[2] for h in hashes]), np.concatenate([h[3] for h in hashes])
            data, span = np.concatenate(bytes_), np.concatenate(lens)
            begin = np.cumsum(span) - span
            unique, one, same = np.unique(every, return_index=True, return_inverse=True)
            word = same[word]
            bucket = (mix(unique) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, word, bucket[word]))
            word, owner, tf = word[order], owner[order], tf[order]
            edges = np.searchsorted(bucket[word], np.arange(buckets + 1))
            for b in range(buckets):
                part = slice(edges[b], edges[b + 1])
                if edges[b] == edges[b + 1]:
                    continue
                own, places = np.unique(word[part], return_counts=True)
                at, n = begin[one[own]], span[one[own]]
                raw = data[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
                yield WORDS, b, _pack(np.array([name]), raw, _small(n), _small(places), owner[part].astype(np.uint16), _small(tf[part]), np.packbits(np.asarray(out).astype(np.uint8)))

        def batch_of(found):
            for kind, slot, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([slot], pa.int64()), pa.array([data], pa.binary())], schema=_GATHERED_ARROW)

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                held.append(part)
                size, rows = size + part.column(2).nbytes, rows + part.num_rows
                if size >= STRETCH_BYTES or rows >= STRETCH_TEXTS:
                    yield from batch_of(hand_on())
                    held, size, rows = [], 0, 0
        if held:
            yield from batch_of(hand_on())

    return gather


def hash_rows(ids, counts: np.ndarray, number: int) -> int:
    """One number for a stretch: its ids in order, word counts and place in the task."""
    from pyspark import TaskContext

    context = TaskContext.get()
    parts = np.concatenate([ids.fill_null(-1).to_numpy().astype(np.int64), counts, [number, context.partitionId() if context else 0]]).view(np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(parts + np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))


class _Bucket:
    """The merged words of one bucket."""

    def __init__(self, blobs: list[bytes]):
        parts = [_unpack(b) for b in blobs]
        data = np.concatenate([p[1] for p in parts])
        span = np.concatenate([p[2].astype(np.int64) for p in parts])
        start = np.cumsum(span) - span
        _, one, same = np.unique(word_hashes_of(data, start, span), return_index=True, return_inverse=True)
        self.data, self.start, self.span = data, start[one], span[one]
        self.parts, self.counts, at = [], np.zeros(len(one), np.int64), 0
        for name, _, lengths, places, owner, tf, out in parts:
            word = np.repeat(same[at : at + len(lengths)], places)
            at += len(lengths)
            outside = np.unpackbits(out)[owner] > 0
            self.counts += np.bincount(word[~outside], tf[~outside].astype(float), minlength=len(one)).astype(np.int64)
            self.parts.append((int(name[0]), word, owner.astype(np.int64), tf.astype(np.int64)))


def word_hashes_of(data: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Hashes of adjoining byte ranges, in slices of bounded size."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + (1 << 21))))
        low, high = start[a], start[b - 1] + span[b - 1]
        out[a:b] = word_hashes(data[low:high], start[a:b] - low, start[a:b] - low + span[a:b])
        a = b
    return out


def likelihoods(
    docs: DataFrame, model_path: str, mod: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, log10."""
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    gathered = stored(rows.mapInArrow(_gather(max(8, -(-size // BUCKET_BYTES))), _GATHERED))
    bucketed = gathered.where(F.col("kind") == WORDS).groupBy("slot")

    pieces, first_weight = scored_pieces(model_path)
    built = build_trie(pieces)
    # Arrays alone, so that workers need no class to read them; bounded by the vocabulary.
    trie = spark.sparkContext.broadcast((built.row, built.table, built.entry, first_weight))

    def estimate(table: pa.Table) -> pa.Table:
        *net, weight = trie.value
        net = Trie(*net)
        bucket = _Bucket(table.column("data").to_pylist())
        seen = np.flatnonzero(bucket.counts)
        counts = expected_counts(net, weight, bucket.data, bucket.start[seen], bucket.span[seen], bucket.counts[seen])
        # three more rows: distinct training words, their tokens, and words seen once
        piece = np.concatenate([np.arange(len(counts)), [-1, -2, -3]])
        more = [len(seen), bucket.counts.sum(), (bucket.counts == 1).sum()]
        return pa.table({"piece": pa.array(piece, pa.int32()), "n": np.concatenate([counts, more]).astype(float)})

    found = bucketed.applyInArrow(estimate, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    totals = {r["piece"]: r["n"] for r in found}  # one row for each piece of the vocabulary
    ends = int(rows.where(~F.col("out")).count())
    train, distinct = int(totals.get(-2, 0)) + ends, int(totals.get(-1, 0)) + (ends > 0)
    counts = np.array([totals.get(k, 0.0) for k in range(len(pieces))])
    share = counts + prior * np.exp(first_weight)
    weights = spark.sparkContext.broadcast(np.log(share / share.sum()))
    seen_words = train - ends
    # The share of words that are new, as often as a training word is the only one of its kind (Good and Turing).
    new = min(max(totals.get(-3, 0.0) / seen_words, 1e-4), 1.0) if seen_words else 1.0
    end = (ends + 1) / (train + 2)
    end_score, end_count = math.log10(end), ends
    scale = math.log10(train + distinct + 1)

    def score(table: pa.Table) -> pa.Table:
        bucket = _Bucket(table.column("data").to_pylist())
        value = math.log(new) + word_log_probabilities(Trie(*trie.value[:3]), weights.value, bucket.data, bucket.start, bucket.span)
        with np.errstate(divide="ignore"):  # words that were not seen have no arc of their own
            value = np.logaddexp(value, np.log((1 - new) * bucket.counts / max(seen_words, 1)))
        value = (value + math.log(1 - end)) / math.log(10)
        base, known = np.log10(bucket.counts + 1.0), bucket.counts > 0
        names, packed = [], []
        for name, word, owner, tf in bucket.parts:
            texts, at = np.unique(owner, return_inverse=True)
            sums = [np.bincount(at, tf * x[word]) for x in (base, known, value)]
            names.append(name)
            packed.append(_pack(texts.astype(np.uint16), *sums, np.bincount(at, tf)))
        return pa.table({"kind": pa.array([WORDS] * len(names), pa.int32()), "slot": pa.array(names, pa.int64()), "data": pa.array(packed, pa.binary())})

    def gather_back(table: pa.Table) -> pa.Table:
        texts, sums = None, []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            if kind == TEXTS:
                texts = _unpack(data)
            else:
                sums.append(_unpack(data))
        ids, null, out, n = texts
        base, known, value, told = (np.zeros(len(ids)) for _ in range(4))
        for at, *parts in sums:
            for total, part in zip((base, known, value, told), parts):
                total[at] += part
        if not np.array_equal(told, n):
            raise RuntimeError("the rows of a recomputed task came in another order; write the input to a table first")
        tokens = n + 1
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "held_out": pa.array(out.astype(bool)), "n_tokens": tokens,
            "n_known": (known + (end_count > 0)).astype(np.int64), "train_tokens": np.full(len(ids), train, np.int64),
            "base_score": base + math.log10(end_count + 1) - tokens * scale, "score": value + end_score,
        })

    scored = bucketed.applyInArrow(score, _GATHERED)
    both = scored.unionByName(gathered.where(F.col("kind") == TEXTS))
    return both.groupBy("slot").applyInArrow(
        gather_back, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
