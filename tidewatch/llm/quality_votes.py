"""Quality by nearest-neighbour votes among labelled latent-semantic vectors.

A text's terms are pairs of neighbouring character classes (letters of a case are one class, every
punctuation sign is its own) and signs of repetition: equal neighbouring words, words and lines that came
before. Term frequencies with inverse document frequencies of a bounded labelled sample
are reduced by a singular value decomposition; the sample's vectors (``sample`` x ``rank`` numbers,
whatever the input) are broadcast, every text is compared with all of them by blocked matrix
products, and its nearest neighbours vote with weights that grow with their cosine.

Labels, ids, sources and languages are no part of a score: ids only say which labelled rows
may be learned from.

Defined cases: null and empty texts have the zero vector and get the share of label 1 in the
sample, as does every text without terms; rows without a label are not learned from, nor are null ids; of repeated
labels all count; without any labelled row every score is 1, so nothing is rejected; null and repeated ids give one row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import held_out, id_and_text, stored
from tidewatch.llm.spans import WHITE, byte_set, mix, slices, word_hashes, words

#: Labelled rows that are learned from, at most.
SAMPLE = 4000
#: Latent dimensions, neighbours that vote, and how sharply a vote falls with the cosine.
RANK, NEIGHBOURS, SHARPNESS = 48, 25, 12.0
THRESHOLD = 0.7

#: Bytes and rows of a slice: a byte takes some fifty, and each row has a line of all terms, however short its text.
SLICE, SLICE_ROWS = 1 << 18, 256

#: Character classes: 0 white, 1 newline, 2 small letter or any byte beyond ASCII, 3 capital, 4 digit, then the punctuation signs.
_CLASS = np.full(256, 2, np.int64)
_CLASS[byte_set((0, 32))] = 0
_CLASS[10] = 1
_CLASS[byte_set((65, 90))] = 3
_CLASS[byte_set((48, 57))] = 4
_SIGNS = [b for b in range(33, 128) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
_CLASSES = 5 + len(_SIGNS)
#: Terms beside the class pairs.
_EXTRA = 3
TERMS = _CLASSES**2 + _EXTRA
_LINES = byte_set((10, 10))


def _earlier(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text, how many of its hashes came before in it."""
    if not len(hashes):
        return np.zeros(texts)
    keyed = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(keyed, return_index=True)
    again = np.ones(len(hashes), bool)
    again[first] = False
    return np.bincount(owner[again], minlength=texts).astype(float)


def frequencies(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, rows x terms): damped relative frequencies."""
    for first, last, data, offsets in slices(column, SLICE, SLICE_ROWS):
        n = last - first
        kind = _CLASS[data]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        pair = kind[:-1] * _CLASSES + kind[1:]
        inside = owner[:-1] == owner[1:]
        counts = np.bincount((owner[:-1] * TERMS + pair)[inside], minlength=n * TERMS).reshape(n, TERMS).astype(float)
        starts, ends, begin = words(data, offsets, WHITE)
        hashes, own = word_hashes(data, starts, ends), np.repeat(np.arange(n), np.diff(begin))
        same = (hashes[:-1] == hashes[1:]) & (own[:-1] == own[1:])
        counts[:, -1] = np.bincount(own[:-1][same], minlength=n)
        counts[:, -2] = _earlier(hashes, own, n)
        starts, ends, begin = words(data, offsets, _LINES)
        counts[:, -3] = _earlier(word_hashes(data, starts, ends), np.repeat(np.arange(n), np.diff(begin)), n)
        size = np.maximum(np.diff(offsets), 1)[:, None]
        counts[:, -2:] *= 5  # a word is some five characters
        yield first, last, np.sqrt(counts / size).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def fit(terms: np.ndarray, labels: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms x rank projection, unit vectors of the rows, labels)."""
    seen = (terms > 0).sum(0)
    weight = np.where(seen > 0, np.log((1 + len(terms)) / (1 + seen)) + 0.3, 0)
    weighted = terms * weight
    # The leading right singular vectors by subspace iteration from a fixed start.
    basis = np.random.default_rng(0).standard_normal((weighted.shape[1], min(rank + 10, *weighted.shape)))
    for _ in range(8):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    projection = (weight[:, None] * (basis @ turn.T)[:, :rank]).astype(np.float32)
    return projection, _unit(terms @ projection), labels.astype(np.float32)


def votes(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Shares of label 1 among the nearest, weighted by similarity; the overall share for a zero vector."""
    near = vectors @ known.T
    if near.shape[1] > neighbours:
        best = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
        near, labels_near = np.take_along_axis(near, best, 1), labels[best]
    else:
        labels_near = np.broadcast_to(labels, near.shape)
    weight = np.exp(sharpness * (near - near.max(1, keepdims=True))) * np.maximum(near, 1e-6)
    out = (weight * labels_near).sum(1) / weight.sum(1)
    return np.where(np.abs(vectors).max(1) > 0, np.clip(out, 0, 1), labels.mean())


def quality_scores(
    docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, sample: int = SAMPLE, rank: int = RANK,
    id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", extra: list[Column] | None = None,
    field: int | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, and ``extra`` columns of ``docs``) of every document.

    ``field`` is the place of the text in the first of ``extra``, if that is a struct with the text as a string: so each text goes to Python once.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(f"`{label_id}`").cast("long").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"), mod, remainder))
    # Which rows are taken is a matter of a hash of the id, so the same rows come again.
    chosen = stored(marked.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample))
    rows = id_and_text(docs, id_col, text_col)
    texts = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found in frequencies(batch.column(1)):
                packed = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], packed], names=["label", "terms"])

    learned = texts.mapInArrow(terms, "label int, terms binary").limit(2 * sample).collect()
    if learned:
        matrix = np.stack([np.frombuffer(r["terms"], np.float32) for r in learned])
        order = np.lexsort(matrix[:, :64].T)  # whatever the order of the rows
        model = fit(matrix[order], np.array([r["label"] for r in learned])[order], rank)
    else:
        model = None
    shared = spark.sparkContext.broadcast(model)  # bounded by sample, rank and terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(batch.num_rows)
            if shared.value is not None:
                projection, known, marks = shared.value
                for first, last, found in frequencies(batch.column("text") if field is None else batch.column(0).field(field)):
                    out[first:last] = votes(_unit(found @ projection), known, marks)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], names=[*names, "score"])

    kept = [c.alias(f"extra{k}") for k, c in enumerate(extra or [])]
    text = [F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")] if field is None else []
    given = docs.select(*kept, F.col(f"`{id_col}`").cast("long").alias("doc_id"), *text)
    fields = [f"`{n}` {t}" for n, t in given.dtypes if n != "text"]
    names = [n for n in given.columns if n != "text"]
    scored = given.mapInArrow(score, ", ".join([*fields, "score double"]))
    return scored.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "score", *[f"extra{k}" for k in range(len(kept))])


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that score below ``threshold``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    field = next((k for k, (c, kind) in enumerate(docs.dtypes) if c == text_col and kind == "string"), None)
    scored = quality_scores(docs, labels, text_col=text_col, extra=[whole], field=field, **options)
    return scored.where(F.col("score") >= threshold).select("extra0.*")
