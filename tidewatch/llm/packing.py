"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``size``. The plan sees only how many pieces
there are of each length (at most ``size`` numbers), places whole runs of equal
pieces by best fit, longest first, and says which ranks within a length go to
which run of sequences. Pieces are then numbered within their length by a
distributed ranking and take the slots of their ranks.

Defined cases: null text is empty and is one piece with the end id alone; a null id
stays null in the result; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.rows import id_and_text, stored_in_batches

#: Ids of GPT-2's byte-level vocabulary (text of the public word-splitting rule; a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the per-task memo of encoded words; it is emptied when full.
MEMO_WORDS = 200_000


class _Memo(dict):
    """Word to the packed ids of it, encoded when first met; one small object a word, where lists of ids take several."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        ids = self.encode(word.encode())
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


def encoder(json_path: str, ranks_path: str):
    """A function from text to the ids of the json tokenizer, as little-endian unsigned 32-bit numbers in a row.

    The fast way splits with the vocabulary's rule and memoises the ids of each word.
    Texts with special-token strings or with characters above U+024F, on whose classes two
    Unicode versions may differ, go to the json tokenizer itself.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    memo = _Memo(fast._core_bpe.encode_single_piece)
    split = regex.compile(SPLIT).findall
    plain = regex.compile(r"[\x00-ɏ]*").fullmatch
    slow: list = []

    def encode(text: str) -> bytes:
        if "<|endoftext|>" in text or not plain(text):
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return b"".join(map(memo.__getitem__, split(text)))

    return encode


def token_pieces(
    docs: DataFrame, json_path: str, ranks_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; only the first piece of a cut document may be short."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(json_path, ranks_path), struct.pack("<I", end_id)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encode(text.as_py()) + end
                total = len(raw) // 4
                start, length = 0, (total - 1) % size + 1
                piece = 0
                while start < total:
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start, length, piece = start + length, size, piece + 1
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = 1024) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows of the result: length, first rank, last rank + 1, first sequence, pieces a sequence
    takes, offset of the first of them. Sequences are numbered from 0. Open sequences with
    the same room are kept as runs of numbers, so one step places a whole run of equal pieces.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    records, sequences = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, low = size, sequences
                high = sequences = low - (-left // (size // length))
            else:
                low, high = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            each = room // length
            full = min(high - low, left // each)
            if full:
                records.append((length, rank, rank + full * each, low, each, size - room))
                rooms.setdefault(room - each * length, []).append((low, low + full))
                rank, left, low = rank + full * each, left - full * each, low + full
            if low < high and left and left < each:
                records.append((length, rank, rank + left, low, left, size - room))
                rooms.setdefault(room - left * length, []).append((low, low + 1))
                rank, left, low = rank + left, 0, low + 1
            if low < high:
                rooms.setdefault(room, []).append((low, high))
        rooms.pop(0, None)
        rooms = {r: runs for r, runs in rooms.items() if r > 0}
    return np.array(records, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, size: int = 1024, part_rows: int = 4096, most_parts: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a *stored* table of pieces, whose ``length`` is from 1 to ``size``.

    No length, however common, is one task's work: its pieces are ranked in parts of about
    ``part_rows`` (more once there would be over ``most_parts`` parts in all), and a part's first rank
    comes from the counts of the parts before. At most ``size`` + ``most_parts`` counts reach the driver.
    """
    spark = pieces.sparkSession
    totals = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    rows = max(part_rows, sum(totals.values()) // most_parts)
    parts = F.array(*[F.lit(max(1, -(-totals.get(n, 0) // rows))) for n in range(size + 1)])
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts[F.col("length").cast("int")]).cast("int"))
    counted = dealt.groupBy("length", "part").count().toPandas().sort_values(["length", "part"])
    counted["base"] = counted.groupby("length")["count"].cumsum() - counted["count"]
    bases = {int(n): g.set_index("part")["base"].reindex(range(int(g["part"].max()) + 1), fill_value=0).to_numpy() for n, g in counted.groupby("length")}
    slots = plan(totals, size)
    known = spark.sparkContext.broadcast((slots[np.lexsort((slots[:, 1], slots[:, 0]))], bases))  # bounded by size and most_parts

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bases = known.value
        for frame in frames:
            length, rank, part = frame["length"].to_numpy(), frame.pop("rank").to_numpy() - 1, frame.pop("part").to_numpy()
            found = np.empty(len(frame), np.int64)
            for n in np.unique(length):
                at = length == n
                rank[at] += bases[int(n)][part[at]]
                low, high = np.searchsorted(table[:, 0], (n, n + 1))
                found[at] = low + np.searchsorted(table[low:high, 1], rank[at], side="right") - 1
            slot = table[found]
            within = rank - slot[:, 1]
            frame["sequence_id"] = slot[:, 3] + within // slot[:, 4]
            frame["offset"] = slot[:, 5] + within % slot[:, 4] * length
            yield frame

    by_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    ranked = dealt.withColumn("rank", F.row_number().over(by_part).cast("long"))
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, json_path: str, ranks_path: str, size: int = 1024, end_id: int = 2, **columns) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset."""
    return pack(stored_in_batches(token_pieces(docs, json_path, ranks_path, size, end_id, **columns)), size)
