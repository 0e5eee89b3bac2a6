"""Secret scans by a linear-chain conditional random field.

A text's tokens (runs of word signs, runs of other signs) are tagged as the beginning of a
secret, its inside, or outside. A tag's score adds up what is known of the token's shape,
of its neighbours and of the whole text, and of the tag before; the best sequence is found by Viterbi. The field
is trained here on a bounded sample whose tags come from plain patterns (assignments to
telling names, access keys, long hexadecimal runs); those plain spans are kept in any case, and
the field adds spans that overlap none of them.

Decoding is exact and cheap: where a token's lead for "outside" is larger than anything its neighbours'
transitions could gain, it is outside in the best sequence, and the sequence falls apart there. Only
the short stretches in between are searched.

Defined cases: null and empty texts have no spans; null and repeated ids and repeated rows give one row each;
without a text to learn from no spans are added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import id_and_text, stored
from tidewatch.llm.spans import LOWER, byte_set, slices, word_hashes

#: The plain patterns, in order, and the least length of what they must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_PLAIN_NEED = (":", "=")

#: Names that may stand before a secret.
TELLING = (
    "password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "key", "auth", "bearer", "authorization",
    "credential", "credentials", "access_key", "secret_key", "private_key", "client_secret", "access_token", "auth_token", "signature",
)
#: Sequences that are learned from, at most, and their length in tokens.
SAMPLE_TEXTS, SAMPLE_SEQUENCES, SEQUENCE = 1000, 3000, 120
OUT, BEGIN, INSIDE = 0, 1, 2
_WORD, _SIGNS, _ASSIGN, _NAME, _EDGE = range(5)
#: Numbers of codes: whole shape, coarse shape, two tokens before, third before and next, whole text.
CODES = (6 * 4 * 3 * 2 * 2 * 4, 6 * 4 * 3, 5 * 5, 5 * 5, 3 * 2 * 2)

_GROUP = np.full(256, 2, np.int8)
_GROUP[byte_set((0, 32))] = 0
_GROUP[byte_set((48, 57), (65, 90), (97, 122), (128, 255)) | np.isin(np.arange(256), list(b"+/_-"))] = 1
_DIGIT, _UPPER, _FAR = byte_set((48, 57)), byte_set((65, 90)), byte_set((128, 255))
_HEX = byte_set((48, 57), (97, 102))
_SETS = np.isin(np.arange(256), list(b"=:"))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the plain patterns, by start and kind, in code points."""
    found = []
    if any(sign in text for sign in _PLAIN_NEED):
        small = text.lower()
        if any(name in small for name in _NAMES):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return sorted(found)


def hex_spans(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= HEX_LEAST]


def _names() -> np.ndarray:
    data = np.frombuffer("".join(TELLING).encode(), np.uint8)
    ends = np.cumsum([len(n) for n in TELLING])
    return np.sort(word_hashes(data, ends - [len(n) for n in TELLING], ends))


def _neighbours(kind: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the kinds of the two tokens before, and of the third before and the next one, within a text."""
    beside = []
    for shift in (1, 2, 3, -1):
        other = np.full(len(kind), _EDGE)
        if shift > 0:
            other[shift:] = np.where(owner[shift:] == owner[:-shift], kind[:-shift], _EDGE)
        else:
            other[:shift] = np.where(owner[:shift] == owner[-shift:], kind[-shift:], _EDGE)
        beside.append(other)
    return beside[0] * 5 + beside[1], beside[2] * 5 + beside[3]


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, first token of each text, and the codes of each token (see CODES)."""
    n, texts = len(data), len(offsets) - 1
    group = _GROUP[data]
    change = np.ones(n + 1, bool)
    change[1:n] = group[1:] != group[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = group[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    begin = np.searchsorted(starts, offsets)
    length = ends - starts

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(table[data], dtype=np.int32, out=sums[1:])
        return sums[ends] - sums[starts]

    digits, uppers, far, hexes = count(_DIGIT), count(_UPPER), count(_FAR), count(_HEX)
    word = group[starts] == 1
    names = _names()
    hashed = word_hashes(LOWER[data], starts, ends)
    named = names[np.minimum(np.searchsorted(names, hashed), len(names) - 1)] == hashed
    kind = np.where(word, np.where(named, _NAME, _WORD), np.where(count(_SETS) > 0, _ASSIGN, _SIGNS))
    size = np.searchsorted([3, 6, 12, 20, 32], length, side="right")
    share = np.where(digits == 0, 0, np.where(digits == length, 3, np.where(2 * digits >= length, 2, 1)))
    case = np.where(uppers == 0, 0, np.where((uppers == 1) & _UPPER[data[starts]], 1, 2))
    hexed = (hexes == length) & (digits > 0) & (digits < length)
    shape = ((((size * 4 + share) * 3 + case) * 2 + hexed) * 2 + (far > 0)) * 4 + kind
    owner = np.repeat(np.arange(texts), np.diff(begin))
    # of the whole text: share of tokens with digits, whether a name is set anywhere, how often something is set
    per = np.maximum(np.diff(begin), 1)
    sum_of = lambda x: np.bincount(owner, x, minlength=texts)
    after_name = np.zeros(len(kind), bool)
    after_name[1:] = (kind[1:] == _ASSIGN) & (kind[:-1] == _NAME) & (owner[1:] == owner[:-1])
    file = (np.searchsorted([0.02, 0.2], sum_of(digits > 0) / per, side="right") * 2 + (sum_of(after_name) > 0)) * 2 + (sum_of(kind == _ASSIGN) / per > 0.05)
    return starts, ends, begin, shape, (size * 4 + share) * 3 + case, *_neighbours(kind, owner), file[owner]


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.1, decay: float = 0.02) -> tuple[np.ndarray, ...]:
    """Weights (one table per code, then transitions) of the highest penalised likelihood; sequences are (codes, tags)."""
    count, longest = len(sequences), max(len(t) for _, t in sequences)
    codes, tags, real = np.zeros((count, longest, len(CODES)), np.int64), np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for k, (c, t) in enumerate(sequences):
        codes[k, : len(t)], tags[k, : len(t)], real[k, : len(t)] = c, t, True
    weights = [np.zeros((n, 3)) for n in CODES] + [np.zeros((3, 3))]
    moments, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    before = np.concatenate([np.full((count, 1), OUT), tags[:, :-1]], 1)
    flat = [codes[..., k][real] for k in range(len(CODES))]
    for turn in range(1, rounds + 1):
        score = sum(w[codes[..., k]] for k, w in enumerate(weights[:-1]))
        step = weights[-1]
        ahead, behind = np.empty((longest, count, 3)), np.zeros((longest + 1, count, 3))
        ahead[0] = score[:, 0] + step[OUT]
        for t in range(1, longest):
            ahead[t] = np.where(real[:, t, None], np.logaddexp.reduce(ahead[t - 1][:, :, None] + step, 1) + score[:, t], ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            following = np.logaddexp.reduce(step + (score[:, t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(real[:, t + 1, None], following, behind[t + 1])
        whole = np.logaddexp.reduce(ahead[-1], 1)
        chance = np.exp(ahead + behind[:longest] - whole[None, :, None]).transpose(1, 0, 2)
        wrong = np.eye(3)[tags] - chance
        grads = []
        for k, w in enumerate(weights[:-1]):
            grads.append(np.stack([np.bincount(flat[k], wrong[..., y][real], minlength=len(w)) for y in range(3)], 1) - decay * w)
        moves = np.zeros((3, 3))
        np.add.at(moves, (before[real], tags[real]), 1)
        moves -= np.concatenate([chance[:, :1].sum(0), np.zeros((2, 3))]) * 1.0
        for t in range(1, longest):
            pair = np.exp(ahead[t - 1][:, :, None] + step + (score[:, t] + behind[t])[:, None, :] - whole[:, None, None])
            moves -= pair[real[:, t]].sum(0)
        grads.append(moves - decay * step)
        # steps of a size that neither the first large gradients nor rare codes decide (Adam)
        for w, g, m, s in zip(weights, grads, moments, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-6)
    return tuple(weights)


def viterbi(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of one stretch between two tokens that are outside."""
    best, back = score[0] + step[OUT], []
    for row in score[1:]:
        through = best[:, None] + step
        back.append(through.argmax(0))
        best = through.max(0) + row
    tags = [int((best + step[:, OUT]).argmax())]
    for row in reversed(back):
        tags.append(int(row[tags[-1]]))
    return np.array(tags[::-1])


def decode(codes: tuple[np.ndarray, ...], begin: np.ndarray, weights: tuple[np.ndarray, ...]) -> list[tuple[int, int]]:
    """(first, last) tokens of the secrets of all texts of a slice; the best tags of each whole text."""
    *emit, step = weights
    score = sum(w[c] for w, c in zip(emit, codes))
    if not len(score):
        return []
    # no change of neighbours can gain more than this for a tag other than "outside"
    gain = max(step[p, x] + step[x, n] - step[p, OUT] - step[OUT, n] for p in range(3) for n in range(3) for x in (BEGIN, INSIDE))
    open_ = score[:, OUT] - score[:, 1:].max(1) <= gain
    spots = np.flatnonzero(open_)
    if not len(spots):
        return []
    first = np.zeros(len(score) + 1, bool)
    first[begin] = True
    cuts = np.flatnonzero((np.diff(spots) > 1) | first[spots[1:]]) + 1
    found = []
    for stretch in np.split(spots, cuts):
        part = score[stretch[0] : stretch[-1] + 1]
        if len(part) == 1:
            options = part[0] + step[OUT] + step[:, OUT]
            tags = [int(options.argmax())]
        else:
            tags = viterbi(part, step)
        at = None
        for k, tag in enumerate([*tags, OUT]):
            if at is not None and tag != INSIDE:
                found.append((stretch[0] + at, stretch[0] + k - 1))
                at = None
            if tag == BEGIN or tag == INSIDE and at is None:
                at = k
    return found


def _points(text: str, byte_at: list[int]) -> list[int]:
    """Code points at byte places of a text."""
    if text.isascii():
        return byte_at
    data = text.encode()
    return [len(data[:b].decode(errors="ignore")) for b in byte_at]


def _has_hex_run(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a hexadecimal run of the least length."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _HEX[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # runs that cross a border between texts are looked at by the pattern itself
    long_ = np.flatnonzero(ends - starts >= HEX_LEAST)
    out = np.zeros(len(offsets) - 1, bool)
    for s, e in zip(starts[long_], ends[long_]):
        a, b = np.searchsorted(offsets, (s, e - 1), side="right") - 1
        out[a : b + 1] = True
    return out


def _scan(column: pa.Array):
    """For each text: its spans by the plain patterns, with the slice's tokens."""
    for first, last, data, offsets in slices(column):
        hexed = _has_hex_run(data, offsets)
        plain = []
        for k in range(last - first):
            text = column[first + k].as_py() or ""
            plain.append((text, sorted(plain_spans(text) + (hex_spans(text) if hexed[k] else []))))
        yield first, plain, offsets, tokens(data, offsets)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training sequences: those around plain spans, and the first of each text."""
    for batch in batches:
        out = []
        for _, plain, offsets, (starts, ends, begin, *codes) in _scan(batch.column(0)):
            for k, (text, spans) in enumerate(plain):
                a, b = begin[k], begin[k + 1]
                tags = np.zeros(b - a, np.uint8)
                data = text.encode()
                for start, end, kind in spans:
                    if kind == 0:  # the value, not its name
                        start = ASSIGN.match(text, start).start(2)
                    low, high = len(text[:start].encode()) + offsets[k], len(text[:end].encode()) + offsets[k]
                    hit = np.flatnonzero((starts[a:b] < high) & (ends[a:b] > low))
                    tags[hit] = INSIDE
                    tags[hit[:1]] = BEGIN
                assert len(data) == offsets[k + 1] - offsets[k]
                for c in range(0, b - a, SEQUENCE):
                    part = slice(c, c + SEQUENCE)
                    if c == 0 or tags[part].any():
                        packed = np.stack([x[a:b][part] for x in codes], 1).astype(np.int16)
                        out.append((packed.tobytes(), tags[part].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["codes", "tags"])


def varied(codes: np.ndarray, tags: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A sequence with secrets of other shapes and, half the time, without the signs around them.

    Sizes, digits and cases are drawn at random, for the plain patterns know only a few.
    """
    out, hit = codes.copy(), np.flatnonzero((tags > 0) & (codes[:, 0] % 4 == _WORD) & (codes[:, 1] // 12 >= 2))
    size, share, case = (rng.choice(x, len(hit)) for x in ((3, 4, 5), (1, 2), (0, 2, 2)))
    out[hit, 1] = (size * 4 + share) * 3 + case
    out[hit, 0] = out[hit, 1] * 16 + _WORD
    keep = np.ones(len(out), bool)
    if rng.random() < 0.5:
        around = np.unique(np.clip(np.concatenate([hit - 1, hit + 1]), 0, len(out) - 1))
        keep[around[out[around, 0] % 4 == _SIGNS]] = False
    out, tags = out[keep], tags[keep]
    out[:, 2], out[:, 3] = _neighbours(out[:, 0] % 4, np.zeros(len(out), int))
    return out, tags


def fit(texts: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_sequences: int = SAMPLE_SEQUENCES):
    """Weights from a bounded sample of ``text``: half of it names a secret by name; None without a text."""
    named = F.lit(False)
    for name in (*_NAMES, "AKIA"):
        named = named | F.contains(F.col("text"), F.lit(name))

    def half(rows: DataFrame) -> DataFrame:
        """The different texts with the least hashes; what is sorted are the hashes alone, and only texts below their bound are moved."""
        n, hashed = sample_texts // 2, rows.select("text", F.xxhash64("text").alias("h"))
        bound = hashed.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
        # copies of one text have one hash
        return hashed.where(F.col("h") <= F.lit(bound)).dropDuplicates(["h"]).select("text") if bound is not None else rows.select("text")

    sample = half(texts.where(named)).unionByName(half(texts.where(~named)))
    rows = stored(sample.repartition(8).mapInArrow(_sequences, "codes binary, tags binary"))
    rows = rows.orderBy(F.xxhash64("codes"), "tags").limit(sample_sequences).collect()
    pairs = [(np.frombuffer(r["codes"], np.int16).reshape(-1, len(CODES)).astype(np.int64), np.frombuffer(r["tags"], np.uint8).astype(np.int64)) for r in rows]
    pairs = [p for p in pairs if len(p[1])]
    rng = np.random.default_rng(0)
    pairs += [varied(codes, tags, rng) for codes, tags in pairs if tags.any() for _ in range(2)]
    return train(pairs) if pairs else None


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document: kind, start, end in code points, by start and kind."""
    rows = id_and_text(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(fit(rows))  # bounded by the numbers of codes

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for first, plain, offsets, (starts, ends, begin, *codes) in _scan(batch.column(1)):
                added: dict[int, list] = {}
                for a, b in decode(tuple(codes), begin, weights.value) if weights.value is not None else []:
                    k = int(np.searchsorted(begin, a, side="right")) - 1
                    added.setdefault(k, []).append((int(starts[a] - offsets[k]), int(ends[b] - offsets[k])))
                for k, (text, spans) in enumerate(plain):
                    if k in added:
                        places = _points(text, [p for pair in added[k] for p in pair])
                        for start, end in zip(places[::2], places[1::2]):
                            if all(end <= s or e <= start for s, e, _ in spans):
                                spans = [*spans, (start, end, 3)]
                    out[first + k] = [{"kind": KINDS[kind], "start": s, "end": e} for s, e, kind in sorted(spans, key=lambda x: (x[0], x[2]))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
