"""Word-piece counts by a longest-match automaton that never builds a piece.

A trie over the vocabulary's bytes carries, for each state, a failure state and the number of
pieces that are certain once the automaton falls back to it. A word is then read once, byte by
byte: on a missing transition the count grows by the state's number and reading goes on from its
failure state. All words of a slice advance together, one byte a step, as arrays.

Greedy longest match: from each place of a word (with one space before it, as the vocabulary
has it) the longest entry is taken. Words are runs of anything but ASCII white space.

Defined cases: null and empty texts, and white space alone, have 0 words and 0 tokens; null ids stay
null; repeated rows are counted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.rows import id_and_text
from tidewatch.llm.spans import slices, word_hashes, words


def byte_vocabulary(ranks_path: str) -> list[bytes]:
    """Entries of a file of base64 tokens with ranks."""
    with open(ranks_path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


@dataclass
class Trie:
    """Transitions of the states that have any, as dense rows; row 0 is for states without."""

    row: np.ndarray  # state -> row of ``table``
    table: np.ndarray  # row x byte -> state, 0 if there is none (no transition leads to the root)
    entry: np.ndarray  # state -> index of the vocabulary entry that ends there, or -1


def build_trie(vocabulary: list[bytes]) -> Trie:
    children: list[dict[int, int]] = [{}]
    entry = [-1]
    for index, token in enumerate(vocabulary):
        state = 0
        for byte in token:
            following = children[state].get(byte)
            if following is None:
                following = children[state][byte] = len(children)
                children.append({})
                entry.append(-1)
            state = following
        entry[state] = index
    row, tables = np.zeros(len(children), np.int32), [np.zeros(256, np.int32)]
    for state, out in enumerate(children):
        if out:
            row[state] = len(tables)
            line = np.zeros(256, np.int32)
            line[list(out)] = list(out.values())
            tables.append(line)
    return Trie(row, np.stack(tables), np.array(entry, np.int32))


@dataclass
class Automaton:
    """A trie with failure states and popped-piece counts; every single byte is an entry, so no word is out of vocabulary."""

    trie: Trie
    fail: np.ndarray
    pops: np.ndarray


def build_automaton(vocabulary: list[bytes]) -> Automaton:
    known = set(vocabulary)
    trie = build_trie(sorted(known | {bytes([b]) for b in range(256)}))
    row, table, entry = trie.row, trie.table, trie.entry
    fail, pops = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
    level = [0]
    while level:
        above, level = level, []
        for state in above:
            line = table[row[state]]
            for byte in np.flatnonzero(line):
                child = line[byte]
                level.append(child)
                if entry[child] >= 0:  # a whole piece: it is popped, and reading starts again
                    fail[child], pops[child] = 0, 1
                    continue
                back, popped = fail[state], pops[state]
                while not table[row[back], byte]:
                    popped += pops[back]
                    back = fail[back]
                fail[child], pops[child] = table[row[back], byte], popped
    return Automaton(trie, fail, pops)


def piece_counts(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int = 0x20) -> np.ndarray:
    """Number of greedy pieces of each byte range, read with the byte ``lead`` before it."""
    row, table, fail, pops = auto.trie.row, auto.trie.table, auto.fail, auto.pops
    order = np.argsort(starts - ends, kind="stable")  # longest first: those still being read are a prefix
    at, length = starts[order], (ends - starts)[order]
    state = np.full(len(order), table[row[0], lead], np.int32)
    counts = np.zeros(len(order), np.int64)
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, side="left"))
        byte = data[at[:live] + step]
        following = table[row[state[:live]], byte]
        stuck = np.flatnonzero(following == 0)
        while len(stuck):
            counts[stuck] += pops[state[stuck]]
            state[stuck] = fail[state[stuck]]
            following[stuck] = table[row[state[stuck]], byte[stuck]]
            stuck = stuck[following[stuck] == 0]
        state[:live] = following
    rest = np.flatnonzero(state)
    while len(rest):
        counts[rest] += pops[state[rest]]
        state[rest] = fail[state[rest]]
        rest = rest[state[rest] > 0]
    out = np.empty(len(order), np.int64)
    out[order] = counts
    return out


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) of every whole text."""
    auto = build_automaton(byte_vocabulary(ranks_path))
    # Arrays alone, so that workers need no class to read them; bounded by the vocabulary, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast((auto.trie.row, auto.trie.table, auto.trie.entry, auto.fail, auto.pops))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *trie, fail, pops = shared.value
        auto = Automaton(Trie(*trie), fail, pops)
        for batch in batches:
            n_bytes, n_words, n_tokens = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, data, offsets in slices(batch.column(1)):
                starts, ends, begin = words(data, offsets)
                n_bytes[first:last], n_words[first:last] = np.diff(offsets), np.diff(begin)
                # equal words are read once
                _, one, same = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                sums = np.concatenate([[0], np.cumsum(piece_counts(auto, data, starts[one], ends[one])[same])])
                n_tokens[first:last] = sums[begin[1:]] - sums[begin[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (n_bytes, n_words, n_tokens))], names=["doc_id", "n_bytes", "n_words", "n_tokens"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_words long, n_tokens long")
