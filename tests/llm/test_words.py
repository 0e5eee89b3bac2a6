"""Language identification, collocations and spelling variants against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute, odd
from tidewatch.llm import byte_contexts, collocations, edit_pairs, quotient_filter

SCHEMA = "doc_id long, text string, lang string"
CLASHES = "hash share bytes rank upto run letters word n id filter shard a l r w1 score form root best fixed before id1 salt".split()


def with_langs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])


ODD = [(d, t, ["en", "fr", None, ""][k % 4]) for k, (d, t) in enumerate(odd.ROWS)]


@pytest.fixture(scope="module")
def docs(spark):
    return with_langs(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return with_langs(spark, [])


# --- language identification


def coded(text):
    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", b" " + brute.low(text).encode())


def learned(texts, order, seen):
    """Followers of each context, as plain dictionaries."""
    tree = defaultdict(Counter)
    for text in texts:
        form = coded(text)
        for i in range(len(form)):
            for k in range(min(order, i) + 1):
                tree[form[i - k : i]][form[i]] += 1
    return {c: f for c, f in tree.items() if not c or sum(f.values()) >= seen}


def code_length(tree, text, order):
    form, bits = coded(text), 0.0
    for i in range(1, len(form)):
        known = [form[i - k : i] for k in range(min(order, i), -1, -1) if form[i - k : i] in tree]
        gone: set = set()
        for context in known:
            left = {b: n for b, n in tree[context].items() if b not in gone}
            whole = sum(left.values()) + len(left)
            if form[i] in left:
                bits -= math.log2(left[form[i]] / whole)
                break
            if left:
                bits -= math.log2(len(left) / whole)
            gone |= set(left)
        else:
            bits += math.log2(max(byte_contexts.SYMBOLS - len(gone), 1))
    return bits


TEXTS = {
    "de": ["Der Hund läuft über die Straße und bellt.", "Die Katze sitzt auf dem Dach, über dem Haus!", "über alles und unter allem"],
    "en": ["The dog runs over the street and barks.", "The cat sits on the roof of the house.", "over all and under all of it"],
}
PROBES = ["", " ", "der die das", "the and of", "x", "ü", "日本語", "The Straße 123 -- und the", "e" * 300, "über the house " * 40]


@pytest.mark.parametrize("order,seen", [(4, 2), (3, 1), (2, 3)])
def test_code_lengths(order, seen):
    trees = byte_contexts.grow({lang: byte_contexts.grams(pa.array(texts), order) for lang, texts in TEXTS.items()}, order, seen)
    reader = byte_contexts.Reader(trees, order)
    data = np.frombuffer("".join(PROBES).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(p.encode()) for p in PROBES]])
    got = reader.lengths(data, offsets) / byte_contexts.UNIT
    for k, lang in enumerate(trees.languages):
        tree = learned(TEXTS[lang], order, seen)
        assert np.allclose(got[k], [code_length(tree, p, order) for p in PROBES], atol=0.01)
    assert np.array_equal(got, reader.lengths(data, offsets) / byte_contexts.UNIT)  # from what it has kept


def test_code_lengths_are_of_a_distribution():
    """The probabilities of all bytes after a text sum to one: no code is wasted."""
    trees = byte_contexts.grow({"de": byte_contexts.grams(pa.array(TEXTS["de"]), 3)}, 3, 2)
    symbols = np.unique(byte_contexts._FORM).astype(np.int64)
    for state in range(len(trees.state_key)):
        if trees.kinds[0, state]:
            cost = byte_contexts.prices(trees, np.full(len(symbols), state), symbols)[0] / byte_contexts.UNIT
            assert abs(np.exp2(-cost).sum() - 1) < 1e-3


def test_languages_of_odd_rows(docs, none, spark):
    got = byte_contexts.languages(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in ODD)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in got) == Counter((d, not letters(t)) for d, t, _ in ODD)
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == brute.held(r["doc_id"], 4) for r in got)
    assert byte_contexts.languages(none).count() == 0
    unlabelled = with_langs(spark, [(d, t, None) for d, t, _ in ODD])
    assert {(r["lang_pred"], r["score"]) for r in byte_contexts.languages(unlabelled).collect()} == {("und", 0.0)}


def test_languages_use_no_label_of_the_held_out(spark):
    rows = [(k, TEXTS[lang][k % 3], lang) for k in range(60) for lang in [("de", "en")[k % 2]]]
    wrong = [(d, t, {"de": "en", "en": "de"}[lang] if brute.held(d, 4) else lang) for d, t, lang in rows]
    one, two = (sorted(map(tuple, byte_contexts.languages(with_langs(spark, r)).collect())) for r in (rows, wrong))
    assert one == two and {r[2] for r in one} == {"de", "en"}
    assert {d: r for d, _, r, *_ in one} == {d: lang for d, _, lang in rows}


def test_language_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = byte_contexts.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_sample_is_bounded(spark):
    rows = [(k, f"wort{k % 50} und der die das", "de") for k in range(400)] + [(1000 + k, f"word{k} and the of", "en") for k in range(400)]
    args = dict(mod=4, remainder=2, order=2, seen=1, size=1 << 20, id_col="doc_id", text_col="text", lang_col="lang")
    trees = byte_contexts.learn(with_langs(spark, rows), texts=10, **args)
    assert [10 * len(" word 9 and the of".replace(" 9", "")) <= t[0] <= 10 * len(" wort und der die das ") for t in trees.total] == [True, True]  # of ten texts
    few = byte_contexts.learn(with_langs(spark, rows), texts=1000, **{**args, "size": 200})
    assert all(0 < int(t[0]) <= 130 for t in few.total)


# --- quotient filters


@pytest.mark.parametrize("k,bits,shard_bits", [(1, 16, 0), (2, 16, 3), (3, 40, 0), (3, 64, 5), (2, 64, 0), (2, 48, 7)])
def test_filters_lose_nothing(k, bits, shard_bits):
    rng = np.random.default_rng(k * bits)
    want: Counter = Counter()
    filters = defaultdict(list)
    pool = rng.integers(0, 1 << min(bits, 63), (500, k), dtype=np.uint64) | (np.uint64(1 << 63) if bits == 64 else np.uint64(0))
    for _ in range(4):
        rows = pool[np.unique(rng.integers(0, 500, 300))]
        rows = np.unique(rows, axis=0)
        counts = rng.choice([1, 2, 255, 256, 257, 10**12], len(rows))
        want.update({tuple(map(int, r)): int(c) for r, c in zip(rows, counts)})
        key, counts = quotient_filter.summed(quotient_filter.permuted(list(rows.T.copy()), bits), counts)
        shard = key[0] >> np.uint64(bits - shard_bits) if shard_bits else np.zeros(len(counts), np.uint64)
        for s in np.unique(shard):
            filters[int(s)].append(quotient_filter.packed([x[shard == s] for x in key], counts[shard == s], bits, shard_bits))
    got: Counter = Counter()
    for parts in filters.values():
        key, counts = quotient_filter.merged(parts, bits, shard_bits)
        assert all(np.diff(key[0].astype(object)) >= 0)
        key = quotient_filter.permuted(key, bits, back=True)
        got.update({tuple(int(x[i]) for x in key): int(c) for i, c in enumerate(counts)})
    assert got == want


def test_filter_order_with_equal_first_numbers():
    key = [np.array([3, 3, 1, 3], np.uint64), np.array([9, 2, 5, 9], np.uint64)]
    found, counts = quotient_filter.summed(key, np.array([1, 2, 3, 4]))
    assert [x.tolist() for x in found] == [[1, 3, 3], [5, 2, 9]] and counts.tolist() == [3, 2, 5]


# --- collocations


def brute_collocations(rows, least, top, share=50):
    out = []
    by_lang = defaultdict(list)
    for _, text, lang in rows:
        by_lang["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text))]
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        kept = []
        for w, a in found.items():
            if any(len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= share * a for v, b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))  # noqa: E741
            kept.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, w, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.append((lang, rank, w.decode(), -a, l, r, n, -s))
    return out


def _talk(seed, n=400):
    rng = random.Random(seed)
    common = ["the", "of", "a", "to", "é", "ßé", "Ünd", "x" * 300]
    phrases = ["new york city", "new york", "hong kong", "a b a b a", "in spite of"]
    return [
        (k, "".join(rng.choice([*common, *phrases, f"w{rng.randint(0, 60)}"]) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " ;"]) for _ in range(30)), rng.choice(["en", "en", "en", "de", None, "und"]))
        for k in range(n)
    ]


@pytest.mark.parametrize("least,top", [(10, 2000), (2, 40), (1, 7)])
def test_collocations(spark, docs, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "SHARD_PHRASES", 2000)  # several shards
    rows = _talk(1) + (ODD if least == 10 else [])
    given = with_langs(spark, rows)
    got = [tuple(r) for r in collocations.collocations(given, least=least, top=top).collect()]
    odd.same(got, brute_collocations(rows, least, top))


def test_collocations_of_nothing(none, spark):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(with_langs(spark, [(1, None, "en"), (2, ".,;", None)])).count() == 0


def test_collocations_with_a_full_table_and_narrow_ids(spark, monkeypatch):
    """A table that says yes to everything, and codes too wide for one number, change the work and not the result."""
    rows = _talk(3, 60)
    monkeypatch.setattr(collocations, "frequent_table", lambda phrases, k: np.full(1 << (collocations.TABLE_BITS - 6), ~np.uint64(0)))
    odd.same([tuple(r) for r in collocations.collocations(with_langs(spark, rows)).collect()], brute_collocations(rows, 10, 2000))
    codes = [np.array(x) for x in ([5, 1, 5, 0], [2, 2, 2, 9], [7, 7, 7, 1])]
    for size in (10, 1 << 30, 1 << 40):
        found, counts = collocations._distinct(codes, size)
        assert Counter(dict(zip(zip(*(f.tolist() for f in found)), counts.tolist()))) == Counter({(5, 2, 7): 2, (1, 2, 7): 1, (0, 9, 1): 1})


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**15, 4 * 10**15, 5 * 10**15), (10, 10, 10), (7, 11, 13)], "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(10**6)).collect()]
    assert got == [10**6 * a * a // (l * r) for a, l, r in ((3 * 10**15, 4 * 10**15, 5 * 10**15), (10, 10, 10), (7, 11, 13))]  # noqa: E741


# --- spelling variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_variants(rows):
    counts: Counter = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, []
    near = {w: [v for v in known if one_edit(w, v)] for w in known}
    for w, n in known.items():
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 5 * n else None
    for w, n in known.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), known.get(form[w])))
    return out


def _words(seed):
    rng = random.Random(seed)
    base = ["colour", "color", "colours", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Ñandúes", "tête-à-tête", "straßenbahn", "x×÷xxxx", "separate", "z" * 90]
    variants = {w for b in base for i in range(len(b)) for w in (b[:i] + b[i + 1 :], b[:i] + rng.choice("abcé") + b[i:], b[:i] + rng.choice("abcé") + b[i + 1 :])}
    listed = sorted(set(base) | variants)
    weights = [rng.choice([1, 1, 5, 30, 200]) for _ in listed]
    return [(k, " ".join(rng.choices(listed, weights, k=60)) + rng.choice([".", "1", "日本"])) for k in range(250)]


@pytest.mark.parametrize("group_words", [20_000, 3, 1])
def test_spelling_variants(spark, group_words):
    rows = _words(4) + odd.ROWS
    got = [tuple(r) for r in edit_pairs.spelling_variants(odd.documents(spark, rows), group_words=group_words).collect()]
    want = brute_variants(rows)
    assert len({r[2] for r in want}) < len(want) and max(r[4] for r in want) > 3
    odd.same(got, want)


def test_spelling_variants_of_nothing(spark):
    assert edit_pairs.spelling_variants(odd.documents(spark, [])).count() == 0
    assert edit_pairs.spelling_variants(odd.documents(spark, [(1, None), (2, "few words here")])).count() == 0


def test_composition_finds_each_pair_once():
    words = sorted({"".join(w) for n in (3, 4) for w in itertools.product("ab", repeat=n)} | {"", "c", "acb"})
    for limit in (99, 2, 1, 0):
        found = edit_pairs.composed(words, limit)
        lcp = lambda u, v: next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), min(len(u), len(v)))
        want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if one_edit(u, v) and (len(u) < len(v) or len(u) == len(v) and i < j) and lcp(u, v) < limit}
        assert len(found) == len(set(found)) and set(found) == want


def test_acceptor_is_minimal():
    words = sorted("tap taps top tops stop stops".split())
    auto = edit_pairs.Acceptor(words)
    endings = {frozenset(w[k:] for w in words if w.startswith(v[:k])) for v in words for k in range(len(v) + 1)}
    assert len(auto.out) == len(endings) and auto.below[auto.start] == len(words)


def test_check_values():
    runs = ["", "a", "äß", "x" * 63, "x" * 64, "y" * 5000]
    data = np.frombuffer("".join(runs).encode(), np.uint8)
    ends = np.cumsum([len(r.encode()) for r in runs])
    starts = ends - [len(r.encode()) for r in runs]
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(runs))], np.uint32)
    assert edit_pairs.check_values(before, data, starts, ends).tolist() == [zlib.crc32(f"{k}:{r}".encode()) for k, r in enumerate(runs)]
