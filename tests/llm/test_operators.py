"""Every operator against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import itertools
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute, odd
from tidewatch.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    lattice,
    licenses,
    links,
    packing,
    pseudonyms,
    quality_votes,
    secret_spans,
    token_counts,
)
from tidewatch.llm.queries import vocabulary_file

RANKS, JSON, MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.documents(spark, [])


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- token counts


def test_token_counts(docs, none):
    path = vocabulary_file(RANKS)
    got = rows(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_words", "n_tokens")
    odd.same(got, brute.token_counts(odd.ROWS, token_counts.byte_vocabulary(path)))
    assert token_counts.token_counts(none, path).count() == 0


def test_automaton_on_a_small_vocabulary():
    vocabulary = [b" a", b"b", b"abc", b" ab", b"bcdx", b"cd", b"aa", b"aaa", b"aaaab"]
    auto = token_counts.build_automaton(vocabulary)
    texts = ["".join(w) for n in range(1, 7) for w in itertools.product("abcd", repeat=n)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = token_counts.piece_counts(auto, data, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [r[3] for r in brute.token_counts([(0, t) for t in texts], vocabulary)]


# --- near duplicates


@pytest.mark.parametrize("options", [{}, {"list_rows": 2, "rounds": 1}, {"frequent": 0, "rounds": 0}])
def test_near_duplicates(docs, options):
    got = rows(jaccard_join.near_duplicates(docs, **options), "doc_id", "n_shingles", "component_id")
    odd.same(got, brute.near_duplicates(odd.ROWS))


def test_near_duplicates_of_a_large_group(spark):
    """Hundreds of near copies of one text, some of them near others only."""
    base = [f"w{k}" for k in range(80)]
    many = []
    for k in range(300):
        own = list(base)
        for j in range(k % 5):
            own[(k * 7 + 16 * j) % 80] = f"x{k}{j}"
        many.append((k, " ".join(own)))
    many += [(1000 + k, f"start {k} goes on to say " + " ".join(base[:30])) for k in range(50)]
    got = rows(jaccard_join.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), list_rows=50), "doc_id", "n_shingles", "component_id")
    odd.same(got, brute.near_duplicates(many))


def test_near_stage_decides_per_text(spark):
    left = rows(jaccard_join.without_near_duplicates(odd.documents(spark, odd.NEAR_ROWS)), "doc_id", "text")
    assert sorted((d for d, _ in left), key=str) == sorted(brute.without_near_duplicates(odd.NEAR_ROWS), key=str)
    assert (7, odd.ITEM) in left and (7, odd.NEAR) not in left and left.count((8, "said twice in two rows")) == 1
    assert sum(t is not None and t.startswith(odd.LONG[:900]) for _, t in left) == 1


def check_links(spark, held, **options):
    got = rows(jaccard_join.near_links(spark.createDataFrame(held, "doc_id long, text string"), **options), "doc_id", "n_shingles", "class_id", "class_size", "n_links")
    odd.same(got, brute.near_links(held))


def test_near_links(spark):
    check_links(spark, odd.ROWS)
    check_links(spark, [(k, f"nothing in common {k} " * 3) for k in range(5)])
    assert jaccard_join.near_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("part", [256, 20, 1])
def test_near_links_of_a_large_group(spark, part):
    """Every link of a group of near copies, copies of them included, whatever is already in one component."""
    many = []
    for k in range(120):
        own = [f"w{j}" for j in range(80)]
        for j in range(k % 5):
            own[(k * 7 + 16 * j) % 80] = f"x{k}{j}"
        many.append((k, " ".join(own)))
    check_links(spark, many + [(500 + k, many[k % 7][1].upper()) for k in range(20)] + [(3, many[9][1]), (None, many[9][1])], part=part, list_rows=50)


def test_texts_of_one_id_are_one_node(spark):
    """Their sets' nodes differ: one is also another row's text."""
    held = [(1, odd.PASSAGE), (5, odd.ITEM), (9, odd.PASSAGE), (9, odd.ITEM), (9, " "), (4, "something else")]
    got = rows(jaccard_join.near_duplicates(spark.createDataFrame(held, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    odd.same(got, brute.near_duplicates(held))


def test_near_duplicates_of_nothing(none):
    assert jaccard_join.near_duplicates(none).count() == 0


def test_near_duplicates_keeps_one(docs):
    kept = jaccard_join.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert 1 in left and not left & {2, 3}


def test_only_texts_of_close_pairs_are_fetched(spark, monkeypatch):
    """Sixty texts share a line each with another and are otherwise different; two are near copies. Without counters shared shingles are posted too."""
    held = [(k, " ".join(f"w{k}x{j}" for j in range(40)) + f" one line that texts share number {k // 2} of thirty") for k in range(60)]
    held += [(100 + k, " ".join(f"near{j}" for j in range(60)) + f" end {k}") for k in range(2)]
    fetched = []
    keep = jaccard_join.stored

    def noted(df):
        table = keep(df)
        if "text" in table.columns:
            fetched.append(table)
        return table

    monkeypatch.setattr(jaccard_join, "stored", noted)
    got = rows(jaccard_join.near_duplicates(spark.createDataFrame(held, "doc_id long, text string"), frequent=0), "doc_id", "n_shingles", "component_id")
    odd.same(got, brute.near_duplicates(held))
    assert sum(t.count() for t in fetched) == 2


def test_texts_come_in_small_batches(spark, monkeypatch):
    """However many rows a partition has, a task is handed few of them at once; the session keeps its own setting."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, survey = spark.conf.get(name), jaccard_join._survey

    def watched(*options):
        inner = survey(*options)
        seen.append(spark.conf.get(name))

        def run(batches):
            def few():
                for batch in batches:
                    assert batch.num_rows <= 1024
                    yield batch

            return inner(few())

        return run

    monkeypatch.setattr(jaccard_join, "_survey", watched)
    held = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert jaccard_join.near_duplicates(held).where("component_id = doc_id").count() == 3000
    assert len(seen) == 1 and int(before) > 1024 and spark.conf.get(name) == before


@pytest.fixture
def strewn(spark):
    """Shuffles have 40 partitions, however few their rows."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_are_few_files(spark, monkeypatch, strewn):
    """Tables of a few hundred rows after a shuffle; the postings and what searches the lists keep a file per task."""
    held = [(k, " ".join(f"w{k // 3}x{j}" for j in range(40)) + f" end {k}") for k in range(300)]
    files = {}
    for module in (jaccard_join, links):
        def noted(df, keep=module.stored):
            table = keep(df)
            files.setdefault(tuple(table.columns), []).append(len(table.inputFiles()))
            return table

        monkeypatch.setattr(module, "stored", noted)
    got = rows(jaccard_join.near_duplicates(spark.createDataFrame(held, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    odd.same(got, [(k, 38, k // 3 * 3) for k in range(300)])
    small = [n for columns, counts in files.items() if "text" not in columns for n in counts]
    assert len(small) > 10 and max(n for n in small) <= 4 and max(files["u", "v"]) == 1


def test_counters_of_few_texts_are_small():
    """A task of three texts hands on some hundred counters, not all; the sums are those of plain counting."""
    made = [" ".join(f"{x}{k}" for k in range(50)) for x in "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(made), pa.array(range(3), pa.int64())], names=["id", "text", "doc"])
    for counters in (1 << 8, 1 << 22):
        *_, pieces = jaccard_join._survey(5, counters)(iter([batch]))
        assert sum(len(x) for x in pieces.column("sketch").to_pylist()) < 1000
        twice = pa.RecordBatch.from_arrays([pieces.column("k1"), pieces.column("sketch")], names=["piece", "sketch"])
        (found,) = jaccard_join._summed_pieces(counters)(iter([twice, twice]))
        held = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        got = np.frombuffer(b"".join(held[k] for k in range(jaccard_join.PIECES)), "<u4")
        own = np.concatenate([x for _, x in jaccard_join.sets_of(batch.column(1), 5)])
        np.testing.assert_array_equal(got, 2 * np.bincount(jaccard_join._counter(own, counters), minlength=counters))


@pytest.mark.parametrize("task, most", [("survey", 56), ("post", 56), ("terms", 32)])
def test_memory_of_a_task_with_long_texts(monkeypatch, task, most):
    """What arrays over 8 MB of texts take, without the texts: in MB."""
    import tracemalloc

    from tidewatch.llm import spans

    monkeypatch.setattr(spans, "_powers", spans._Powers())
    rng = np.random.default_rng(5)
    made = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 1800)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(made), pa.array(range(400), pa.int64())], names=["id", "text", "doc"])
    common = SimpleNamespace(value=np.ones(1 << 16, np.uint32))
    tracemalloc.start()
    if task == "survey":
        done = sum(b.num_rows for b in jaccard_join._survey(5, 1 << 16)(iter([batch])))
    elif task == "post":
        done = sum(b.num_rows for b in jaccard_join._postings(5, 80, common, 4096)(iter([batch])))
    else:
        done = sum(last - first for first, last, _ in quality_votes.frequencies(batch.column(1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done >= 400 and peak < most * 1_000_000


def test_quality_hands_each_text_over_once(spark, docs, monkeypatch):
    """The text goes to Python inside the row or beside it, not both; a text that is no string goes beside it."""
    marks = odd.labels(spark, [(d, int(d % 3 > 0), 0) for d in range(1, 22)])
    scores = {(r["doc_id"], r["score"]) for r in quality_votes.quality_scores(docs, marks).collect()}
    kept = quality_votes.without_rejected(docs, marks, threshold=0.5)
    assert "coalesce" not in kept._jdf.queryExecution().analyzed().toString().split("MapInArrow")[1]
    want = sorted((str(d) for d, s in scores if s >= 0.5))
    assert sorted({str(r["doc_id"]) for r in kept.collect()}) == sorted(set(want))
    raw = docs.withColumn("text", F.col("text").cast("binary"))
    assert sorted({str(r["doc_id"]) for r in quality_votes.without_rejected(raw, marks, threshold=0.5).collect()}) == sorted(set(want))


def test_reach_holds_for_every_link():
    """Of two linked sets, some list holds both within reach of each other; and reach leaves most others out."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        own = base[: int(rng.integers(90, 121))]
        for j in rng.integers(0, len(own), rng.integers(0, 4)):
            own[j] = f"x{k}y{j}"
        texts.append(" ".join(own))
    common = SimpleNamespace(value=rng.integers(0, 5, 256).astype(np.uint32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    posts = [r for b in jaccard_join._postings(5, 80, common, 4096)(iter([batch])) for r in b.to_pylist()]
    sets = {jaccard_join._key(own)[0]: set(own.tolist()) for _, own in jaccard_join.sets_of(batch.column(1), 5)}
    lists = {}
    for r in posts:
        assert r["n"] == len(sets[r["k1"]])
        lists.setdefault(r["shingle"], []).append(r)
    near = {frozenset((x["k1"], y["k1"])) for held in lists.values() for x, y in itertools.combinations(held, 2) if x["n"] <= y["reach"] and y["n"] <= x["reach"]}
    links = {frozenset((x, y)) for x, y in itertools.combinations(sets, 2) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert links and links <= near < {frozenset(p) for p in itertools.combinations(sets, 2)}


def test_lists_left_open_are_named():
    """A list is named when it holds close pairs beside those of nearest members; with none or one it is not."""
    base = np.arange(100, dtype=np.uint64) * np.uint64(11400714819323198485)
    near = [np.sort(np.concatenate([base, [np.uint64(k + 1)]])) for k in range(4)]
    other = np.sort(base ^ np.uint64(0x5555555555555555))
    held = [(1, near[:4]), (2, near[:2]), (3, [near[0], other])]
    table = [(shingle, 0, 0, k, k, len(own), 0, jaccard_join.odd_sketch(own)) for shingle, sets in held for k, own in enumerate(sets)]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types)], names=list("abcdefgh"))
    found = [r for b in jaccard_join._search_lists(80, True)(iter([batch])) for r in b.to_pylist()]
    assert [(r["shingle"], r["p"], r["q"]) for r in found if r["a"] is None] == [(1, 0, 0)]
    assert (0, 1) in {(r["a"], r["b"]) for r in found}


def test_sketches_bound_differences():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(11400714819323198485)) for _ in range(2))
        a, b = (np.frombuffer(jaccard_join.odd_sketch(s), np.uint8) for s in (x, y))
        assert jaccard_join._differ(a, b) <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = dict(rows(links.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert got == {k: v for k, v in parent.items() if k != v}


# --- pseudonyms


def test_pseudonyms_round_trip(docs, none):
    moved = pseudonyms.pseudonymised(docs, "key")
    back = pseudonyms.pseudonymised(moved.drop("pii"), "key", reverse=True)
    odd.same(rows(back, "doc_id", "text"), odd.ROWS)
    text = next(r["text"] for r in moved.collect() if r["doc_id"] == 15)
    assert not any(x in text for x in ("ann.1", "0199", "4111", "10.0.0.1", "2024-02-29"))
    assert pseudonyms.pseudonymised(none, "key").count() == 0


def test_pseudonyms_link_and_keep_format(spark):
    texts = ["card 4111-1111-1111-1111 x", "4111111111111111 and 4111111111111112", "2023-02-29 2024-12-31 31.12.2024 12/31/2024", "300.1.1.1 001.2.3.4 8.8.8.8 078-05-1120"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymised(df, "k").collect()}
    cards = [p["pseudonym"].replace("-", "") for d in (0, 1) for p in out[d]["pii"]]
    assert len(cards) == 2 and cards[0] == cards[1] != "4111111111111111"
    assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(cards[0])) % 10 == 0
    assert "4111111111111112" in out[1]["text"]
    assert out[2]["text"].startswith("2023-02-29 ")
    day = lambda p, y, m, d: (p[y : y + 4], p[m : m + 2], p[d : d + 2])
    a, b, c = (p["pseudonym"] for p in out[2]["pii"])
    assert day(a, 0, 5, 8) == day(b, 6, 3, 0) == day(c, 6, 0, 3)
    assert out[3]["text"].startswith("300.1.1.1 001.2.3.4 ") and [p["kind"] for p in out[3]["pii"]] == ["host", "social"]
    other = pseudonyms.pseudonymised(df, "other key").where("doc_id = 0").first()
    assert other["text"] != out[0]["text"]


@pytest.mark.parametrize("ranges", [(10, 100), (7, 3), (150, 487)])
def test_feistel_permutes(spark, ranges):
    a, b = ranges
    df = spark.range(a * b).select((F.col("id") / b).cast("long").alias("l"), (F.col("id") % b).alias("r"))
    moved = df.select(pseudonyms.feistel(F.col("l"), F.col("r"), F.lit(a), F.lit(b), "k", "t", F.lit(0)).alias("m")).select("m.*")
    assert moved.distinct().count() == a * b and moved.where(f"l < 0 or l >= {a} or r < 0 or r >= {b}").isEmpty()


# --- licenses


def test_licenses(docs, none):
    got = licenses.license_scan(docs).collect()
    pick = lambda spans: [(s["start"], s["to"], s["priority"], s["label"]) for s in spans]
    own = licenses.rules()
    assert len(own) > 200
    odd.same(
        [(r["doc_id"], r["n_words"], str(pick(r["base"])), str(pick(r["found"]))) for r in got],
        [(d, len(brute.ALNUM.findall(brute.low(t))), str(brute.phrases(t, licenses.PHRASES)), str(brute.licenses(t, own))) for d, t in odd.ROWS],
    )
    found = next(r for r in got if r["doc_id"] == 14)
    assert {"gpl-3.0-or-later", "mit", "cc-by-nc-4.0", "apache"} <= {s["label"] for s in found["found"]}
    assert licenses.license_scan(none).count() == 0


def test_every_rule_has_a_trigger_and_its_keyword():
    """A text that a rule matches has a trigger word and the rule's keyword: shown on a text made from each rule."""
    import re

    for rule in licenses.rules():
        text = rule.pattern
        while re.search(r"\(\?:[^()]*\)", text):
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], text)
        text = " " + re.sub(r"(.)\?", "", text.replace("[sc]", "s").replace("[a-z]?", "")) + " "
        assert re.search(f"(?<= )(?:{rule.pattern})(?= )", text), rule
        assert rule.keyword in text, rule
        assert set(text.split()) & set(licenses.triggers()), (rule, text)


# --- exact dedup


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_copies(docs, out="verdict", every_digest=True)
    odd.same(rows(got, "doc_id", "verdict.keep_id", "verdict.group_size", "verdict.kept", "verdict.sha256"), brute.exact(odd.ROWS))
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    odd.same(rows(kept, "doc_id"), [(r[0],) for r in brute.exact(odd.ROWS) if r[3]])
    assert exact_dedup.without_copies(none).count() == 0


# --- decontamination


@pytest.mark.parametrize("items", [odd.ITEMS, odd.ITEMS[:2], []])
def test_contamination(spark, docs, none, items):
    bench = odd.benchmark(spark, items)
    found = decontaminate.contamination(docs, bench)
    got = found.select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("c"),
    )
    want = brute.contamination(odd.ROWS, items)
    odd.same(rows(got, "*"), want)
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    odd.same(rows(kept, "doc_id"), [(r[0],) for r in want if not r[5]])
    assert decontaminate.contamination(none, bench).count() == 0


# --- quality


def test_quality(spark, docs, none):
    marks = odd.labels(spark, [(d, int(d % 3 > 0), 0) for d in range(1, 22)] + [(None, 1, 0), (1, None, 0), (99, 1, 1)])
    got = quality_votes.quality_scores(docs, marks).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in odd.ROWS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == brute.held(r["doc_id"], 4) for r in got)
    assert quality_votes.quality_scores(none, marks).count() == 0
    kept = quality_votes.without_rejected(docs, odd.labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(odd.ROWS)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_votes.quality_scores(docs, marks).where("held_out").join(marks, "doc_id").collect()
    assert len(scored) > 50 and sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in scored) >= 0.95 * len(scored)


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, own, marks = unit(rng.normal(size=(60, 5))), unit(rng.normal(size=(9, 5))), rng.integers(0, 2, 60).astype(float)
    got = quality_votes.votes(own, known, marks, 7, 12.0)
    for x, score in zip(own, got):
        near = sorted(((float(x @ y), m) for y, m in zip(known, marks)), reverse=True)[:7]
        weights = [np.exp(12 * (c - near[0][0])) * max(c, 1e-6) for c, _ in near]
        assert score == pytest.approx(sum(w * m for w, (_, m) in zip(weights, near)) / sum(weights))


# --- likelihoods


def test_likelihoods(docs, none):
    got = rows(lattice.likelihoods(docs, vocabulary_file(MODEL)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    odd.same([r[:6] for r in got], brute.word_model(odd.ROWS))
    assert all(r[6] < 0 for r in got)
    assert lattice.likelihoods(none, vocabulary_file(MODEL)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"ba", b"bab", b"abab", b"c"]
    weight = np.log(np.random.default_rng(2).dirichlet(np.ones(len(pieces))))
    chance = dict(zip(pieces, np.exp(weight)))
    words = ["a", "ab", "abab", "babab", "cab", "ababab", "c"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    span = np.array([len(w) for w in words])
    start, times = np.cumsum(span) - span, np.arange(1, len(words) + 1)
    net = token_counts.build_trie(pieces)
    want, counts = [], np.zeros(len(pieces))
    for word, n in zip(words, times):
        ways = [(np.prod([chance[p] for p in s]), s) for s in brute.segmentations(b" " + word.encode(), chance)]
        want.append(np.log(sum(w for w, _ in ways)))
        for w, s in ways:
            for p in s:
                counts[pieces.index(p)] += n * w / np.exp(want[-1])
    assert np.allclose(lattice.word_log_probabilities(net, weight, data, start, span), want)
    assert np.allclose(lattice.expected_counts(net, weight, data, start, span, times), counts)


# --- packing


def check_packing(found, texts, size):
    """Pieces tile their documents, carry the right ids, and lie without gaps in sequences of at most ``size``."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary_file(JSON))
    by_doc, places = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, group in by_doc.items():
        expected = []
        for text in texts[doc_id]:
            ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
            start, piece = 0, 0
            while start < len(ids):
                end = min(len(ids), start + size) if piece else (len(ids) - 1) % size + 1
                expected.append((piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
                start, piece = end, piece + 1
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in group) == sorted(expected)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


@pytest.mark.parametrize("size", [1024, 16])
def test_packing(docs, none, size):
    paths = vocabulary_file(JSON), vocabulary_file(RANKS)
    texts = {}
    for d, t in odd.ROWS:
        texts.setdefault(d, []).append(t)
    found = packing.packed_documents(docs, *paths, size=size).collect()
    used = check_packing(found, texts, size)
    assert {r["doc_id"] for r in found} == set(texts)
    assert used <= 1.25 * sum(r["length"] for r in found) / size + 2
    assert packing.packed_documents(none, *paths, size=size).count() == 0


def test_memory_of_a_task_that_meets_many_words():
    import tracemalloc

    encode = packing.encoder(vocabulary_file(JSON), vocabulary_file(RANKS))
    letters = str.maketrans("0123456789", "qzxjkvwbpf")
    most = 0
    tracemalloc.start()
    for first in range(0, 300_000, 10_000):
        encode(" ".join(str(n * 7919).translate(letters) for n in range(first, first + 10_000)))
        most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert most < 48_000_000  # 300,000 different words


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = int(rng.integers(1, 30))
        counts = {int(n): int(rng.integers(0, 12)) for n in range(1, size + 1)}
        records, used, ranks = packing.plan(counts, size), {}, {n: [] for n in counts}
        for length, low, high, first, each, offset in records.tolist():
            for k in range(high - low):
                ranks[length].append(low + k)
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((r for r in rooms if r >= length), default=None)
                if fit is None:
                    rooms.append(size - length)
                else:
                    rooms[rooms.index(fit)] = fit - length
        assert len(used) == len(rooms) and sorted(used) == list(range(len(used)))


# --- secrets


def test_secrets(docs, none):
    got = secret_spans.secret_spans(docs).collect()
    base = [(r["doc_id"], str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "crf"])) for r in got]
    odd.same(base, [(d, str(brute.secrets(t))) for d, t in odd.ROWS])
    for r in got:
        spans = sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "crf")
        plain = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] != "crf"]
        assert not any(a < e and s < b for a, b in spans for s, e in plain)
    assert secret_spans.secret_spans(none).count() == 0


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        tables = [rng.normal(size=(n, 3)) * 2 for _ in range(2)]  # every place has codes of its own, so there are no ties
        step = rng.normal(size=(3, 3))
        codes = tuple(rng.permutation(n) for _ in range(2))
        score = tables[0][codes[0]] + tables[1][codes[1]]

        def value(tags):
            path = [0, *tags, 0]
            return sum(score[k, t] for k, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=n), key=value)
        spans, at = [], None
        for k, tag in enumerate([*best, 0]):
            if at is not None and tag != 2:
                spans.append((at, k - 1))
                at = None
            if tag == 1 or tag == 2 and at is None:
                at = k
        assert secret_spans.decode(codes, np.array([0, n]), (*tables, step)) == spans


def test_field_learns_and_generalises(spark):
    rng = np.random.default_rng(0)
    plain = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(40))
    token = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    texts = [(f'{plain()} token = "{token()}" {plain()}',) for _ in range(60)] + [(plain(),) for _ in range(60)]
    weights = secret_spans.fit(spark.createDataFrame(texts, "text string"))

    def found(text):
        (_, _, _, (starts, ends, begin, *codes)), *_ = secret_spans._scan(pa.array([text]))
        return [text[starts[a] : ends[b]] for a, b in secret_spans.decode(tuple(codes), begin, weights)]

    assert found("abc key: Zx81kLmQ0p29dkAAs1 and more") == ["Zx81kLmQ0p29dkAAs1"]
    assert found("plain words and a number 12345 only") == []


def test_secret_sample_counts_different_texts(spark, monkeypatch):
    """Copies don't fill the sample's places."""
    held = [(f"token = value {k} and some words",) for k in range(12)] * 30
    seen = []
    monkeypatch.setattr(secret_spans, "train", seen.extend)
    monkeypatch.setattr(secret_spans, "varied", lambda codes, tags, rng: (codes, tags[:0]))
    secret_spans.fit(spark.createDataFrame(held, "text string"), sample_texts=20)
    assert len([1 for _, tags in seen if len(tags)]) == 10
