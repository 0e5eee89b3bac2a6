import re

from pyspark.sql import functions as F

from tidewatch.operators.text import SIZES, key_integrity, ngram_overlap, shared_ngrams


def grams(text, n):
    w = re.findall("[a-z]+", text.lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_overlap_and_listing_against_sets(spark, folder):
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    boiler = "one shared line of boiler plate text that many many documents repeat word for word"
    texts = texts.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(boiler + ". "), "text")).otherwise(F.col("text")))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = items.unionByName(spark.createDataFrame([(10_000, boiler), (10_001, "too short"), (10_002, boiler)], items.schema))
    docs = {r.doc_id: r.text for r in texts.collect()}
    sources = {r.item_id: r.text for r in items.collect()}
    got = ngram_overlap(texts, "doc_id", "text", items, "item_id", "text").collect()
    known = {n: set().union(*(grams(t, n) for t in sources.values())) for n in SIZES}
    assert len(got) == len(docs) * len(SIZES)
    for r in got:
        mine = grams(docs[r.doc_id], r.n)
        shared = mine & known[r.n]
        assert (r.n_grams, r.n_shared) == (len(mine), len(shared))
        assert abs(r.share_pct - 100.0 * len(shared) / max(len(mine), 1)) < 1e-9
    listing = {(r.item_id, r.gram): r.n_texts for r in shared_ngrams(texts, "doc_id", "text", items, "item_id", "text").collect()}
    per_doc = [grams(t, 7) for t in docs.values()]
    expected = {}
    for i, t in sources.items():
        for g in grams(t, 7):
            k = sum(g in d for d in per_doc)
            if k:
                expected[(i, g)] = k
    assert listing == expected
    salted = shared_ngrams(texts, "doc_id", "text", items, "item_id", "text", most_known=0).collect()
    assert {(r.item_id, r.gram): r.n_texts for r in salted} == expected


def generated(node):
    """Rows that the explodes of an executed plan put out."""
    kind = node.nodeName()
    if kind == "AdaptiveSparkPlan":
        return generated(node.executedPlan())
    if "QueryStage" in kind:
        return generated(node.plan())
    below = sum(generated(node.children().apply(k)) for k in range(node.children().size()))
    return below + (node.metrics().apply("numOutputRows").value() if kind.startswith("Generate") else 0)


def test_places_and_not_ngrams_are_exploded(spark):
    letters = str.maketrans("0123456789", "qzxjkvwbpf")
    plain = {k: " ".join(str(k * 1000 + i).translate(letters) for i in range(200)) for k in range(1, 40)}
    line = "the same line of some eight words again "
    odd = {100: line * 5, 101: None, 102: "", 103: "two words", 104: plain[7] + ". " + line * 3, 105: line[:-1], 106: "\u212Aelvin one two three four five \u0130t six"}
    texts = spark.createDataFrame([*{**plain, **odd}.items()], "id long, text string")
    sources = spark.createDataFrame([(1, line + line), (2, "one two three four five i"), (3, None)], "item long, text string")
    known = {n: grams(line + line, n) for n in SIZES}
    got = ngram_overlap(texts, "id", "text", sources, "item", "text")
    rows = got.collect()
    assert generated(got._jdf.queryExecution().executedPlan()) < 1.5 * 200 * len(plain)
    found = {(r.id, r.n): (r.n_grams, r.n_shared) for r in rows}
    assert len(rows) == len(SIZES) * len(plain | odd)
    for k, text in {**plain, **odd}.items():
        if k != 106:  # Spark's lower() makes a k of the Kelvin sign and leaves a dot behind the i
            assert all(found[k, n] == (len(mine := grams(text or "", n)), len(mine & known[n])) for n in SIZES)
    assert found[106, 6] == (4, 1) and found[106, 10] == (0, 0)
    by_salt = ngram_overlap(texts, "id", "text", sources, "item", "text", most_known=0).collect()
    assert sorted(by_salt) == sorted(rows)


def test_key_integrity(spark):
    mentions = spark.createDataFrame([(3, r"see \cite{b} and \cite{a}"), (1, r"\cite{c} then \cite{b}"), (2, "none")], "pos int, text string")
    records = spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "k string")
    got = {r.key: (r.first_seen, r.mentions, r.status) for r in key_integrity(mentions, "pos", "text", r"\\cite\{([a-z])\}", records, "k").collect()}
    assert got == {"a": (3, 1, "matched"), "b": (1, 2, "matched"), "c": (1, 1, "no_record"), "z": (None, 0, "never_used")}
