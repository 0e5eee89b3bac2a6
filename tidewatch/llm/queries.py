"""The thin queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_contexts, collocations, decontaminate, edit_pairs, exact_dedup, jaccard_join, lattice, licenses, packing, pseudonyms, quality_votes, secret_spans, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Place of a public vocabulary file; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def of_kind(spans: str, kind: str) -> Column:
    """How many entries of an array of structs are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.tiktoken"))


@query(
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS d, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d)
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
    FROM d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """
)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b, x.n = c AND y.n = c AS equal FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c))
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, coalesce(min(b) FILTER (WHERE equal), d.doc_id)) AS class_id,
           1 + count(b) FILTER (WHERE equal) AS class_size, count(b) AS n_links
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN e ON e.a = d.doc_id GROUP BY d.doc_id
    """
)
def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_jaccard_join's components leave out: each row's class of equal sets and how many rows it links with."""
    return jaccard_join.near_links(table(spark, sf_dir, "documents"))


#: A key for the registered query only; a user brings a secret of their own.
DEMO_KEY = "demonstration"


@query()
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)
    counts = [of_kind("pii", k) for k in pseudonyms.KINDS]
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *counts, "pii")


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.license_scan(table(spark, sf_dir, "documents"))
    labels = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.transform("found", lambda x: x["label"]))).alias("labels"),
        licenses.sureness(F.concat("base", "found")).alias("score"), F.size("found").cast("long").alias("n_found"),
    )


@query(
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), every_digest=True)
    return rows.select("doc_id", "exact.keep_id", "exact.group_size", "exact.kept", F.col("exact.sha256").alias("text_sha256"))


@query(
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, len(w[i:i + least(len(w), 13) - 1]) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS run
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw))),
    h AS (SELECT doc_id, i, dw.size AS size, item_id FROM dw JOIN bw USING (run)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """
)
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query()
def op7_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_votes.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", (F.col("score") >= quality_votes.THRESHOLD).cast("int"))


@query()
def op8_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.likelihoods(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("byte_bpe_50k.tiktoken")
    )


@query()
def op10_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [of_kind("spans", k) for k in secret_spans.KINDS]
    return rows.select("doc_id", *counts[:3], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), counts[3])


@query()
def op11_byte_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_contexts.languages(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    u AS (SELECT lang, w[i] AS w1, count(*) AS f FROM i GROUP BY 1, 2),
    b AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM i WHERE i < len(w) GROUP BY 1, 2, 3),
    t AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM i WHERE i + 1 < len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY 1),
    c AS (SELECT lang, w1 || ' ' || w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, 1 AS k FROM b JOIN u x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM u) y USING (lang, w2)
          WHERE b.f >= 10 AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND (t.w1 = b.w1 AND t.w2 = b.w2 OR t.w2 = b.w1 AND t.w3 = b.w2) AND 100 * t.f >= 50 * b.f)
          UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), t.f, x.f, y.f, 1 FROM t JOIN u x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM b) y USING (lang, w2, w3)
          UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), t.f, x.f, y.f, 2 FROM t JOIN b x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM u) y USING (lang, w3)),
    s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM m JOIN n USING (lang) WHERE cut = 1 QUALIFY rank <= 2000
    """
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE t AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
                         FROM (SELECT unnest(range(0, 256)) AS i)),
    g AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY 1, 2 HAVING length(w) >= 6),
    b AS (SELECT w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
                 lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))::BIGINT[] AS bytes FROM g),
    h AS (SELECT w, c, xor(list_reduce(bytes, lambda v, x: xor(v >> 8, tab[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
    v AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(c)::BIGINT AS n
          FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
    x AS (SELECT word, n, i, w FROM (SELECT word, n, i, word[:i] || word[i + 2:] AS w FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v))),
    e AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM x a JOIN x b ON a.w = b.w AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
          UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.w = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.w = v.word),
    m AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM e GROUP BY a),
    f AS (SELECT v.word, CASE WHEN best_n >= 5 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
          FROM v LEFT JOIN m USING (word)),
    r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
    """
)
def op13_edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_pairs.spelling_variants(table(spark, sf_dir, "documents"))
