"""Text overlap and key integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators.text import SIZES, key_integrity, ngram_overlap, shared_ngrams
from tidewatch.plans.registry import fragment, query, using
from tidewatch.plans.scored import rounded
from tidewatch.sources.tables import table, use_all_cores


def _grams_sql(source: str, key: str) -> str:
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(SIZES)))
    sizes = " UNION ".join(
        f"SELECT {key}, {n} AS n, concat_ws(' ', word, {', '.join(f'w{k}' for k in range(1, n))}) AS gram"
        f" FROM led WHERE w{n - 1} IS NOT NULL"
        for n in SIZES
    )
    return f"""WITH led AS MATERIALIZED (SELECT {key}, word, {leads} FROM
    (SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS i FROM
      (SELECT {key}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {source}))
    WINDOW o AS (PARTITION BY {key} ORDER BY i)) {sizes}"""


fragment("doc_grams", sql=_grams_sql("documents", "doc_id"))
fragment("item_grams", sql=_grams_sql("benchmark", "item_id"))
fragment(
    "doc_hits",
    "doc_grams",
    "item_grams",
    sql="SELECT doc_id, n, gram FROM doc_grams SEMI JOIN item_grams USING (n, gram)",
)


def documents(spark, folder):
    return use_all_cores(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "ngram_overlap",
    sql=using(
        "doc_hits",
        select=f"""SELECT d.doc_id, CAST(d.n AS INTEGER) AS n, CAST(coalesce(g.k, 0) AS INTEGER) AS n_grams,
    coalesce(h.k, 0) AS n_shared, round(coalesce(h.k, 0) * 100.0 / greatest(coalesce(g.k, 0), 1), 6) AS share_pct
    FROM (SELECT doc_id, unnest([{", ".join(map(str, SIZES))}]) AS n FROM documents) d
    LEFT JOIN (SELECT doc_id, n, count(*) AS k FROM doc_grams GROUP BY 1, 2) g USING (doc_id, n)
    LEFT JOIN (SELECT doc_id, n, count(*) AS k FROM doc_hits GROUP BY 1, 2) h USING (doc_id, n)""",
    ),
)
def ngram_overlap_q(spark, folder):
    found = ngram_overlap(
        documents(spark, folder), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text"
    )
    return rounded(found, 6)


@query(
    "ngram_listing",
    sql=using(
        "doc_hits",
        select="""SELECT item_id, gram, n_texts FROM (SELECT item_id, gram FROM item_grams WHERE n = 7)
    JOIN (SELECT gram, count(*) AS n_texts FROM doc_hits WHERE n = 7 GROUP BY 1) USING (gram)""",
    ),
)
def ngram_listing(spark, folder):
    return shared_ngrams(
        documents(spark, folder), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text"
    )


@query(
    "key_integrity",
    sql="""SELECT coalesce(u.key, r.key) AS key, first_seen, coalesce(mentions, 0) AS mentions,
    CASE WHEN r.key IS NULL THEN 'no_record' WHEN u.key IS NULL THEN 'never_used' ELSE 'matched' END AS status FROM
    (SELECT key, min(event_id) AS first_seen, count(*) AS mentions FROM
      (SELECT event_id, unnest(regexp_extract_all(props, '"k": *([0-9]+)', 1)) AS key FROM events) GROUP BY 1) u
    FULL JOIN (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS key FROM part) r ON u.key = r.key""",
)
def key_integrity_q(spark, folder):
    return key_integrity(
        table(spark, folder, "events"), "event_id", "props", '"k": *([0-9]+)', table(spark, folder, "part"), "p_partkey"
    )
