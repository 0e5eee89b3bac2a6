"""Data checks, repair, bookkeeping and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators.blocks import at_home, lane, spread, with_totals
from tidewatch.operators.forecast import MODELS
from tidewatch.operators.quality import (
    dataset_check,
    drop_counts,
    dropped_origins,
    expected_datasets,
    expected_origins,
    manifest,
    part_settings_check,
    patch_odd_rows,
    patch_report,
    pending_units,
    ready_datasets,
    recover_index,
    reconcile_claims,
    reproduction_difference,
    sanity_verdict,
    target_agreement,
    target_copy_fraction,
    window_alignment,
    with_patch_record,
)
from tidewatch.operators.repair import repair_table
from tidewatch.operators.scoring import score
from tidewatch.plans.inputs import COMPONENTS, both_windows, delivered_windows, parts, walk
from tidewatch.plans.leakage import test_forecasts
from tidewatch.plans.registry import fragment, query, using
from tidewatch.plans.scored import rounded
from tidewatch.operators.protocols import walk_forward_windows
from tidewatch.session import shared_folder
from tidewatch.sources import sinks

DELIVERED = "walk_forward_delivered"


def three_datasets(spark, folder):
    """Both protocols and the faulty walk-forward delivery, told apart by ``protocol``."""
    faulty = delivered_windows(spark, folder).withColumn("protocol", F.lit(DELIVERED))
    return both_windows(spark, folder).unionByName(faulty)


fragment(
    "tests3",
    "wins",
    "walk_delivered",
    sql=f"""SELECT protocol, series_id, comp, idx, w, y, x, n, test_start FROM wins WHERE split = 'test'
    UNION ALL SELECT '{DELIVERED}', series_id, comp, idx, w, y, x, n, test_start FROM walk_delivered""",
)


def alignment_sql(source: str) -> str:
    """Alignment errors of every (dataset, row) by joining window positions to the series twice."""
    return f"""SELECT series_id, protocol, idx, any_value(x) AS x, max(abs(c - x0)) AS e0, max(abs(c - x1)) AS e1 FROM (
    SELECT p.series_id, p.protocol, p.idx, p.x, p.c, a.x AS x0, b.x AS x1 FROM (
      SELECT series_id, protocol, idx, any_value(x) AS x, pos, sum(v) AS c FROM (
        SELECT series_id, protocol, idx, x, unnest(w) AS v, unnest(range(30)) AS pos FROM {source}) GROUP BY 1, 2, 3, 5) p
    JOIN walk a ON a.series_id = p.series_id AND a.idx = p.idx - 30 + p.pos
    JOIN walk b ON b.series_id = p.series_id AND b.idx = p.idx - 31 + p.pos) GROUP BY 1, 2, 3"""


fragment("alignment3", "tests3", "walk", sql=alignment_sql("tests3"))


@query(
    "window_alignment",
    sql=using(
        "alignment3",
        select="""SELECT series_id, protocol, count(*) AS rows, count(*) FILTER (WHERE e0 <= e1) AS lag0,
    count(*) FILTER (WHERE e1 < e0) AS lag1, round(max(e0 / abs(x)) * 100, 6) + CAST(0 AS DOUBLE) AS window_recon_max_pct
    FROM alignment3 GROUP BY 1, 2""",
    ),
)
def window_alignment_q(spark, folder):
    return rounded(window_alignment(three_datasets(spark, folder), walk(spark, folder)), 6)


@query(
    "target_copy_fraction",
    sql=using(
        "tests3",
        select="""SELECT series_id, protocol, count(*) AS n, round(avg(CASE WHEN y = w[-1] THEN 1 ELSE 0 END), 6) AS fraction
    FROM tests3 GROUP BY 1, 2""",
    ),
)
def target_copy_fraction_q(spark, folder):
    return rounded(target_copy_fraction(three_datasets(spark, folder)), 6)


fragment(
    "agreement3",
    "tests3",
    "walk",
    sql="""SELECT series_id, protocol, count(*) AS n, max(abs(s - w.x)) AS off,
    greatest(1, max(abs(t.x))) * 1e-6 AS tolerance FROM
    (SELECT series_id, protocol, idx, sum(y) AS s, any_value(x) AS x FROM tests3 GROUP BY 1, 2, 3) t
    JOIN walk w USING (series_id, idx) GROUP BY 1, 2""",
)


@query(
    "target_agreement",
    sql=using(
        "agreement3",
        select="""SELECT series_id, protocol, n, round(off, 2) + CAST(0 AS DOUBLE) AS max_abs_diff,
    round(tolerance, 6) AS tolerance, off <= tolerance AS agrees FROM agreement3""",
    ),
)
def target_agreement_q(spark, folder):
    return rounded(target_agreement(three_datasets(spark, folder), walk(spark, folder)), 6, max_abs_diff=2)


fragment(
    "patched",
    "wins",
    "walk_delivered",
    sql="""SELECT series_id, 'walk_forward' AS protocol, comp, idx, coalesce(CASE WHEN idx % 2 = 1 THEN f.w END, d.w) AS w,
    coalesce(CASE WHEN idx % 2 = 0 THEN f.y END, d.y) AS y, coalesce(d.x, f.x) AS x
    FROM walk_delivered d FULL JOIN (SELECT * FROM wins WHERE protocol = 'walk_forward' AND split = 'test') f
    USING (series_id, comp, idx)""",
)
fragment("alignment_patched", "patched", "walk", sql=alignment_sql("patched"))


@query(
    "patch_odd_rows",
    sql=using(
        "alignment3",
        "alignment_patched",
        select=f"""SELECT series_id, 'walk_forward' AS protocol, b.rows, lag0_before, lag1_before, lag0_after, lag1_after,
    window_recon_max_pct, targets_agree, lag1_after = 0 AND targets_agree AS saved FROM
    (SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE e0 <= e1) AS lag0_before,
      count(*) FILTER (WHERE e1 < e0) AS lag1_before FROM alignment3 WHERE protocol = '{DELIVERED}' GROUP BY 1) b
    JOIN (SELECT series_id, count(*) FILTER (WHERE e0 <= e1) AS lag0_after, count(*) FILTER (WHERE e1 < e0) AS lag1_after,
      round(max(e0 / abs(x)) * 100, 6) + CAST(0 AS DOUBLE) AS window_recon_max_pct FROM alignment_patched GROUP BY 1) a USING (series_id)
    JOIN (SELECT series_id, max(abs(s - x)) <= greatest(1, max(abs(x))) * 1e-6 AS targets_agree FROM
      (SELECT series_id, idx, sum(y) AS s, any_value(x) AS x FROM patched GROUP BY 1, 2) GROUP BY 1) t USING (series_id)""",
    ),
)
def patch_odd_rows_q(spark, folder):
    rows = walk(spark, folder)
    delivered = delivered_windows(spark, folder)
    patched = patch_odd_rows(delivered, walk_forward_windows(rows))
    return rounded(patch_report(delivered, patched, rows), 6)


def _delivered_table(spark, folder):
    """The faulty delivery as a versioned table of its own."""
    root = f"{shared_folder(spark)}/delivered-{uuid.uuid4().hex}"
    sinks.replace_table(delivered_windows(spark, folder), root)
    return root


def _repaired(spark, folder, recomputed):
    """The outcome of a repair beside the alignment of what the table then holds."""
    rows, root = walk(spark, folder), _delivered_table(spark, folder)
    outcome = repair_table(root, recomputed, rows)
    held = window_alignment(sinks.read_table(spark, root), rows).select("series_id", "protocol", F.col("lag0").alias("lag0_held"), F.col("lag1").alias("lag1_held"))
    found = outcome.join(held, ["series_id", "protocol"]).select(
        "series_id", "protocol", "rows", "lag0_before", "lag1_before", "lag0_after", "lag1_after", "window_recon_max_pct", "n_reproduced",
        "targets_agree", "outcome", "version", "lag0_held", "lag1_held",
    )
    return rounded(found, 6)


def _repair_sql(outcome, version, held):
    return using(
        "alignment3",
        "alignment_patched",
        select=f"""SELECT series_id, 'walk_forward' AS protocol, b.rows, lag0_before, lag1_before, lag0_after, lag1_after,
    window_recon_max_pct, n_reproduced, targets_agree, {outcome} AS outcome, '{version}' AS version,
    CASE WHEN {held} THEN lag0_after ELSE lag0_before END AS lag0_held, CASE WHEN {held} THEN lag1_after ELSE lag1_before END AS lag1_held FROM
    (SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE e0 <= e1) AS lag0_before,
      count(*) FILTER (WHERE e1 < e0) AS lag1_before FROM alignment3 WHERE protocol = '{DELIVERED}' GROUP BY 1) b
    JOIN (SELECT series_id, count(*) FILTER (WHERE e0 <= e1) AS lag0_after, count(*) FILTER (WHERE e1 < e0) AS lag1_after,
      round(max(e0 / abs(x)) * 100, 6) + CAST(0 AS DOUBLE) AS window_recon_max_pct FROM alignment_patched GROUP BY 1) a USING (series_id)
    JOIN (SELECT series_id, max(abs(s - x)) <= greatest(1, max(abs(x))) * 1e-6 AS targets_agree FROM
      (SELECT series_id, idx, sum(y) AS s, any_value(x) AS x FROM patched GROUP BY 1, 2) GROUP BY 1) t USING (series_id)
    JOIN (SELECT series_id, count(*) FILTER (WHERE idx % 2 = 0) AS n_reproduced FROM walk_delivered GROUP BY 1) r USING (series_id)""",
    )


@query("patch_table", sql=_repair_sql("'patched'", "v000002", "true"))
def patch_table(spark, folder):
    """The delivery repaired, gated and committed; then what readers of the table see."""
    return _repaired(spark, folder, walk_forward_windows(walk(spark, folder)))


@query("patch_refused", sql=_repair_sql("CASE WHEN series_id LIKE '%High' THEN 'refused: reproduction' ELSE 'patched' END", "v000003", "series_id LIKE '%Low'"))
def patch_refused(spark, folder):
    """As ``patch_table``, with a recomputation that does not reproduce the last value of High series' even rows: those keep their rows."""
    fresh = walk_forward_windows(walk(spark, folder))
    off = F.col("series_id").endswith("_High") & (F.col("idx") % 2 == 0)
    shifted = F.transform("w", lambda v, k: F.when(k == 29, v + F.col("x") * 1e-4).otherwise(v))
    return _repaired(spark, folder, fresh.withColumn("w", F.when(off, shifted).otherwise(F.col("w"))))


@query(
    "reproduction_diff",
    sql=using(
        "wins",
        "walk_delivered",
        select="""SELECT series_id, 'walk_forward' AS protocol, count(*) AS n, round(max(off), 9) + CAST(0 AS DOUBLE) AS max_rel_diff
    FROM (SELECT d.series_id, d.comp, d.idx,
      list_max(list_transform(range(1, 31), lambda i: abs(d.w[i] - f.w[i]))) / abs(any_value(d.x)) AS off
      FROM walk_delivered d JOIN wins f ON f.protocol = 'walk_forward' AND f.split = 'test' AND f.series_id = d.series_id
      AND f.comp = d.comp AND f.idx = d.idx WHERE d.idx % 2 = 0 GROUP BY d.series_id, d.comp, d.idx, d.w, f.w) GROUP BY 1""",
    ),
)
def reproduction_diff(spark, folder):
    found = reproduction_difference(delivered_windows(spark, folder), walk_forward_windows(walk(spark, folder)))
    return rounded(found, 9)


_MANIFEST = """SELECT series_id, protocol, max(n) AS n, max(test_start) AS test_start, max(comp) + 1 AS n_components,
    count(*) FILTER (WHERE comp = 0 AND split = 'train') AS n_train_windows,
    count(*) FILTER (WHERE comp = 0 AND split = 'test') AS n_test_windows,
    min(idx) FILTER (WHERE split = 'test') AS test_index_first, max(idx) FILTER (WHERE split = 'test') AS test_index_last,
    CAST(max(idx) FILTER (WHERE split = 'test') - max(test_start) + 1 AS BIGINT) AS n_test_expected,
    CAST(max(idx) FILTER (WHERE split = 'test') - max(test_start) + 1 AS BIGINT)
      - count(*) FILTER (WHERE comp = 0 AND split = 'test') AS n_test_dropped FROM wins GROUP BY 1, 2"""


@query("dataset_manifest", sql=using("wins", select=_MANIFEST))
def dataset_manifest(spark, folder):
    return manifest(both_windows(spark, folder))


def mixed_delivery(spark, folder):
    """Full-series windows, repaired walk-forward windows for High series, faulty ones for Low."""
    high = F.col("series_id").endswith("_High")
    good = both_windows(spark, folder).where((F.col("protocol") == "full_series") | high)
    return good.unionByName(delivered_windows(spark, folder).where(~high))


fragment(
    "mixed_alignment",
    "alignment3",
    sql=f"""SELECT series_id, 'walk_forward' AS protocol, count(*) FILTER (WHERE e1 < e0) AS lag1 FROM alignment3
    WHERE (protocol = 'walk_forward' AND series_id LIKE '%High') OR (protocol = '{DELIVERED}' AND series_id LIKE '%Low')
    GROUP BY 1""",
)


@query(
    "ready_datasets",
    sql=using(
        "mixed_alignment",
        "series",
        select="""SELECT series_id, protocol, lag1 = 0 AS is_patched FROM mixed_alignment WHERE lag1 = 0
    UNION ALL SELECT DISTINCT series_id, 'full_series', true FROM series""",
    ),
)
def ready(spark, folder):
    windows = mixed_delivery(spark, folder)
    recorded = with_patch_record(manifest(windows), window_alignment(windows, walk(spark, folder)))
    return ready_datasets(recorded).select("series_id", "protocol", F.col("patch").isNotNull().alias("is_patched"))


def damaged_windows(spark, folder):
    """Test windows with one fault per dataset for the check to find."""
    s, p, idx = F.col("series_id"), F.col("protocol"), F.col("idx")
    full, walked = p == "full_series", p == "walk_forward"
    rows = both_windows(spark, folder).where(F.col("split") == "test")
    rows = rows.where(~(walked & (s == "A_Low")))
    rows = rows.where(~(full & (s == "N_High") & (F.col("comp") == 3)))
    rows = rows.where(~(walked & (s == "R_High") & idx.between(F.col("test_start") + 10, F.col("test_start") + 19)))
    lost = walked & (s == "A_High") & (idx == F.col("test_start") + 3)
    target = F.when(full & (s == "N_Low"), F.col("x") * 1.01).when(~lost, F.col("x"))
    return rows.withColumn("x", target).withColumn(
        "idx", F.when(walked & (s == "R_Low"), idx + 5).otherwise(idx)
    )


@query(
    "dataset_check",
    sql=using(
        "wins",
        "walk",
        select=f""", damaged AS (
    SELECT series_id, protocol, comp, CASE WHEN protocol = 'walk_forward' AND series_id = 'R_Low' THEN idx + 5 ELSE idx END AS idx,
      CASE WHEN protocol = 'full_series' AND series_id = 'N_Low' THEN x * CAST(1.01 AS DOUBLE)
        WHEN protocol = 'walk_forward' AND series_id = 'A_High' AND idx = test_start + 3 THEN NULL ELSE x END AS x FROM wins WHERE split = 'test'
      AND NOT (protocol = 'walk_forward' AND series_id = 'A_Low') AND NOT (protocol = 'full_series' AND series_id = 'N_High' AND comp = 3)
      AND NOT (protocol = 'walk_forward' AND series_id = 'R_High' AND idx BETWEEN test_start + 10 AND test_start + 19)),
    rows AS (SELECT d.series_id, d.protocol, d.idx, count(DISTINCT comp) AS k, any_value(d.x) AS t, any_value(w.x) AS x
      FROM damaged d LEFT JOIN walk w ON w.series_id = d.series_id AND w.idx = d.idx GROUP BY 1, 2, 3),
    found AS (SELECT series_id, protocol, count(*) AS m, count(*) FILTER (WHERE t IS NULL) AS missing_target,
      count(*) FILTER (WHERE x IS NULL) AS past, count(*) FILTER (WHERE abs(t - x) > abs(t) * 1e-5 + 1e-8) AS mismatch,
      max(idx) - min(idx) + 1 - count(*) AS gaps, sum({COMPONENTS} - k) AS missing FROM rows GROUP BY 1, 2)
    SELECT e.series_id, e.protocol, unnest(['missing_dataset', 'missing_target', 'index_past_series', 'value_mismatch',
      'not_contiguous', 'missing_component']) AS rule, unnest([CAST(m IS NULL AS BIGINT), coalesce(missing_target, 0), coalesce(past, 0),
      coalesce(mismatch, 0), CAST(coalesce(gaps, 0) AS BIGINT), CAST(coalesce(missing, 0) AS BIGINT)]) AS violations
    FROM (SELECT DISTINCT w.series_id, p.protocol FROM walk w, (VALUES ('full_series'), ('walk_forward')) p(protocol)) e
    LEFT JOIN found f USING (series_id, protocol)""",
    ),
)
def dataset_check_q(spark, folder):
    return dataset_check(damaged_windows(spark, folder), walk(spark, folder), COMPONENTS)


def depth_of_origins(spark, folder):
    """Component count per test origin: one more where the last change is unusually large."""
    rows = spread(walk(spark, folder), before=2)
    move = F.lag("x", 1).over(lane()) - F.lag("x", 2).over(lane())
    moves = at_home(rows.withColumn("move", move))
    train = F.when(F.col("idx") < F.col("train_end"), F.col("move"))
    scaled = with_totals(moves.drop("block"), [F.stddev_pop(train).alias("typical")])
    return scaled.where(F.col("idx") >= F.col("train_end")).select(
        "series_id",
        F.col("idx").alias("origin"),
        (F.lit(COMPONENTS) + (F.abs("move") > F.col("typical")).cast("int")).alias("components"),
    )


fragment(
    "depths",
    "walk",
    sql=f"""SELECT series_id, idx AS origin, CAST({COMPONENTS} + CAST(abs(move) > typical AS INTEGER) AS INTEGER) AS components FROM (
    SELECT *, stddev_pop(CASE WHEN idx < train_end THEN move END) OVER (PARTITION BY series_id) AS typical FROM (
    SELECT *, lag(x, 1) OVER o - lag(x, 2) OVER o AS move FROM walk WINDOW o AS (PARTITION BY series_id ORDER BY idx)))
    WHERE idx >= train_end""",
)


@query(
    "dropped_origins",
    sql=using("depths", select=f"SELECT series_id, origin FROM depths WHERE components <> {COMPONENTS}"),
)
def dropped_origins_q(spark, folder):
    kept = depth_of_origins(spark, folder).where(F.col("components") == COMPONENTS)
    return dropped_origins(expected_origins(walk(spark, folder)), kept.select("series_id", "origin"))


@query(
    "dropped_origin_counts",
    sql=using(
        "depths",
        select=f"""SELECT series_id, count(*) AS n_expected, count(*) FILTER (WHERE components = {COMPONENTS}) AS n_kept,
    count(*) FILTER (WHERE components <> {COMPONENTS}) AS n_dropped FROM depths GROUP BY 1""",
    ),
)
def dropped_origin_counts(spark, folder):
    kept = depth_of_origins(spark, folder).where(F.col("components") == COMPONENTS)
    return drop_counts(expected_origins(walk(spark, folder)), kept.select("series_id", "origin"))


@query(
    "recover_index",
    sql=using(
        "fc_test",
        "walk",
        select="""SELECT series_id, protocol, CAST(n AS INTEGER) AS n, CAST(o AS INTEGER) AS first_index,
    CAST(o + n - 1 AS INTEGER) AS last_index FROM (
    SELECT t.series_id, t.protocol, w.idx - t.row AS o, count(*) AS k, any_value(t.n) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id, protocol ORDER BY idx) - 1 AS row,
      count(*) OVER (PARTITION BY series_id, protocol) AS n FROM fc_test WHERE model = 'lag1') t
    JOIN walk w ON w.series_id = t.series_id AND w.x = t.y GROUP BY 1, 2, 3) WHERE k = n""",
    ),
)
def recover_index_q(spark, folder):
    """Targets whose index was lost: only the row number is kept."""
    rows = test_forecasts(spark, folder).where(F.col("model") == "lag1")
    lost = rows.select("series_id", "protocol", (F.col("idx") - F.col("test_start")).alias("row"), "y")
    return recover_index(lost, walk(spark, folder), ["series_id", "protocol"])


def part_settings(spark, folder):
    """Settings of every component model, with one odd setting and one missing part."""
    s, p, c = F.col("series_id"), F.col("protocol"), F.col("comp")
    rows = expected_datasets(walk(spark, folder)).select("series_id", "protocol", F.explode(F.sequence(F.lit(0), F.lit(COMPONENTS - 1))).alias("comp"))
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    rows = rows.where(~((s == "R_Low") & (p == "full_series") & (c == 5)))
    odd = (s == "A_High") & (p == "walk_forward") & (c == 2)
    return rows.select(
        "*",
        F.when(odd, "minmax").otherwise("last_value").alias("scaling"),
        F.when(s == "N_Low", c % 2).otherwise(F.lit(0)).alias("seed"),
    )


@query(
    "mixed_settings",
    sql=using(
        "wins",
        select=f"""SELECT series_id, protocol, model, n_parts, {COMPONENTS} - n_parts AS n_missing, mixed,
    n_parts < {COMPONENTS} OR mixed <> '' AS refused FROM (
    SELECT series_id, protocol, model, count(DISTINCT comp) AS n_parts,
    concat_ws(',', CASE WHEN count(DISTINCT CASE WHEN series_id = 'A_High' AND protocol = 'walk_forward' AND comp = 2 THEN 'minmax' ELSE 'last_value' END) > 1 THEN 'scaling' END,
      CASE WHEN count(DISTINCT CASE WHEN series_id = 'N_Low' THEN comp % 2 ELSE 0 END) > 1 THEN 'seed' END) AS mixed
    FROM (SELECT DISTINCT series_id, protocol, comp, unnest(['lag1', 'lag2']) AS model FROM wins)
    WHERE NOT (series_id = 'R_Low' AND protocol = 'full_series' AND comp = 5) GROUP BY 1, 2, 3)""",
    ),
)
def mixed_settings(spark, folder):
    return part_settings_check(part_settings(spark, folder), COMPONENTS, ["scaling", "seed"])


@query(
    "pending_units",
    sql=using(
        "mixed_alignment",
        "series",
        select=f"""SELECT series_id, protocol, model, CAST(comp AS INTEGER) AS comp FROM
    (SELECT series_id, protocol FROM mixed_alignment WHERE lag1 = 0 UNION ALL SELECT DISTINCT series_id, 'full_series' FROM series),
    (VALUES ('lag1'), ('lag2')) m(model), range({COMPONENTS}) r(comp)
    WHERE NOT (model = 'lag1' AND (protocol = 'full_series' OR comp < 3) AND NOT (series_id = 'R_Low' AND protocol = 'full_series' AND comp = 5))""",
    ),
)
def pending_units_q(spark, folder):
    """Units of datasets that may be trained on, less finished ones; a part that was lost is open again."""
    done = (F.col("model") == "lag1") & ((F.col("protocol") == "full_series") | (F.col("comp") < 3))
    finished = part_settings(spark, folder).where(done).select("series_id", "protocol", "model", "comp")
    datasets = ready(spark, folder).withColumn("n_components", F.lit(COMPONENTS))
    return pending_units(datasets, list(MODELS), finished)


@query(
    "sanity_verdict",
    sql=using(
        "fc_test",
        select="""SELECT series_id, protocol, model, unnest(['mape', 'dates', 'index']) AS rule,
    unnest([round(mape, 6), CAST(m AS DOUBLE), CAST(span AS DOUBLE)]) AS value, unnest([mape < 10, m = expected, span = m]) AS ok FROM (
    SELECT series_id, protocol, model, avg(abs(y - y_pred) / greatest(abs(y), 1e-8)) * 100 AS mape, count(*) AS m,
    max(idx) - min(idx) + 1 AS span, max(expected) AS expected FROM fc_test
    JOIN (SELECT series_id, max(n) - max(train_end) AS expected FROM series GROUP BY 1) USING (series_id) GROUP BY 1, 2, 3)""",
    ),
)
def sanity_verdict_q(spark, folder):
    expected = walk(spark, folder).groupBy("series_id").agg(
        (F.max("n") - F.max("train_end")).cast("bigint").alias("expected")
    )
    return rounded(sanity_verdict(test_forecasts(spark, folder), expected), 6)


@query(
    "reconcile_claims",
    sql=using(
        "fc_test",
        select="""SELECT series_id, protocol, model, digits, written, round(computed, 2) AS computed,
    abs(round(written * 10) - round(computed * 10)) < 0.5 AS ok FROM (
    SELECT *, 1 AS digits, round(computed, 1) + CASE WHEN series_id LIKE 'N%' THEN 1 ELSE 0 END AS written FROM (
    SELECT series_id, protocol, model, sqrt(avg((y - y_pred) ** 2)) AS computed FROM fc_test GROUP BY 1, 2, 3))""",
    ),
)
def reconcile_claims_q(spark, folder):
    """Written numbers: every RMSE at one decimal, those of one symbol out of date."""
    keys = ["series_id", "protocol", "model"]
    computed = score(test_forecasts(spark, folder), keys).select(*keys, F.col("rmse").alias("computed"))
    stale = F.when(F.col("series_id").startswith("N"), F.lit(1.0)).otherwise(F.lit(0.0))
    claims = computed.select(*keys, F.lit(1).alias("digits"), (F.round("computed", 1) + stale).alias("written"))
    return rounded(reconcile_claims(claims, computed, keys), 2)


@query(
    "run_counts",
    sql=using(
        "parts",
        "series",
        select="""SELECT series_id, protocol, observations, n_components, test_days, decompositions, n_models, n_parts, loss FROM (
    SELECT series_id, protocol, count(DISTINCT comp) AS n_components, count(DISTINCT CASE WHEN split = 'test' THEN idx END) AS test_days,
    CASE WHEN protocol = 'walk_forward' THEN count(DISTINCT CASE WHEN split = 'test' THEN idx END) + 1 ELSE 1 END AS decompositions,
    count(DISTINCT model) AS n_models, count(DISTINCT (model, comp)) AS n_parts FROM parts GROUP BY 1, 2)
    JOIN (SELECT series_id, protocol, round(sqrt(avg((y - p) ** 2)), 2) AS loss FROM parts WHERE split = 'train' GROUP BY 1, 2)
    USING (series_id, protocol) JOIN (SELECT series_id, count(*) AS observations FROM series GROUP BY 1) USING (series_id)""",
    ),
)
def run_counts_q(spark, folder):
    from tidewatch.operators.quality import run_counts

    return rounded(run_counts(parts(spark, folder), walk(spark, folder)), 2)
