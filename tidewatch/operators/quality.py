"""Checks, repair and bookkeeping of datasets and forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import BLOCK_ROWS, at_home, index_rows, join_totals, lane, running, spread, with_totals
from tidewatch.session import cut_lineage
from tidewatch.sources.bars import WINDOW


def calendar_gaps(bar_rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per symbol: days present, days spanned, and steps longer than one day."""
    indexed = index_rows(bar_rows.select("symbol", "day"), ["symbol"], "day")
    rows = spread(indexed, before=1, block_rows=block_rows)
    rows = rows.withColumn("gap", F.datediff("day", F.lag("day").over(lane(["symbol"]))))
    longest = F.coalesce(F.max("gap"), F.lit(1))
    return at_home(rows, block_rows).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"),
        F.count_if(F.col("gap") > 1).alias("n_gaps"),
        longest.alias("longest_step"),
        (longest == 1).alias("is_contiguous"),
    )


def reconstruction_error(wide: DataFrame, count: int) -> DataFrame:
    """Largest distance between a series and the sum of its components, also as percent of range."""
    total = F.aggregate(F.array(*[f"c{j}" for j in range(count)]), F.lit(0.0), lambda acc, v: acc + v)
    off = F.abs(total - F.col("x"))
    return wide.groupBy("series_id").agg(
        F.max(off).alias("recon_max_err"),
        (F.max(off) * 100 / F.nullif(F.max("x") - F.min("x"), F.lit(0.0))).alias("recon_pct_of_range"),
        F.lit(count).cast("bigint").alias("n_components"),
    )


def zero_crossings(wide: DataFrame, count: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sign changes of every demeaned component along its series."""
    columns = [f"c{j}" for j in range(count)]
    rows = with_totals(wide, [F.avg(c).alias(f"_m_{c}") for c in columns], block_rows=block_rows)
    signs = rows.select(
        "series_id", "idx", *[F.signum(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns]
    )
    moved = spread(signs, before=1, block_rows=block_rows)
    moved = moved.withColumns({f"_p_{c}": F.lag(c).over(lane()) for c in columns})
    counted = at_home(moved, block_rows).groupBy("series_id").agg(
        *[F.count_if(F.col(c) != F.col(f"_p_{c}")).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(j).alias("comp"), F.col(c).alias("crossings")) for j, c in enumerate(columns)])
    return counted.select("series_id", F.inline(pairs))


def run_spread(series: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Largest difference between two runs of a decomposition, also as percent of range."""
    pair = first.join(second.withColumnRenamed("c", "_other"), ["series_id", "comp", "idx"])
    worst = pair.groupBy("series_id").agg(F.max(F.abs(F.col("c") - F.col("_other"))).alias("max_abs_diff"))
    ranges = series.groupBy("series_id").agg((F.max("x") - F.min("x")).alias("_range"))
    return worst.join(ranges, "series_id").select(
        "series_id",
        "max_abs_diff",
        (F.col("max_abs_diff") * 100 / F.nullif(F.col("_range"), F.lit(0.0))).alias("pct_of_range"),
    )


DATASET = ("series_id", "protocol")
PROTOCOLS = ("full_series", "walk_forward")


def window_sums(windows: DataFrame) -> DataFrame:
    """Per dataset row: components added up at every window position, and in the target.

    A row has one window per component, a fixed small number.
    """
    added = F.aggregate(
        F.slice("_ws", 2, F.size("_ws") - 1),
        F.get("_ws", F.lit(0)),
        lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b),
    )
    return (
        windows.groupBy(*DATASET, "idx")
        .agg(
            F.collect_list("w").alias("_ws"),
            F.sum("y").alias("target_sum"),
            F.max("x").alias("target"),
            F.count(F.lit(1)).alias("components"),
        )
        .withColumn("w_sum", added)
        .drop("_ws")
    )


def window_alignment(
    windows: DataFrame, series: DataFrame, window: int = WINDOW, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Whether each test window ends one row before its target (lag 0) or two (lag 1)."""
    rows = spread(series, before=window + 1, block_rows=block_rows)
    history = rows.withColumn("past", F.collect_list("x").over(lane().rowsBetween(-window - 1, -1)))
    history = at_home(history, block_rows).select("series_id", "idx", "x", "past")
    sums = window_sums(windows.where(F.col("split") == "test")).join(history, ["series_id", "idx"])

    def worst(first: int):
        past = F.slice("past", first, window)
        return F.array_max(F.zip_with("w_sum", past, lambda a, b: F.abs(a - b)))

    errors = sums.select(*DATASET, "x", worst(2).alias("e0"), worst(1).alias("e1"))
    return errors.groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("e0") <= F.col("e1")).alias("lag0"),
        F.count_if(F.col("e1") < F.col("e0")).alias("lag1"),
        (F.max(F.col("e0") / F.abs(F.col("x"))) * 100).alias("window_recon_max_pct"),
    )


def target_copy_fraction(windows: DataFrame) -> DataFrame:
    """Share of component targets identical to the last value of their own window."""
    copied = (F.col("y") == F.element_at("w", -1)).cast("int")
    return windows.where(F.col("split") == "test").groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("n"), F.avg(copied).alias("fraction")
    )


def target_agreement(windows: DataFrame, series: DataFrame) -> DataFrame:
    """Whether added-up component targets equal the series at their index.

    Tolerance: 1e-6 of the largest target, at least 1e-6.
    """
    sums = window_sums(windows.where(F.col("split") == "test"))
    pairs = sums.join(series.select("series_id", "idx", F.col("x").alias("_x")), ["series_id", "idx"], "left")
    off = F.abs(F.col("target_sum") - F.col("_x"))
    tolerance = F.greatest(F.lit(1.0), F.max(F.abs("target"))) * 1e-6
    return pairs.groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(off).alias("max_abs_diff"),
        tolerance.alias("tolerance"),
        (F.coalesce(F.max(off) <= tolerance, F.lit(False)) & (F.count("_x") == F.count(F.lit(1)))).alias("agrees"),
    )


def patch_odd_rows(delivered: DataFrame, recomputed: DataFrame, everything: bool = False) -> DataFrame:
    """Merge recomputed windows into delivered ones.

    Odd rows take the recomputed window, even rows the recomputed target (the two
    places the fault touches); ``everything`` takes both everywhere.  Rows missing on
    either side survive.
    """
    keys = [*DATASET, "comp", "idx"]
    odd = F.col("idx") % 2 == 1
    fresh = recomputed.where(F.col("split") == "test").select(
        *keys,
        (F.col("w") if everything else F.when(odd, F.col("w"))).alias("_w"),
        (F.col("y") if everything else F.when(~odd, F.col("y"))).alias("_y"),
        *[F.col(c).alias(f"_{c}") for c in ("x", "n", "test_start", "split")],
    )
    merged = delivered.where(F.col("split") == "test").join(fresh, keys, "full_outer")
    old = [F.coalesce(f"_{c}", c).alias(c) for c in ("w", "y")]
    return merged.select(*keys, *old, *[F.coalesce(c, f"_{c}").alias(c) for c in ("x", "n", "test_start", "split")])


def reproduction_difference(delivered: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Largest difference on rows the fault does not touch, relative to the series value."""
    keys = [*DATASET, "comp", "idx"]
    even = (F.col("split") == "test") & (F.col("idx") % 2 == 0)
    pair = delivered.where(even).join(
        recomputed.where(even).select(*keys, F.col("w").alias("_w")), keys
    )
    off = F.array_max(F.zip_with("w", "_w", lambda a, b: F.abs(a - b))) / F.abs(F.col("x"))
    return pair.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("n"), F.max(off).alias("max_rel_diff"))


def patch_report(delivered: DataFrame, patched: DataFrame, series: DataFrame) -> DataFrame:
    """Alignment before and after a patch; ``saved`` only when no row is left misaligned."""
    before = window_alignment(delivered, series).select(
        *DATASET, "rows", F.col("lag0").alias("lag0_before"), F.col("lag1").alias("lag1_before")
    )
    after = window_alignment(patched, series).select(
        *DATASET, F.col("lag0").alias("lag0_after"), F.col("lag1").alias("lag1_after"), "window_recon_max_pct"
    )
    targets = target_agreement(patched, series).select(*DATASET, F.col("agrees").alias("targets_agree"))
    report = before.join(after, list(DATASET)).join(targets, list(DATASET))
    return report.withColumn("saved", (F.col("lag1_after") == 0) & F.col("targets_agree"))


def manifest(windows: DataFrame, newest_left_out: Mapping[str, int] = MappingProxyType({"full_series": 1})) -> DataFrame:
    """Counts of every dataset, one row each.

    How many test windows are expected follows from the length of the series, less the newest
    rows that a protocol leaves out by design, and not from the windows that are there.
    """
    left_out = F.lit(0)
    for protocol, rows in newest_left_out.items():
        left_out = F.when(F.col("protocol") == protocol, F.lit(rows)).otherwise(left_out)
    test = F.col("split") == "test"
    first = F.col("comp") == 0
    return (
        windows.groupBy(*DATASET)
        .agg(
            F.max("n").alias("n"),
            F.max("test_start").alias("test_start"),
            (F.max("comp") + 1).alias("n_components"),
            F.count_if(first & ~test).alias("n_train_windows"),
            F.count_if(first & test).alias("n_test_windows"),
            F.min(F.when(test, F.col("idx"))).alias("test_index_first"),
            F.max(F.when(test, F.col("idx"))).alias("test_index_last"),
        )
        .withColumn("n_test_expected", (F.col("n") - F.col("test_start") - left_out).cast("bigint"))
        .withColumn("n_test_dropped", F.col("n_test_expected") - F.col("n_test_windows"))
    )


def with_patch_record(manifest_rows: DataFrame, alignment: DataFrame) -> DataFrame:
    """Add ``patch``: a struct once no window is misaligned, NULL before."""
    record = F.when(
        F.col("lag1") == 0, F.struct(F.lit("odd").alias("mode"), F.col("lag0").alias("lag0_rows_after"))
    )
    checked = alignment.select(*DATASET, record.alias("patch"))
    return manifest_rows.join(checked, list(DATASET), "left")


def ready_datasets(manifest_rows: DataFrame) -> DataFrame:
    """Datasets that may be trained on: walk-forward ones only with a patch record."""
    return manifest_rows.where((F.col("protocol") != "walk_forward") | F.col("patch").isNotNull())


def expected_datasets(series: DataFrame, protocols: Sequence[str] = PROTOCOLS) -> DataFrame:
    """Every (series, protocol) that should exist."""
    lengths = series.groupBy("series_id").agg(F.max("idx").alias("last_idx"))
    return lengths.withColumn("protocol", F.explode(F.array(*[F.lit(p) for p in protocols])))


def dataset_check(windows: DataFrame, series: DataFrame, components: int) -> DataFrame:
    """Violations per (dataset, rule); zero everywhere means the data can be used."""
    rows = windows.where(F.col("split") == "test").groupBy(*DATASET, "idx").agg(
        F.count_distinct("comp").alias("_comps"),
        F.max(F.col("x").isNull().cast("int")).alias("_null"),
        F.max("x").alias("_target"),
    )
    known = series.select("series_id", "idx", F.col("x").alias("_x"))
    checked = rows.join(known, ["series_id", "idx"], "left")
    off = F.abs(F.col("_target") - F.col("_x")) > F.abs(F.col("_target")) * 1e-5 + 1e-8
    found = checked.groupBy(*DATASET).agg(
        F.sum("_null").alias("missing_target"),
        F.count_if(F.col("_x").isNull()).alias("index_past_series"),
        F.count_if(off).alias("value_mismatch"),
        (F.max("idx") - F.min("idx") + 1 - F.count(F.lit(1))).cast("bigint").alias("not_contiguous"),
        F.sum(F.lit(components) - F.col("_comps")).cast("bigint").alias("missing_component"),
        F.lit(0).cast("bigint").alias("missing_dataset"),
    )
    all_rules = expected_datasets(series).join(found, list(DATASET), "left").withColumn(
        "missing_dataset", F.coalesce("missing_dataset", F.lit(1).cast("bigint"))
    )
    rules = (
        "missing_dataset", "missing_target", "index_past_series", "value_mismatch", "not_contiguous", "missing_component",
    )
    pairs = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0).cast("bigint")).alias("violations"))
            for r in rules
        ]
    )
    return all_rules.select(*DATASET, F.inline(pairs))


def dropped_origins(expected: DataFrame, kept: DataFrame) -> DataFrame:
    """Origins that should have been kept and were not."""
    return expected.join(kept, ["series_id", "origin"], "left_anti")


def expected_origins(series: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every test origin of every series, generated from its length and split.

    One row per series becomes one per block, those are spread over the tasks, and
    each block lists its own origins: a long series is never one array or one task.
    """
    bounds = series.groupBy("series_id").agg(F.max("train_end").alias("_a"), F.max("idx").alias("_b"))
    first, last = (F.col("_a") / block_rows).cast("int"), (F.col("_b") / block_rows).cast("int")
    blocks = bounds.withColumn("block", F.explode(F.sequence(first, last))).repartition("series_id", "block")
    low = F.greatest(F.col("_a"), F.col("block") * block_rows)
    high = F.least(F.col("_b"), (F.col("block") + 1) * block_rows - 1)
    return blocks.select("series_id", F.explode(F.sequence(low, high)).alias("origin"))


def drop_counts(expected: DataFrame, kept: DataFrame) -> DataFrame:
    """Expected, kept and dropped origins per series."""
    marked = expected.join(kept.withColumn("_kept", F.lit(1)), ["series_id", "origin"], "left")
    return marked.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count("_kept").alias("n_kept"),
        F.count_if(F.col("_kept").isNull()).alias("n_dropped"),
    )


_WIDE = "decimal(38,0)"


def _value_hash(value: str) -> Column:
    return F.pmod(F.xxhash64(F.col(value).cast("double")), F.lit(2**31)).cast("decimal(20,0)")


def _weighted(hashed: Column, place: Column) -> Column:
    return (hashed.cast("decimal(27,0)") * place.cast("decimal(10,0)")).cast(_WIDE)


def run_prints(targets: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per run: its length, its length class (the largest power of two within it), and fingerprints of its first
    ``class_rows`` values (f, fi) and of all (g, gi): the sum of value hashes, and the sum weighted by place."""
    lengths = targets.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    class_rows = F.call_function("shiftleft", F.lit(1), F.floor(F.log2("n")).cast("int"))
    lengths = lengths.withColumns({"class_rows": class_rows, "_last_row": F.col("n") - 1})
    placed = join_totals(targets.withColumn("idx", F.col("row")), lengths, "_last_row", keys, block_rows)
    y, early = _value_hash("y"), F.col("row") < F.col("class_rows")
    total = lambda c: F.sum(c).cast(_WIDE)
    return placed.groupBy(*keys, "n", "class_rows").agg(
        total(F.when(early, y)).alias("f"), total(F.when(early, _weighted(y, F.col("row")))).alias("fi"),
        total(y).alias("g"), total(_weighted(y, F.col("row"))).alias("gi"),
    )


def recover_index(targets: DataFrame, series: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Find where a run of target values lies in its series.

    ``targets`` holds ``(keys, row, y)`` with rows 0..m-1.  Every place of a series gets a fingerprint of the
    values from there on, for each length class that its runs have (powers of two, so few): the difference of two
    running sums, shifted so that it does not depend on the place.  Runs meet places by equality of
    series, class and fingerprint; no run is held against places it doesn't resemble.  A place is accepted
    only if every value of the run then agrees.
    """
    hashed = _value_hash("x")
    prints = running(
        series.select("series_id", "idx", "x", hashed.cast(_WIDE).alias("_h"), _weighted(hashed, F.col("idx")).alias("_ih")),
        {"_s": ("sum", "_h"), "_si": ("sum", "_ih")},
        block_rows=block_rows,
    )
    # Written once: read as starts, as ends of the class and as ends of the run.
    prints = cut_lineage(prints.select("series_id", "idx", "x", F.col("_s").cast(_WIDE).alias("_s"), F.col("_si").cast(_WIDE).alias("_si"), "_h", "_ih"))
    runs = cut_lineage(run_prints(targets, keys, block_rows))

    lengths = prints.groupBy("series_id").agg(F.max("idx").alias("_last_idx"))
    classes = runs.groupBy("series_id").agg(F.collect_set("class_rows").alias("_classes")).join(lengths, "series_id")
    before = {"_s0": F.col("_s") - F.col("_h"), "_si0": F.col("_si") - F.col("_ih")}  # sums without the row itself
    starts = join_totals(prints.withColumns(before), classes, "_last_idx", block_rows=block_rows)
    starts = starts.select("series_id", F.col("idx").alias("_first"), "_s0", "_si0", F.explode("_classes").alias("class_rows"))
    starts = starts.withColumn("_end", F.col("_first") + F.col("class_rows") - 1)

    def ends(s: str, si: str) -> DataFrame:
        return prints.select("series_id", F.col("idx").alias("_end"), F.col("_s").alias(s), F.col("_si").alias(si))

    def fingerprint(s: str, si: str) -> tuple[Column, Column]:
        total = (F.col(s) - F.col("_s0")).cast(_WIDE)
        return total, (F.col(si) - F.col("_si0") - _weighted(total, F.col("_first"))).cast(_WIDE)

    f, fi = fingerprint("_s1", "_si1")
    places = starts.join(ends("_s1", "_si1"), ["series_id", "_end"]).withColumns({"f": f, "fi": fi}).drop("_end", "_s1", "_si1")
    alike = runs.join(places, ["series_id", "class_rows", "f", "fi"]).withColumn("_end", F.col("_first") + F.col("n") - 1)
    g, gi = fingerprint("_s2", "_si2")
    alike = alike.join(ends("_s2", "_si2"), ["series_id", "_end"]).where((g == F.col("g")) & (gi == F.col("gi")))

    found = alike.select(*keys, "n", "_first", (F.col("n") - 1).alias("_last_row"))
    placed = join_totals(targets.withColumn("idx", F.col("row")), found, "_last_row", keys, block_rows)
    placed = placed.withColumn("idx", F.col("_first") + F.col("row")).drop("block")
    verified = placed.join(prints.select("series_id", "idx", "x"), ["series_id", "idx"])
    return (
        verified.groupBy(*keys, "n", "_first")
        .agg(F.count_if(F.col("x") == F.col("y")).alias("matches"))
        .where(F.col("matches") == F.col("n"))
        .select(*keys, "n", F.col("_first").alias("first_index"), (F.col("_first") + F.col("n") - 1).alias("last_index"))
    )


def part_settings_check(settings: DataFrame, expected: int, columns: Sequence[str]) -> DataFrame:
    """Per dataset and model: components missing, and settings that differ between parts."""
    keys = (*DATASET, "model")
    checked = settings.groupBy(*keys).agg(
        F.count_distinct("comp").alias("n_parts"), *[F.count_distinct(c).alias(f"_{c}") for c in columns]
    )
    mixed = F.concat_ws(",", *[F.when(F.col(f"_{c}") > 1, F.lit(c)) for c in columns])
    return checked.select(
        *keys,
        "n_parts",
        (F.lit(expected) - F.col("n_parts")).alias("n_missing"),
        mixed.alias("mixed"),
        ((F.col("n_parts") < expected) | (mixed != "")).alias("refused"),
    )


def pending_units(
    datasets: DataFrame, models: Sequence[str], finished: DataFrame
) -> DataFrame:
    """Component models still to fit: one unit per (dataset, model, component), minus finished ones."""
    units = datasets.select(
        *DATASET,
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model"),
        "n_components",
    ).select(*DATASET, "model", F.explode(F.sequence(F.lit(0), F.col("n_components") - 1)).alias("comp"))
    return units.join(finished, [*DATASET, "model", "comp"], "left_anti").orderBy(
        "series_id", "model", "protocol", "comp"
    )


def sanity_verdict(forecasts: DataFrame, expected_dates: DataFrame) -> DataFrame:
    """Rules a finished run must meet: MAPE under 10 percent, index contiguous, dates as expected.

    ``expected_dates``: one row per series with the number of dates in ``expected``.
    """
    share = F.abs(F.col("y") - F.col("y_pred")) / F.greatest(F.abs(F.col("y")), F.lit(1e-8))
    seen = (
        forecasts.groupBy(*DATASET, "model")
        .agg(
            (F.avg(share) * 100).alias("_mape"),
            F.count("idx").alias("_dates"),
            (F.max("idx") - F.min("idx") + 1).alias("_span"),
        )
        .join(expected_dates, "series_id")
    )
    rules = F.array(
        F.struct(F.lit("mape").alias("rule"), F.col("_mape").alias("value"), (F.col("_mape") < 10).alias("ok")),
        F.struct(
            F.lit("dates").alias("rule"),
            F.col("_dates").cast("double").alias("value"),
            (F.col("_dates") == F.col("expected")).alias("ok"),
        ),
        F.struct(
            F.lit("index").alias("rule"),
            F.col("_span").cast("double").alias("value"),
            (F.col("_span") == F.col("_dates")).alias("ok"),
        ),
    )
    return seen.select(*DATASET, "model", F.inline(rules))


def reconcile_claims(claims: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbers as written against numbers as computed, at the written precision ``digits``."""
    pair = claims.join(computed, list(keys), "left")
    at = F.pow(F.lit(10.0), F.col("digits"))
    a, b = F.round(F.col("written") * at), F.round(F.col("computed") * at)
    return pair.withColumn("ok", F.coalesce(F.abs(a - b) < 0.5, F.lit(False)))


def run_counts(parts: DataFrame, series: DataFrame) -> DataFrame:
    """Counts quoted about a run, per dataset, with the training loss over all its parts.

    Parts are first reduced to one row per component model, so no distinct set grows
    with the length of a series.
    """
    test = F.col("split") == "test"
    e = F.when(~test, F.col("y") - F.col("p"))
    per_part = parts.groupBy(*DATASET, "model", "comp").agg(
        F.count_if(test).alias("_test"), F.sum(e * e).alias("_sq"), F.count(e).alias("_train")
    )
    counts = per_part.groupBy(*DATASET).agg(
        F.count_distinct("comp").alias("n_components"),
        F.max("_test").alias("test_days"),
        F.count_distinct("model").alias("n_models"),
        F.count(F.lit(1)).alias("n_parts"),
        F.sqrt(F.sum("_sq") / F.sum("_train")).alias("loss"),
    )
    lengths = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("observations"))
    once = F.lit(1).cast("bigint")
    return counts.join(lengths, "series_id").withColumn(
        "decompositions", F.when(F.col("protocol") == "walk_forward", F.col("test_days") + 1).otherwise(once)
    )
