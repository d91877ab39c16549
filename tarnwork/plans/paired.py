"""Paired-measurement queries on the given tables, each beside the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.functions.columns import cascade, clip, exact_binary_p, is_true, quantile_bin, usable
from tarnwork.operators import cohorts, enrichment, evaluation, inference, modelling, pairing, qc, robustness, selection
from tarnwork.operators.joins import join_null_safe
from tarnwork.operators.ranking import average_ranks, benjamini_hochberg
from tarnwork.plans import oracles
from tarnwork.plans.problems import BATCH
from tarnwork.session import stage
from tarnwork.sources.files import content_manifest
from tarnwork.sources.tables import table

LEAST_PAIRS = 10
Q = 0.05
EFFECT = 0.5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CELLS = """m as (select feature_key, sample_id, x_raw, row_number() over (partition by feature_key, sample_id order by loaded_at desc, row_id desc) as rn from measurement where x_raw > 0 and isfinite(x_raw)),
cells as (select feature_key, sample_id, cast(regexp_extract(sample_id, '([0-9]+)', 1) as bigint) as entity, upper(right(trim(sample_id), 1)) as cond, x_raw as value, log2(x_raw) as y from m where rn = 1)"""
PAIRS = (
    CELLS
    + """, two as (select feature_key, entity, max(case when cond = 'N' then y end) as n, max(case when cond = 'T' then y end) as t from cells group by all),
pairs as (select *, t - n as delta, cast(n is not null as integer) + 2 * cast(t is not null as integer) as state from two)"""
)
STATES = (
    PAIRS
    + """, size as (select count(distinct entity) as entities from cells), raw as (select feature_key, count(*) filter (state = 1) as n_only, count(*) filter (state = 2) as t_only, count(*) filter (state = 3) as "both" from pairs group by all),
states as (select *, entities - n_only - t_only - "both" as neither, n_only + t_only as discordant, (t_only - n_only) / entities as fraction_difference from raw, size)"""
)
BINOM = """case when {a} + {b} > 0 then least(1.0, 2 * (select sum(exp(lgamma({a} + {b} + 1.0) - lgamma(i + 1.0) - lgamma({a} + {b} - i + 1.0) - ({a} + {b}) * ln(2.0))) from range(0, cast(least({a}, {b}) + 1 as bigint)) r(i))) end"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the end, where engines differ in the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    return pairing.latest_cells(table(spark, d, "measurement"))


def pairs_of(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired(cells_of(spark, d))


def states_of(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_of(spark, d)
    return pairing.state_counts(pairing.paired(cells), pairing.count_entities(cells))


def q_of(p: str, source: str, family: str = "", tie: str = "feature_key", cols: str = "*") -> str:
    """SQL for the false-discovery rate of p over a CTE."""
    part = f"partition by {family}, " if family else "partition by "
    whole = f"{part}{p} is null"
    return f"""ranked as (select *, row_number() over ({whole} order by {p}, {tie}) as rk, count({p}) over ({whole}) as m_ from {source}),
    fdr as (select {cols}, case when {p} is not null then least(1.0, min({p} * m_ / rk) over ({whole} order by rk desc rows unbounded preceding)) end as q from ranked)"""


# projections, filters and contracts -------------------------------------------------------------------------------
@query("prj1_sample_ids", "select sample_id, count(*) as n, regexp_matches(sample_id, '^P[0-9]+[NT]$') as valid, try_cast(nullif(regexp_extract(sample_id, '^P([0-9]+)[NT]$', 1), '') as bigint) as entity, nullif(regexp_extract(sample_id, '^P[0-9]+([NT])$', 1), '') as cond from measurement group by all")
def prj1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "measurement").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    part = lambda g: F.nullif(F.regexp_extract("sample_id", "^P([0-9]+)([NT])$", g), F.lit(""))
    return n.select("sample_id", "n", F.col("sample_id").rlike("^P[0-9]+[NT]$").alias("valid"), part(1).try_cast("bigint").alias("entity"), part(2).alias("cond"))


@query("prj2_column_letters", "select source_column_position as position, min(source_excel_column) as letters, bool_and(source_excel_column = case when source_column_position > 26 then chr(64 + (source_column_position - 1) // 26) else '' end || chr(65 + (source_column_position - 1) % 26)) as as_expected from sample_manifest group by all")
def prj2(spark: SparkSession, d: str) -> DataFrame:
    """Spreadsheet letters of a column position against the delivered ones (up to three letters, as spreadsheets have)."""
    at = F.col("source_column_position")
    letter = lambda first, each: F.when(at >= first, F.chr(F.lit(65) + F.pmod(F.floor((at - first) / each), F.lit(26)))).otherwise("")
    letters = F.concat(letter(703, 676), letter(27, 26), letter(1, 1))
    return table(spark, d, "sample_manifest").groupBy(F.col("source_column_position").alias("position")).agg(F.min("source_excel_column").alias("letters"), F.bool_and(F.col("source_excel_column") == letters).alias("as_expected"))


@query("prj3_coercion", "select sample_id, count(try_cast(trim(run_batch) as double)) as numeric_values, count(*) filter (trim(run_batch) <> '' and try_cast(trim(run_batch) as double) is null) as failures, count(*) filter (run_batch is null or trim(run_batch) = '') as blanks from (select sample_id, regexp_replace(run_batch, '(?i)^nan$|^inf.*$', 'x') as run_batch from measurement) group by all")
def prj3(spark: SparkSession, d: str) -> DataFrame:
    text = F.trim("run_batch")
    number = text.try_cast("double")
    return table(spark, d, "measurement").groupBy("sample_id").agg(F.count(number).alias("numeric_values"), F.count_if((text != "") & number.isNull()).alias("failures"), F.count_if(F.col("run_batch").isNull() | (text == "")).alias("blanks"))


@query("prj4_surrogate_keys", "select feature_key, source_sheet, source_excel_row, printf('F%08d', row_number() over (order by source_sheet, source_excel_row, feature_key)) as surrogate from feature_manifest")
def prj4(spark: SparkSession, d: str) -> DataFrame:
    """Keys by source position: rank within a piece of a sheet (4,096 positions) plus the rows of the pieces before, so that neither
    the table nor a sheet is sorted in one task."""
    f = table(spark, d, "feature_manifest").select("feature_key", "source_sheet", "source_excel_row", F.floor(F.col("source_excel_row") / 4096).alias("piece"))
    along = Window.partitionBy(F.lit(1)).orderBy("source_sheet", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    before = f.groupBy("source_sheet", "piece").count().withColumn("before", F.coalesce(F.sum("count").over(along), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("source_sheet", "piece").orderBy("source_excel_row", "feature_key")) + F.col("before")
    return join_null_safe(f, before, ["source_sheet", "piece"]).select("feature_key", "source_sheet", "source_excel_row", F.format_string("F%08d", place).alias("surrogate"))


@query("prj5_identifier_flags", """with k as (select trim(feature_id_original) as id, count(*) as n from feature_manifest where trim(feature_id_original) <> '' group by all)
select feature_key, coalesce(trim(feature_id_original), '') = '' as missing, coalesce(n, 0) as copies, coalesce(n, 0) > 1 as duplicate, coalesce(contains(feature_id_original, ';'), false) as compound from feature_manifest left join k on k.id = trim(feature_id_original)""")
def prj5(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feature_manifest").select("feature_key", "feature_id_original", F.trim("feature_id_original").alias("id"))
    n = f.where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce("n", F.lit(0))
    return f.join(n, "id", "left").select("feature_key", (F.coalesce("id", F.lit("")) == "").alias("missing"), c.alias("copies"), (c > 1).alias("duplicate"), is_true(F.contains("feature_id_original", F.lit(";"))).alias("compound"))


@query("prj6_completeness", f"with {CELLS}, s as (select count(distinct sample_id) as samples from measurement) select f.feature_key, count(y) as observed, any_value(samples) - count(y) as missing, round(1 - count(y) / any_value(samples), 6) as missing_fraction, count(y) = 0 as all_missing from feature_manifest f left join cells using (feature_key), s group by all")
def prj6(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "measurement").agg(F.count_distinct("sample_id").alias("samples"))
    n = cells_of(spark, d).groupBy("feature_key").agg(F.count("y").alias("observed"))
    o = F.coalesce("observed", F.lit(0))
    return rounded(table(spark, d, "feature_manifest").select("feature_key").join(n, "feature_key", "left").join(F.broadcast(samples)).select("feature_key", o.alias("observed"), (F.col("samples") - o).alias("missing"), (1 - o / F.col("samples")).alias("missing_fraction"), (o == 0).alias("all_missing")))


@query("prj7_pivot_unpivot", f"with {CELLS}, w as (select feature_key, sum(case when cond = 'N' then value end) as n, sum(case when cond = 'T' then value end) as t from cells group by all) select feature_key, 'n' as side, round(n, 4) as total from w where n is not null union all select feature_key, 't', round(t, 4) from w where t is not null")
def prj7(spark: SparkSession, d: str) -> DataFrame:
    wide = cells_of(spark, d).groupBy("feature_key").pivot("cond", ["N", "T"]).agg(F.sum("value"))
    return rounded(wide.select("feature_key", F.col("N").alias("n"), F.col("T").alias("t")).unpivot("feature_key", ["n", "t"], "side", "total").where("total is not null"), 4)


@query("prj9_paired_delta", f"with {PAIRS} select feature_key, entity, round(n, 6) as n, round(t, 6) as t, round(delta, 6) as delta, state from pairs")
def prj9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs_of(spark, d))


@query("prj12_centered_delta", f"with {CELLS}, med as (select sample_id, median(y) as med from cells group by all), c as (select feature_key, entity, cond, y - med as y from cells join med using (sample_id)) select feature_key, entity, round(max(case when cond = 'T' then y end) - max(case when cond = 'N' then y end), 6) as delta from c group by all having delta is not null")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairing.paired(pairing.centered(cells_of(spark, d))).where("delta is not null").select("feature_key", "entity", "delta"))


@query("prj14_winsorised", f"with {PAIRS} select feature_key, round(avg(least(greatest(delta, -2.0), 2.0)), 6) as mean_clipped, count(*) filter (abs(delta) > 2) as beyond from pairs where delta is not null group by all")
def prj14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs_of(spark, d).where("delta is not null").groupBy("feature_key").agg(F.avg(clip(F.col("delta"), -2.0, 2.0)).alias("mean_clipped"), F.count_if(F.abs("delta") > 2).alias("beyond")))


@query("prj15_rule_cascade", f"with {PAIRS} select case when state = 3 and delta >= 1 then 'up' when state = 3 and delta <= -1 then 'down' when state = 3 then 'level' when state = 2 then 'case only' else 'baseline only' end as rule, count(*) as n from pairs group by all")
def prj15(spark: SparkSession, d: str) -> DataFrame:
    rule = cascade([((F.col("state") == 3) & (F.col("delta") >= 1), "up"), ((F.col("state") == 3) & (F.col("delta") <= -1), "down"), (F.col("state") == 3, "level"), (F.col("state") == 2, "case only")], "baseline only")
    return pairs_of(spark, d).groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("prj17_append_code", "select claim_id, count(*) as entries, string_agg(distinct limitation, ';' order by limitation) as limitations from (select claim_id, case when evidence_state = 'not_testable' then coalesce(limitation_ids, '') || ';L07' else coalesce(limitation_ids, '') end as limitation from claim_ledger) group by all")
def prj17(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("limitation_ids", F.lit(""))
    return table(spark, d, "claim_ledger").select("claim_id", F.when(is_true(F.col("evidence_state") == "not_testable"), F.concat(text, F.lit(";L07"))).otherwise(text).alias("l")).groupBy("claim_id").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_set("l")), ";").alias("limitations"))


@query("chk1_contract", "select count(*) as row_count, count(distinct row_id) = count(*) as unique_rows, count(*) filter (not regexp_matches(sample_id, '^P[0-9]+[NT]$')) as bad_samples, count(*) filter (detected and not coalesce(x_raw > 0 and isfinite(x_raw), false)) as detected_without_value, count(*) filter (x_raw <= 0 or not isfinite(x_raw)) as unusable, count(*) filter (loaded_at < acquired_at) as loaded_before_acquired, count(distinct feature_key) as features, count(distinct sample_id) as samples from measurement")
def chk1(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the measurement table in one aggregate row."""
    ok = usable("x_raw")
    return table(spark, d, "measurement").agg(F.count(F.lit(1)).alias("row_count"), (F.count_distinct("row_id") == F.count(F.lit(1))).alias("unique_rows"), F.count_if(~F.col("sample_id").rlike("^P[0-9]+[NT]$")).alias("bad_samples"), F.count_if(F.col("detected") & ~ok).alias("detected_without_value"), F.count_if(F.col("x_raw").isNotNull() & ~ok).alias("unusable"), F.count_if(F.col("loaded_at") < F.col("acquired_at")).alias("loaded_before_acquired"), F.count_distinct("feature_key").alias("features"), F.count_distinct("sample_id").alias("samples"))


@query("chk2_pair_contract", "select patient_number, count(distinct tissue_code) = 2 and count(distinct sample_id) = 2 as complete, count(*) > count(distinct sample_id) as repeated, count(distinct pair_id) as pair_ids from sample_manifest group by all")
def chk2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_manifest").groupBy("patient_number").agg(((F.count_distinct("tissue_code") == 2) & (F.count_distinct("sample_id") == 2)).alias("complete"), (F.count(F.lit(1)) > F.count_distinct("sample_id")).alias("repeated"), F.count_distinct("pair_id").alias("pair_ids"))


# joins and sets ----------------------------------------------------------------------------------------------------
@query("jn2_one_to_one", f"with {PAIRS}, mo as (select feature_key, count(delta) as pairs, avg(delta) as mean from pairs group by all) select f.feature_key, f.source_sheet, mo.pairs, round(mo.mean, 6) as mean from feature_manifest f left join mo using (feature_key)")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    """Left join with both sides' keys checked to be unique; raises when they are not."""
    left = table(spark, d, "feature_manifest").select("feature_key", "source_sheet")
    right = pairs_of(spark, d).groupBy("feature_key").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean"))
    if not left.groupBy("feature_key").count().where("count > 1").isEmpty():
        raise ValueError("feature_key is not unique")
    return rounded(left.join(right, "feature_key", "left"))


@query("jn3_many_to_one", "select f.state_id, m.feature_id_original, m.compound_identifier from fold_transformer f left join feature_manifest m using (feature_key)")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fold_transformer").select("state_id", "feature_key").join(table(spark, d, "feature_manifest").select("feature_key", "feature_id_original", "compound_identifier"), "feature_key", "left").drop("feature_key")


@query("jn4_full_outer", "with a as (select feature_key, count(*) as loadings from pca_top_loadings group by all), b as (select feature_key, count(*) as states from fold_transformer group by all) select feature_key, loadings, states from a full outer join b using (feature_key)")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pca_top_loadings").groupBy("feature_key").agg(F.count(F.lit(1)).alias("loadings"))
    return a.join(table(spark, d, "fold_transformer").groupBy("feature_key").agg(F.count(F.lit(1)).alias("states")), "feature_key", "full_outer")


@query("jn7_multi_key", "with c as (select view_name, feature_key, count(*) as folds from fold_transformer where scales > 0 group by all) select f.state_id, coalesce(c.folds, 0) as folds from fold_transformer f left join c using (view_name, feature_key)")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fold_transformer")
    c = f.where("scales > 0").groupBy("view_name", "feature_key").agg(F.count(F.lit(1)).alias("folds"))
    return f.select("state_id", "view_name", "feature_key").join(c, ["view_name", "feature_key"], "left").select("state_id", F.coalesce("folds", F.lit(0)).alias("folds"))


@query("jn9_semi_join", "select feature_key from feature_manifest where feature_key in (select feature_key from fold_transformer)")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_manifest").select("feature_key").join(table(spark, d, "fold_transformer"), "feature_key", "left_semi")


@query("jn10_anti_join", "select feature_key from feature_manifest f where not exists (select 1 from measurement m where m.feature_key = f.feature_key and m.detected)")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_manifest").select("feature_key").join(table(spark, d, "measurement").where("detected"), "feature_key", "left_anti")


@query("jn12_set_members", "with f as (select distinct feature_key from fold_transformer) select source_sheet, count(*) as members, count(f.feature_key) as selected from feature_manifest left join f using (feature_key) group by all")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "fold_transformer").select("feature_key").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "feature_manifest").join(chosen, "feature_key", "left").groupBy("source_sheet").agg(F.count(F.lit(1)).alias("members"), F.count("hit").alias("selected"))


@query("set1_union_all", "select 'loading' as origin, feature_key, count(*) as n from pca_top_loadings group by all union all select 'state', feature_key, count(*) from fold_transformer group by all")
def set1(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, t: table(spark, d, t).groupBy(F.lit(name).alias("origin"), "feature_key").agg(F.count(F.lit(1)).alias("n"))
    return of("loading", "pca_top_loadings").unionByName(of("state", "fold_transformer"))


@query("set2_symmetric_difference", "select feature_key, 'loadings' as only_in from (select feature_key from pca_top_loadings except select feature_key from fold_transformer) union all select feature_key, 'states' from (select feature_key from fold_transformer except select feature_key from pca_top_loadings)")
def set2(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "pca_top_loadings").select("feature_key"), table(spark, d, "fold_transformer").select("feature_key")
    return a.subtract(b).withColumn("only_in", F.lit("loadings")).unionByName(b.subtract(a).withColumn("only_in", F.lit("states")))


@query("set3_distinct", "select distinct sample_id, patient_number, pair_id, tissue_code from sample_manifest")
def set3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_manifest").select("sample_id", "patient_number", "pair_id", "tissue_code").distinct()


# aggregates --------------------------------------------------------------------------------------------------------
@query("agg1_paired_moments", f"with {PAIRS} select feature_key, count(delta) as pairs, round(avg(delta), 6) as mean, round(median(delta), 6) as median, round(var_samp(delta), 6) as variance, count(*) filter (delta > 0) as positive, count(*) filter (delta < 0) as negative, round(greatest(positive, negative) / nullif(positive + negative, 0), 6) as consistency from pairs group by all")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairing.moments(pairs_of(spark, d)))


@query("agg3_state_counts", f'with {STATES} select feature_key, n_only, t_only, "both", entities, neither, discordant, round(fraction_difference, 6) as fraction_difference from states')
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(states_of(spark, d))


@query("agg4_sample_quantiles", f"with {CELLS} select sample_id, round(quantile_cont(y, 0.05), 6) as p05, round(quantile_cont(y, 0.25), 6) as p25, round(median(y), 6) as p50, round(quantile_cont(y, 0.75), 6) as p75, round(quantile_cont(y, 0.95), 6) as p95 from cells group by all")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    q = cells_of(spark, d).groupBy("sample_id").agg(F.percentile("y", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"))
    return rounded(q.select("sample_id", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))]))


@query("agg6_group_aggregates", "select view_name, kind, count(*) as n, count(distinct feature_key) as features, round(min(scales), 6) as least, round(max(scales), 6) as most, round(avg(means), 6) as mean, round(stddev_samp(means), 6) as sd, bool_or(training_sample_count < 60) as small from fold_transformer group by all")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "fold_transformer").groupBy("view_name", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_key").alias("features"), F.min("scales").alias("least"), F.max("scales").alias("most"), F.avg("means").alias("mean"), F.stddev_samp("means").alias("sd"), F.bool_or(F.col("training_sample_count") < 60).alias("small")))


@query("agg8_joined_unique", "select claim_id, string_agg(distinct nullif(trim(evidence_state), ''), ';' order by nullif(trim(evidence_state), '')) as states, count(*) as entries from claim_ledger group by all")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("evidence_state"), F.lit("")))), ";")
    return table(spark, d, "claim_ledger").groupBy("claim_id").agg(F.nullif(joined, F.lit("")).alias("states"), F.count(F.lit(1)).alias("entries"))


@query("agg10_mode", "select sample_id, run_batch, n from (select sample_id, run_batch, count(*) as n, row_number() over (partition by sample_id order by count(*) desc, run_batch) as rn from measurement where run_batch is not null group by sample_id, run_batch) where rn = 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "measurement").where("run_batch is not null").groupBy("sample_id", "run_batch").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("sample_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "run_batch")).alias("b")).select("sample_id", F.col("b.run_batch").alias("run_batch"), (-F.col("b.m")).alias("n"))


@query("agg11_eligibility_curve", f"with {PAIRS}, c as (select feature_key, count(delta) as k from pairs group by all), h as (select k, count(*) as n from c group by all) select cast(k as bigint) as least_pairs, cast(sum(n) over (order by k desc) as bigint) as features from h where k > 0")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    """Features with at least k pairs, for every k that occurs: one histogram, summed from above."""
    h = pairs_of(spark, d).groupBy("feature_key").agg(F.count("delta").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k > 0")
    return h.select(F.col("k").alias("least_pairs"), F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("k"))).alias("features"))


_DECILES = f"with {CELLS}, f as (select feature_key, median(y) as level, count(*) as observed, count(*) filter (cond = 'N') as obs_n, count(*) filter (cond = 'T') as obs_t from cells group by all), e as (select list_distinct(quantile_cont(level, [0.0, .1, .2, .3, .4, .5, .6, .7, .8, .9])) as edges from f), b as (select f.*, greatest(len(list_filter(edges, lambda x: x < level)), 1) as bin from f, e)"


def deciles(spark: SparkSession, d: str) -> DataFrame:
    f = cells_of(spark, d).groupBy("feature_key").agg(F.median("y").alias("level"), F.count(F.lit(1)).alias("observed"), F.count_if(F.col("cond") == "N").alias("obs_n"), F.count_if(F.col("cond") == "T").alias("obs_t"))
    edges = f.agg(F.percentile("level", F.array(*[F.lit(i / 10) for i in range(10)])).alias("edges"))
    return f.join(F.broadcast(edges)).withColumn("bin", quantile_bin("level", F.col("edges"))).drop("edges")


@query("win3_quantile_bins", _DECILES + " select feature_key, round(level, 6) as level, bin from b")
def win3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deciles(spark, d).select("feature_key", "level", "bin"))


@query("agg12_decile_rollup", _DECILES + " select bin, count(*) as features, round(avg(observed), 6) as mean_observed, round(avg(obs_n), 6) as mean_n, round(avg(obs_t), 6) as mean_t, round(avg(obs_t) - avg(obs_n), 6) as difference from b group by all")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(deciles(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("features"), F.avg("observed").alias("mean_observed"), F.avg("obs_n").alias("mean_n"), F.avg("obs_t").alias("mean_t"), (F.avg("obs_t") - F.avg("obs_n")).alias("difference")))


@query("agg13_metric_distribution", "with u as (unpivot (select view_name, means, scales from fold_transformer) on means, scales into name metric value value) select view_name, metric, count(value) as n, round(median(value), 6) as median, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from u where isfinite(value) group by all")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "fold_transformer").select("view_name", "means", "scales").unpivot("view_name", ["means", "scales"], "metric", "value").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975)))
    return rounded(u.groupBy("view_name", "metric").agg(F.count("value").alias("n"), q.alias("q")).select("view_name", "metric", "n", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("low"), F.get("q", F.lit(2)).alias("high")))


@query("agg15_boolean_pivot", "select feature_key, coalesce(bool_or(means > 10) filter (view_name = 'abundance'), false) as abundance, coalesce(bool_or(means > 10) filter (view_name = 'combined'), false) as combined, coalesce(bool_or(means > 10) filter (view_name = 'detection'), false) as detection from fold_transformer group by all")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    views = ["abundance", "combined", "detection"]
    wide = table(spark, d, "fold_transformer").groupBy("feature_key").pivot("view_name", views).agg(F.bool_or(F.col("means") > 10))
    return wide.select("feature_key", *[is_true(F.col(v)).alias(v) for v in views])


@query("agg16_jaccard", f"with {PAIRS} select entity, count(*) filter (state = 3) as \"both\", count(*) as either, round(\"both\" / either, 6) as jaccard from pairs group by all")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs_of(spark, d).groupBy("entity").agg(F.count_if(F.col("state") == 3).alias("both"), F.count(F.lit(1)).alias("either")).withColumn("jaccard", F.col("both") / F.col("either")))


# windows and order ----------------------------------------------------------------------------------------------
_BINARY = f"{STATES}, tested as (select feature_key, n_only, t_only, {BINOM.format(a='t_only', b='n_only')} as p from states)"


@query("st6_exact_binary", f"with {_BINARY} select feature_key, n_only, t_only, round(ln(p), 6) + 0.0 as log_p from tested")
def st6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(states_of(spark, d).select("feature_key", "n_only", "t_only", (F.round(F.log(exact_binary_p("t_only", "n_only")), 6) + F.lit(0.0)).alias("log_p")))


@query("st7_detection_inference", f"with {_BINARY}, {q_of('p', 'tested')} select feature_key, n_only, t_only, round(ln(p), 6) + 0.0 as log_p, round(ln(q), 6) + 0.0 as log_q from fdr")
def st7(spark: SparkSession, d: str) -> DataFrame:
    return inference.detection_inference(states_of(spark, d)).select("feature_key", "n_only", "t_only", *[(F.round(F.log(c), 6) + F.lit(0.0)).alias(f"log_{c}") for c in ("p", "q")])


@query("win1_false_discovery", f"with {PAIRS}, sg as (select source_sheet, feature_key, count(*) filter (delta > 0) as up, count(*) filter (delta < 0) as down from pairs join feature_manifest using (feature_key) group by all), tested as (select *, {BINOM.format(a='up', b='down')} as p from sg), {q_of('p', 'tested', 'source_sheet')} select source_sheet, feature_key, up, down, round(ln(q), 6) + 0.0 as log_q from fdr")
def win1(spark: SparkSession, d: str) -> DataFrame:
    """Sign tests with one family a sheet."""
    s = pairs_of(spark, d).join(table(spark, d, "feature_manifest").select("feature_key", "source_sheet"), "feature_key").groupBy("source_sheet", "feature_key").agg(F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"))
    return benjamini_hochberg(s.withColumn("p", exact_binary_p("up", "down")), "p", "q", ["source_sheet"]).select("source_sheet", "feature_key", "up", "down", (F.round(F.log("q"), 6) + F.lit(0.0)).alias("log_q"))


@query("win2_average_rank", f"with {CELLS}, f as (select source_sheet, feature_key, count(*) as observed from cells join feature_manifest using (feature_key) group by all) select source_sheet, feature_key, observed, round((rank() over (partition by source_sheet order by observed) + (count(*) over (partition by source_sheet, observed) - 1) / 2) / count(*) over (partition by source_sheet), 6) as rank_percent from f")
def win2(spark: SparkSession, d: str) -> DataFrame:
    f = cells_of(spark, d).groupBy("feature_key").agg(F.count(F.lit(1)).alias("observed")).join(table(spark, d, "feature_manifest").select("feature_key", "source_sheet"), "feature_key")
    ranks = average_ranks(f, "observed", "rank", ["source_sheet"])
    return rounded(ranks.select("source_sheet", "feature_key", "observed", (F.col("rank") / F.col("rank_of")).alias("rank_percent")))


@query("win7_stratified_z", f"with {CELLS}, p as (select sample_id, cond, median(y) as level from cells group by all), m as (select cond, median(level) as m_ from p group by all), a as (select *, abs(level - m_) as dev from p join m using (cond)), s as (select cond, median(dev) as mad from a group by all) select sample_id, cond, round(level, 6) as level, round(case when mad > 0 then (level - m_) / (1.4826 * mad) else 0 end, 6) as z from a join s using (cond)".replace("m as (select cond", "mm as (select cond").replace("join m using", "join mm using"))
def win7(spark: SparkSession, d: str) -> DataFrame:
    p = cells_of(spark, d).groupBy("sample_id", "cond").agg(F.median("y").alias("level"))
    return rounded(qc.robust_z(p, {"level": "z"}, ["cond"]))


@query("win10_run_gaps", "with r as (select sample_id, injection, min(acquired_at) as first_at from measurement where acquired_at is not null group by all) select sample_id, injection, first_at, date_diff('second', lag(first_at) over (partition by sample_id order by injection), first_at) as gap_seconds from r")
def win10(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "measurement").where("acquired_at is not null").groupBy("sample_id", "injection").agg(F.min("acquired_at").alias("first_at"))
    last = F.lag("first_at").over(Window.partitionBy("sample_id").orderBy("injection"))
    return r.select("sample_id", "injection", "first_at", F.timestamp_diff("SECOND", last, F.col("first_at")).alias("gap_seconds"))


@query("win11_rb4_leave_one_out", f"with {PAIRS}, s as (select feature_key, count(*) as c, sum(delta) as s from pairs where delta is not null group by all having c >= 3), o as (select p.feature_key, entity, s / c as mean, c as pairs, (s - delta) / (c - 1) as w from pairs p join s using (feature_key) where delta is not null), r as (select *, row_number() over (partition by feature_key order by round(abs(w - mean), 9) desc, entity) as rn from o) select feature_key, round(any_value(mean), 6) as mean, any_value(pairs) as pairs, round(min(w), 6) as least, round(max(w), 6) as greatest, round(max(abs(w - mean)), 6) as worst_change, bool_or(sign(w) <> sign(mean)) as flips from r group by all")
def rb4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.leave_one_out(pairs_of(spark, d)).drop("worst_entity"))


@query("top1_feature_order", f"with {PAIRS} select feature_key, count(delta) as pairs, round(avg(delta), 6) as mean from pairs group by all having count(delta) > 0 order by pairs desc, abs(mean) desc, feature_key")
def top1(spark: SparkSession, d: str) -> DataFrame:
    m = rounded(pairs_of(spark, d).groupBy("feature_key").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean")).where("pairs > 0"))
    return m.orderBy(F.desc("pairs"), F.desc(F.abs("mean")), "feature_key")


@query("top4_variable_features", f"with {PAIRS} select feature_key, round(var_samp(delta), 6) as variance from pairs group by all having count(delta) >= 10 order by variance desc, feature_key desc limit 100")
def top4(spark: SparkSession, d: str) -> DataFrame:
    m = rounded(pairs_of(spark, d).groupBy("feature_key").agg(F.count("delta").alias("pairs"), F.var_samp("delta").alias("variance")).where(F.col("pairs") >= LEAST_PAIRS).drop("pairs"))
    return m.orderBy(F.desc("variance"), F.desc("feature_key")).limit(100)


# kernels and inference ------------------------------------------------------------------------------------------
_MOMENTS = "count(delta) as pairs, avg(delta) as mean, median(delta) as median, var_samp(delta) as variance, count(*) filter (delta > 0) as positive, count(*) filter (delta < 0) as negative"
_ABUNDANCE = f"""{PAIRS}, mo as (select 1 as scn, *, greatest(positive, negative) / nullif(positive + negative, 0) as consistency, pairs >= {LEAST_PAIRS} as eligible from (select feature_key, {_MOMENTS} from pairs group by all)),
{oracles.tests("mo")}, {oracles.false_discovery("tested", "abundance")}"""


@query("st5_abundance_inference", f"""with recursive {_ABUNDANCE}, {oracles.HALF} select feature_key, pairs, positive, negative, eligible, round(consistency, 6) as consistency, round(mean, 6) as mean, round(median, 6) as median, round(variance, 6) as variance,
round(d0, 4) as d0, round(s0, 6) as s0, round(posterior, 6) as posterior, round(se, 6) as se, round(moderated_t, 5) as moderated_t, round(moderated_df, 4) as moderated_df, round(ordinary_se, 6) as ordinary_se, round(ordinary_t, 5) as ordinary_t, round(p, 6) as p, round(ordinary_p, 6) as ordinary_p,
round(case when p is not null then mean - h * se end, 5) as ci_low, round(case when p is not null then mean + h * se end, 5) as ci_high, round(q, 6) as q from abundance left join half using (moderated_df)""")
def st5(spark: SparkSession, d: str) -> DataFrame:
    """Moderated paired inference of every feature."""
    digits = {"d0": 4, "moderated_df": 4, "moderated_t": 5, "ordinary_t": 5, "ci_low": 5, "ci_high": 5}
    a = inference.abundance_inference(pairs_of(spark, d), LEAST_PAIRS)
    return a.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes])


_T = f"{PAIRS}, mo as (select feature_key, count(delta) as pairs, avg(delta) as mean, var_samp(delta) as variance from pairs group by all having count(delta) >= 10 and var_samp(delta) > 0), tt as (select *, mean / sqrt(variance / pairs) as t from mo)"


@query("st2_student_p", f"""with {_T}, q as (select *, atan(abs(t) / sqrt(pairs - 1.0)) as lo, pi() / 2 - atan(abs(t) / sqrt(pairs - 1.0)) as w from tt)
select feature_key, pairs, round(t, 6) as t, round(2 / sqrt(pi()) * exp(lgamma(pairs / 2.0) - lgamma((pairs - 1) / 2.0)) * (select sum((case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(greatest(cos(lo + w * i / 2000.0), 0.0), pairs - 2.0)) * w / 6000 from range(2001) r(i)), 6) as p from q""")
def st2(spark: SparkSession, d: str) -> DataFrame:
    a = inference.abundance_inference(pairs_of(spark, d), LEAST_PAIRS)
    return rounded(a.where("eligible and ordinary_t is not null").select("feature_key", "pairs", F.col("ordinary_t").alias("t"), F.col("ordinary_p").alias("p")))


_TIERS = f"""{_ABUNDANCE}, {_BINARY.removeprefix(PAIRS).lstrip(", ")}, {oracles.false_discovery("(select 1 as scn, t.*, fraction_difference from tested_states t join states using (feature_key))", "detection")},
tiers as (select feature_key, a.mean, a.q as abundance_q, a.consistency, e.fraction_difference, e.q as detection_q, coalesce(a.q <= {Q} and abs(a.mean) >= {EFFECT}, false) as strong, coalesce(e.q <= {Q}, false) as seen, coalesce(sign(a.mean) = sign(e.fraction_difference), false) as same from abundance a full outer join detection e using (feature_key)),
tiered as (select feature_key, mean, abundance_q, consistency, fraction_difference, detection_q, case when strong and seen and same then 'A' when strong then 'B' when seen then 'C' else 'none' end as tier from tiers)""".replace("tested as (select feature_key, n_only", "tested_states as (select feature_key, n_only")


@query("st8_evidence_tiers", f"with recursive {_TIERS} select feature_key, round(mean, 6) as mean, round(abundance_q, 6) as abundance_q, round(consistency, 6) as consistency, round(fraction_difference, 6) as fraction_difference, round(detection_q + 1e-12, 6) as detection_q, tier from tiered")
def st8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(nudged(tiers_of(spark, d)))


def nudged(df: DataFrame) -> DataFrame:
    """Exact tests give fractions that lie halfway between two rounded numbers: a little is added before rounding."""
    return df.withColumn("detection_q", F.col("detection_q") + F.lit(1e-12))


def tiers_of(spark: SparkSession, d: str) -> DataFrame:
    return inference.integrate_evidence(inference.abundance_inference(pairs_of(spark, d), LEAST_PAIRS), inference.detection_inference(states_of(spark, d)), Q, EFFECT)


_RHO = f"{PAIRS}, b as (select entity, n, t from pairs where state = 3), r as (select entity, rank() over (partition by entity order by n) + (count(*) over (partition by entity, n) - 1) / 2 as rn, rank() over (partition by entity order by t) + (count(*) over (partition by entity, t) - 1) / 2 as rt from b)"


@query("st10_pair_spearman", f"with {_RHO}, rho as (select entity, corr(rn, rt) as rho from r group by all), s as (select entity, count(*) filter (state = 3) as \"both\", count(*) as either, median(abs(delta)) as median_change from pairs group by all) select entity, \"both\", either, round(median_change, 6) as median_change, round(case when isnan(rho) then null else rho end, 6) as rho, round(\"both\" / either, 6) as jaccard from s left join rho using (entity)")
def st10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(qc.pair_concordance(pairs_of(spark, d)).withColumn("rho", F.nanvl("rho", F.lit(None).cast("double"))))


_PROFILE = f"{CELLS}, fs as (select count(distinct feature_key) as features from feature_manifest), q as (select sample_id, entity, cond, count(y) as observed, quantile_cont(y, 0.01) as p01, quantile_cont(y, 0.05) as p05, quantile_cont(y, 0.25) as p25, median(y) as median, quantile_cont(y, 0.75) as p75, quantile_cont(y, 0.95) as p95, quantile_cont(y, 0.99) as p99 from cells group by all), dv as (select sample_id, abs(y - median) as away from cells join q using (sample_id)), md as (select sample_id, median(away) as mad from dv group by all), ot as (select sample_id, avg(case when mad > 0 and away > 5 * mad then 1.0 else 0.0 end) as outside from dv join md using (sample_id) group by all)"


@query("st14_sample_profile", f"with {_PROFILE} select sample_id, entity, cond, observed, round(p01, 6) as p01, round(p05, 6) as p05, round(p25, 6) as p25, round(median, 6) as median, round(p75, 6) as p75, round(p95, 6) as p95, round(p99, 6) as p99, round(p75 - p25, 6) as iqr, round(mad, 6) as mad, round(outside, 6) as outside, features, round(observed / features, 6) as observed_fraction from q join md using (sample_id) join ot using (sample_id), fs")
def st14(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "feature_manifest").agg(F.count_distinct("feature_key").alias("features"))
    return rounded(qc.sample_profiles(cells_of(spark, d), features))


_FLAGS = oracles.flags(_PROFILE, _RHO.removeprefix(CELLS).lstrip(", "))


@query("st15_sample_flags", f"with {_FLAGS} select sample_id, entity, cond, flags, flagged, pair_flagged from flagged")
def st15(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "feature_manifest").agg(F.count_distinct("feature_key").alias("features"))
    cells = cells_of(spark, d)
    return qc.flag_samples(qc.sample_profiles(cells, features), qc.pair_concordance(pairing.paired(cells)))


# enrichment -----------------------------------------------------------------------------------------------------
def ranking_of(spark: SparkSession, d: str) -> DataFrame:
    stats = pairs_of(spark, d).groupBy("feature_key").agg(F.round(F.avg("delta"), 9).alias("mean")).where("mean is not null")
    return enrichment.collapse_ranking(stats.join(table(spark, d, "feature_manifest").select("feature_key", "feature_id_original"), "feature_key"), "feature_id_original", "mean", "feature_key")


def sets_of(spark: SparkSession, d: str) -> DataFrame:
    """Sets of symbols: those of one source sheet."""
    return table(spark, d, "feature_manifest").where("feature_id_original is not null").select(F.col("source_sheet").alias("set_id"), F.trim("feature_id_original").alias("symbol"), "feature_key")


_RANKING = f"{PAIRS}, mean as (select feature_key, round(avg(delta), 9) as v from pairs group by all having avg(delta) is not null), named as (select trim(feature_id_original) as symbol, feature_key, v from mean join feature_manifest using (feature_key) where trim(feature_id_original) <> '' and not contains(feature_id_original, ';')), ranking as (select symbol, feature_key, v, members from (select *, count(*) over (partition by symbol) as members, row_number() over (partition by symbol order by abs(v) desc, feature_key) as rn from named) where rn = 1)"


@query("pw1_collapsed_ranking", f"with {_RANKING} select symbol, feature_key as key, round(v, 6) as statistic, members, row_number() over (order by v desc, symbol) as place, count(*) over () as n from ranking")
def pw1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(enrichment.ranked(ranking_of(spark, d)))


_HITS = f"""{_RANKING}, pl as (select *, row_number() over (order by v desc, symbol) as place, count(*) over () as n from ranking),
members_ as (select distinct source_sheet as set_id, trim(feature_id_original) as symbol from feature_manifest where feature_id_original is not null),
h as (select set_id, symbol, place, n, v, count(*) over (partition by set_id) as size, sum(abs(v)) over (partition by set_id) as total, row_number() over (partition by set_id order by place) as hit from members_ join pl using (symbol)),
w as (select *, case when total > 0 then abs(v) / total else 1 / size end as w from h where size between 3 and 500 and size < n),
a as (select *, sum(w) over (partition by set_id order by place) - (place - hit) / (n - size) as after from w),
s as (select set_id, size, max(after) as up, min(after - w) as down from a group by all)"""


@query("pw2_enrichment_score", f"with {_HITS} select set_id, size, round(case when abs(up) >= abs(down) then up else down end, 6) as score from s")
def pw2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(enrichment.enrichment_scores(enrichment.ranked(ranking_of(spark, d)), sets_of(spark, d), 3, 500).drop("leading"))


@query("pw3_ranked_enrichment")
def pw3(spark: SparkSession, d: str) -> DataFrame:
    places = enrichment.ranked(ranking_of(spark, d))
    return enrichment.enrichment_null(places, enrichment.enrichment_scores(places, sets_of(spark, d), 3, 500))


@query("pw5_set_sign_flip")
def pw5(spark: SparkSession, d: str) -> DataFrame:
    """Set scores of entities over the features that half of them have, with sign flips."""
    pairs = pairs_of(spark, d).where("delta is not null")
    per = pairs.groupBy("feature_key").agg(F.count(F.lit(1)).alias("c"))
    entities = per.agg(F.max("c").alias("entities"))
    return enrichment.sign_flip(enrichment.set_scores(pairs, sets_of(spark, d), entities, 1))


def complete_members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = pairs_of(spark, d).where("delta is not null")
    return pairs, sets_of(spark, d), pairs.groupBy("feature_key").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("entities"))


@query("pw4_set_scores", f"with {PAIRS}, dl as (select feature_key, entity, delta from pairs where delta is not null), per as (select feature_key, count(*) as c, median(delta) as m, stddev_samp(delta) as sd from dl group by all), whole as (select * from per where c = (select max(c) from per)), ma as (select feature_key, median(abs(delta - m)) as mad from dl join whole using (feature_key) group by all), sc as (select feature_key, entity, delta / coalesce(case when mad > 0 then mad * 1.4826 end, case when sd > 0 then sd end, 1.0) as scaled from dl join whole using (feature_key) join ma using (feature_key)), me as (select distinct source_sheet as set_id, feature_key from feature_manifest where feature_id_original is not null) select set_id, entity, round(avg(scaled), 6) as score, count(*) as features from me join sc using (feature_key) group by all")
def pw4(spark: SparkSession, d: str) -> DataFrame:
    pairs, members, entities = complete_members(spark, d)
    return rounded(enrichment.set_scores(pairs, members, entities, 1))


@query("pw6_integrated_views")
def pw6(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.integrate_views(pw3(spark, d), pw5(spark, d))


@query("pw7_leading_edges", f"with {_HITS}, top as (select set_id, min(hit) filter (after = up) as first_up, min(hit) filter (after - w = down) as first_down from a join s using (set_id, size) group by all) select set_id, symbol, round(v, 6) as statistic from a join s using (set_id, size) join top using (set_id) where case when abs(up) >= abs(down) then hit <= first_up else hit >= first_down end")
def pw7(spark: SparkSession, d: str) -> DataFrame:
    places, sets = enrichment.ranked(ranking_of(spark, d)), sets_of(spark, d)
    return rounded(enrichment.leading_edges(places, sets, enrichment.enrichment_scores(places, sets, 3, 500)))


# evaluation -----------------------------------------------------------------------------------------------------
FOLDS, REPEATS, SEED = 6, 3, 42
_FOLDS = f"fl as (select repeat, entity, cast((row_number() over (partition by repeat order by md5(entity || ':' || (repeat * 1009 + {SEED})), entity) - 1) % {FOLDS} as integer) as outer_fold from (select distinct entity from cells), (select cast(range as integer) as repeat from range({REPEATS})))"


def folds_of(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.hash_folds(cells_of(spark, d), "entity", FOLDS, REPEATS, SEED)


def cohort_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with cohort, their feature's source sheet: only samples of one cohort have features in common."""
    sheets = table(spark, d, "feature_manifest").select("feature_key", F.col("source_sheet").alias("cohort")).distinct()
    return stage(cells_of(spark, d).join(sheets, "feature_key").where(F.col("cond").isin("N", "T") & F.col("entity").isNotNull()), "cohorts")


def cohort_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired(cohort_cells(spark, d), ("cohort",))


def cohort_folds(cells: DataFrame, repeats: int = REPEATS) -> DataFrame:
    return evaluation.hash_folds(cells, "entity", FOLDS, repeats, SEED, ("cohort",))


@query("ml2_outer_folds", f"with {CELLS}, {_FOLDS} select * from fl")
def ml2(spark: SparkSession, d: str) -> DataFrame:
    return folds_of(spark, d)


@query("ml4_leakage_report", "select repeat, count(*) as torn from (select repeat, patient_id from outer_fold_assignments where outer_fold is not null group by all having count(distinct outer_fold) > 1) group by all")
def ml4(spark: SparkSession, d: str) -> DataFrame:
    torn = table(spark, d, "outer_fold_assignments").where("outer_fold is not null").groupBy("repeat", "patient_id").agg(F.count_distinct("outer_fold").alias("n")).where("n > 1")
    return torn.groupBy("repeat").agg(F.count(F.lit(1)).alias("torn"))


_STATES_OF_FOLDS = f"""{CELLS}, cc as (select source_sheet as cohort, feature_key, sample_id, entity, cond, y from cells join (select distinct feature_key, source_sheet from feature_manifest) using (feature_key) where cond in ('N', 'T') and entity is not null),
fc as (select cohort, repeat, entity, cast((row_number() over (partition by cohort, repeat order by md5(entity || ':' || (repeat * 1009 + {SEED})), entity) - 1) % {FOLDS} as integer) as outer_fold from (select distinct cohort, entity from cc), (select cast(range as integer) as repeat from range({REPEATS}))),
held as (select f.cohort, f.repeat, f.entity, k.outer_fold from fc f join (select distinct cohort, repeat, outer_fold from fc) k using (cohort, repeat) where f.outer_fold <> k.outer_fold),
sz as (select cohort, repeat, outer_fold, count(*) filter (cond = 'N') as an, count(*) filter (cond = 'T') as att from held join (select distinct cohort, entity, cond from cc) using (cohort, entity) group by all),
s as (select cohort, repeat, outer_fold, feature_key, count(*) filter (cond = 'N') as n, count(*) filter (cond = 'T') as t, median(y) as med, sum(y) as sy, sum(y * y) as ss, coalesce(sum(y) filter (cond = 'N'), 0) as sn, coalesce(sum(y) filter (cond = 'T'), 0) as st from cc join held using (cohort, entity) group by all),
g as (select *, an + att as a, (sn + (an - n) * med) / an as mn, (st + (att - t) * med) / att as mt, (sy + (an + att - n - t) * med) / (an + att) as mean from s join sz using (cohort, repeat, outer_fold) where (n + t) / (an + att) >= 0.5 and n / an >= 0.35 and t / att >= 0.35),
z as (select *, sqrt(greatest((ss + (a - n - t) * med * med) / a - mean * mean, 0)) as scale from g), r as (select *, abs(mt - mn) / scale as score from z where scale > 1e-9),
states_ as (select * from (select *, row_number() over (partition by cohort, repeat, outer_fold order by round(score, 9) desc, feature_key) as feature_rank from r) where feature_rank <= 50)"""


@query("ml5_fold_transformer", f"with {_STATES_OF_FOLDS} select cohort, repeat, outer_fold, cast(feature_rank as integer) as feature_rank, feature_key, round(med, 6) as median, round(mean, 6) as mean, round(scale, 6) as scale, round(score, 6) as score from states_")
def ml5(spark: SparkSession, d: str) -> DataFrame:
    """The states of every cohort's folds: features are eligible by their share of the cohort's own samples."""
    cells = cohort_cells(spark, d)
    return rounded(evaluation.fit_transformer(cells, cohort_folds(cells), 0.5, 0.35, 50, by=("cohort",)))


@query("ml6_transformed", f"with {_STATES_OF_FOLDS} select cohort, repeat, outer_fold, entity, cond, feature_key, round((coalesce(c.y, med) - mean) / scale, 6) as z from fc join (select distinct cohort, entity, cond from cc) using (cohort, entity) join states_ using (cohort, repeat, outer_fold) left join (select cohort, entity, cond, feature_key, y from cc) c using (cohort, entity, cond, feature_key)")
def ml6(spark: SparkSession, d: str) -> DataFrame:
    """The held-out samples of every cohort under their folds' states."""
    cells = cohort_cells(spark, d)
    folds = cohort_folds(cells)
    return rounded(evaluation.transform(cells, folds, evaluation.fit_transformer(cells, folds, 0.5, 0.35, 50, by=("cohort",)), ("cohort",)))


def coverage_of(spark: SparkSession, d: str) -> DataFrame:
    """The coverage baseline: a sample's share of detected rows as the probability of condition T."""
    m = table(spark, d, "measurement")
    return m.groupBy("sample_id").agg(F.round(F.avg(is_true(F.col("detected")).cast("double")), 9).alias("probability")).select("sample_id", F.expr("try_cast(nullif(regexp_extract(sample_id, '([0-9]+)', 1), '') as bigint)").alias("entity"), (F.upper(F.substring(F.trim("sample_id"), -1, 1)) == "T").cast("int").alias("label"), "probability")


_COVERAGE = "cv as (select sample_id, cast(regexp_extract(sample_id, '([0-9]+)', 1) as bigint) as entity, cast(upper(right(trim(sample_id), 1)) = 'T' as integer) as label, round(avg(case when detected then 1.0 else 0.0 end), 9) as probability from measurement group by all)"


@query("ml9_threshold", f"with {_COVERAGE}, c as (select distinct probability as t from cv union select 0.5), b as (select t, (avg(case when label = 1 then cast(probability >= t as integer) end) + avg(case when label = 0 then cast(probability < t as integer) end)) / 2 as ba from c, cv group by all) select round(t, 6) as threshold, round(ba, 6) as balanced_accuracy from b order by round(ba, 12) desc, round(abs(t - 0.5), 12), t desc limit 1")
def ml9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.best_threshold(coverage_of(spark, d), "probability", "label"))


@query("ml10_metrics", f"with {_COVERAGE}, r as (select *, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2 as rk from cv) select round((sum(rk) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) as roc_auc, cast(sum(label) as bigint) as positives, cast(sum(1 - label) as bigint) as negatives, round(avg(case when label = 1 then cast(probability >= 0.5 as integer) end), 6) as sensitivity, round(avg(case when label = 0 then cast(probability < 0.5 as integer) end), 6) as specificity, round(avg((probability - label) ** 2), 6) as brier, round(avg(-case when label = 1 then ln(least(greatest(probability, 1e-8), 1 - 1e-8)) else ln(1 - least(greatest(probability, 1e-8), 1 - 1e-8)) end), 6) as log_loss, round((avg(case when label = 1 then cast(probability >= 0.5 as integer) end) + avg(case when label = 0 then cast(probability < 0.5 as integer) end)) / 2, 6) as balanced_accuracy from r")
def ml10(spark: SparkSession, d: str) -> DataFrame:
    c = coverage_of(spark, d)
    return rounded(evaluation.roc_auc(c, "probability", "label", []).join(evaluation.threshold_metrics(c, "probability", "label", F.lit(0.5), [])))


@query("ml19_feature_stability", "with n as (select view_name, count(distinct repeat * 100 + outer_fold) as folds from fold_transformer group by all) select f.view_name, feature_name, count(distinct repeat * 100 + outer_fold) as selected, round(count(distinct repeat * 100 + outer_fold) / any_value(folds), 6) as frequency, round(median(means), 6) as median_mean, round(greatest(avg(cast(means > 0 as integer)), avg(cast(means < 0 as integer))), 6) as sign_consistency, count(distinct repeat * 100 + outer_fold) / any_value(folds) >= 0.8 as stable from fold_transformer f join n using (view_name) group by all")
def ml19(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fold_transformer").withColumn("fold", F.col("repeat") * 100 + F.col("outer_fold"))
    n = f.groupBy("view_name").agg(F.count_distinct("fold").alias("folds"))
    s = f.groupBy("view_name", "feature_name").agg(F.count_distinct("fold").alias("selected"), F.median("means").alias("median_mean"), F.avg((F.col("means") > 0).cast("int")).alias("up"), F.avg((F.col("means") < 0).cast("int")).alias("down"))
    s = s.join(F.broadcast(n), "view_name").withColumn("frequency", F.col("selected") / F.col("folds"))
    return rounded(s.select("view_name", "feature_name", "selected", "frequency", "median_mean", F.greatest("up", "down").alias("sign_consistency"), (F.col("frequency") >= 0.8).alias("stable")))


@query("ml20_orientation", f"with {_COVERAGE}, p as (select entity, max(probability) filter (label = 0) as n, max(probability) filter (label = 1) as t from cv group by all) select count(*) as pairs, round(avg(case when t > n then 1.0 when t = n then 0.5 else 0.0 end), 6) as oriented from p where n is not null and t is not null")
def ml20(spark: SparkSession, d: str) -> DataFrame:
    """Share of pairs whose T sample has the higher probability."""
    p = coverage_of(spark, d).groupBy("entity").agg(F.max(F.when(F.col("label") == 0, F.col("probability"))).alias("n"), F.max(F.when(F.col("label") == 1, F.col("probability"))).alias("t")).where("n is not null and t is not null")
    return rounded(p.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(F.col("t") > F.col("n"), 1.0).when(F.col("t") == F.col("n"), 0.5).otherwise(0.0)).alias("oriented")))


@query("ml16_outer_predictions")
def ml16(spark: SparkSession, d: str) -> DataFrame:
    """Held-out probabilities of every cohort, repeat, view and model, by the setting tuned inside the outer fold, and its threshold."""
    cells = cohort_cells(spark, d)
    return cohorts.nested_results(cells, cohort_folds(cells), False)


@query("ml21_prediction_influence", f"with {_COVERAGE}, s as (select o.entity, a.label, a.probability from (select distinct entity from cv) o, cv a where a.entity <> o.entity), w as (select entity, sum(label) as p, sum(1 - label) as n, sum(case when label = 1 then rk end) as rs from (select *, rank() over (partition by entity order by probability) + (count(*) over (partition by entity, probability) - 1) / 2 as rk from s) group by all), f as (select sum(label) as p, sum(1 - label) as n, sum(case when label = 1 then rk end) as rs from (select *, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2 as rk from cv)) select entity, round((w.rs - w.p * (w.p + 1) / 2) / (w.p * w.n), 6) as auc_without, round((w.rs - w.p * (w.p + 1) / 2) / (w.p * w.n) - (f.rs - f.p * (f.p + 1) / 2) / (f.p * f.n), 6) as change from w, f")
def ml21(spark: SparkSession, d: str) -> DataFrame:
    """The coverage baseline's AUC without each entity in turn, from the counts at each probability less the entity's own."""
    c = coverage_of(spark, d).where("entity is not null")
    at = c.groupBy("probability").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    along = Window.partitionBy(F.lit(1)).orderBy("probability")  # one row a distinct share of a sample
    at = at.withColumn("pos_above", F.sum("pos").over(Window.partitionBy(F.lit(1))) - F.sum("pos").over(along)).withColumn("neg_below", F.sum("neg").over(along) - F.col("neg"))
    total = c.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    won = at.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("won"))
    one = c.join(at, "probability").groupBy("entity").agg(F.sum("label").alias("op"), F.sum(1 - F.col("label")).alias("on"), F.sum(F.when(F.col("label") == 1, F.col("neg_below") + F.col("neg") / 2).otherwise(F.col("pos_above") + F.col("pos") / 2)).alias("lost"))
    # wins between the entity's own samples are in both sums
    own = c.select("entity", "probability", "label")
    twice = own.where("label = 1").withColumnRenamed("probability", "a").join(own.where("label = 0").select("entity", F.col("probability").alias("b")), "entity").groupBy("entity").agg(F.sum(F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)).alias("twice"))
    met = one.join(twice, "entity", "left").join(F.broadcast(total)).join(F.broadcast(won))
    auc = F.try_divide(F.col("won") - F.col("lost") + F.coalesce("twice", F.lit(0.0)), (F.col("p") - F.col("op")) * (F.col("n") - F.col("on")))
    return rounded(met.select("entity", auc.alias("auc_without"), (auc - F.col("won") / (F.col("p") * F.col("n"))).alias("change")))


@query("ht1_change_components")
def ht1(spark: SparkSession, d: str) -> DataFrame:
    """Components of change of every cohort over the features that all of its pairs have."""
    return cohorts.change_components(cohort_pairs(spark, d))


@query("ht5_cluster_stability")
def ht5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    vectors = e.select(F.col(e.columns[0]).alias("key"), F.col("embedding"))
    return modelling.cluster_stability(vectors.select("key", array_to_vector(F.col("embedding").cast("array<double>")).alias("x")), "key", "x", [2, 3, 4], 2)


@query("ml17_label_swap", f"with {_COVERAGE}, p as (select entity, max(probability) filter (label = 1) - max(probability) filter (label = 0) as d from cv group by all having d is not null), n as (select i, avg(case when ascii(upper(substr(md5(entity || ':' || i || ':7'), 1, 1))) % 2 = (case when substr(md5(entity || ':' || i || ':7'), 1, 1) in ('a', 'b', 'c', 'd', 'e', 'f') then 0 else 1 end) then -d else d end) as m from p, (select cast(range as integer) as i from range(1, 201)) group by all), s as (select count(*) as pairs, avg(d) as observed from p) select pairs, round(observed, 6) as observed, round((count(*) filter (round(abs(m), 12) >= round(abs(observed), 12)) + 1) / 201, 6) as p from n, s group by pairs, observed")
def ml17(spark: SparkSession, d: str) -> DataFrame:
    """Is coverage of T above that of N within pairs, against 200 swaps of the labels?"""
    p = coverage_of(spark, d).groupBy("entity").agg((F.max(F.when(F.col("label") == 1, F.col("probability"))) - F.max(F.when(F.col("label") == 0, F.col("probability")))).alias("d"))
    return rounded(evaluation.label_swap_test(p, "entity", "d", 200, 7))


@query("st11_robust_distance")
def st11(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "feature_manifest").agg(F.count_distinct("feature_key").alias("features"))
    return qc.robust_distance(qc.sample_profiles(cells_of(spark, d), features), "sample_id", ["observed_fraction", "median", "iqr", "mad", "p05", "p95"])


@query("top5_loadings", "select resample, component, feature_key, loading, cast(rank_by_size as integer) as rank_by_size from (select *, row_number() over (partition by resample, component order by abs(loading) desc, feature_key, loading desc) as rank_by_size from (select distinct resample, component, feature_key, loading from pca_top_loadings where loading is not null and not isnan(loading))) where rank_by_size <= 30")
def top5(spark: SparkSession, d: str) -> DataFrame:
    """30 largest loadings of a component with their rank. Spark keeps 30 rows a group in each task before the shuffle."""
    rows = table(spark, d, "pca_top_loadings").where("loading is not null and not isnan(loading)").select("resample", "component", "feature_key", "loading").distinct()
    rank = F.row_number().over(Window.partitionBy("resample", "component").orderBy(F.desc(F.abs("loading")), "feature_key", F.desc("loading")))
    return rows.withColumn("rank_by_size", rank).where("rank_by_size <= 30")


@query("prj13_cohort", f"with {_FLAGS} select entity, count(delta) as pairs, round(median(delta), 6) as median_change from pairs where entity not in (select entity from flagged where pair_flagged and entity is not null) group by all")
def prj13(spark: SparkSession, d: str) -> DataFrame:
    """Paired deltas of the cohort without flagged pairs, whole pairs at a time."""
    flagged = st15(spark, d).where("pair_flagged").select("entity")
    return rounded(pairs_of(spark, d).join(flagged, "entity", "left_anti").groupBy("entity").agg(F.count("delta").alias("pairs"), F.median("delta").alias("median_change")))


# robustness and selection -------------------------------------------------------------------------------------------
def universe(spark: SparkSession, d: str) -> DataFrame:
    cells = stage(cells_of(spark, d), "cells")
    features = table(spark, d, "feature_manifest").agg(F.count_distinct("feature_key").alias("features"))
    plain = stage(pairing.paired(cells), "pairs")
    flagged = qc.flag_samples(qc.sample_profiles(cells, features), qc.pair_concordance(plain)).where("pair_flagged").select("entity").distinct()
    return robustness.multiverse(robustness.scenario_pairs(plain, pairing.paired(pairing.centered(cells)), flagged), [5, 10, 15])


_U = f"""{_FLAGS}, med as (select sample_id, median(y) as med from cells group by all), flat as (select feature_key, entity, cond, y - med as y from cells join med using (sample_id)),
long as (select 'uncentered' as representation, feature_key, entity, delta from pairs union all select 'centered', feature_key, entity, max(case when cond = 'T' then y end) - max(case when cond = 'N' then y end) from flat group by feature_key, entity),
both_ as (select 'all_pairs' as cohort, * from long union all select 'unflagged_pairs', * from long where entity is null or entity not in (select entity from flagged where pair_flagged and entity is not null)),
mv as (select representation, cohort, feature_key, count(delta) as pairs, avg(delta) as mean, var_samp(delta) as variance from both_ group by all),
grid as (select representation || '|' || cohort || '|' || k as scn, feature_key, pairs, mean, variance, true as eligible from mv, (values (5), (10), (15)) t(k) where pairs >= k),
{oracles.tests("grid")},
est as (select scn || '|moderated' as scn, feature_key, mean, moderated_t as statistic, p from tested union all select scn || '|ordinary', feature_key, mean, ordinary_t, ordinary_p from tested),
{oracles.false_discovery("est", "fd")},
u as (select scn as scenario_id, feature_key, mean, statistic, p, q, coalesce(q <= {Q} and abs(mean) >= {EFFECT}, false) as core, case when statistic is not null then (rank() over (partition by scn, statistic is null order by abs(statistic)) + (count(*) over (partition by scn, abs(statistic)) - 1) / 2) / count(statistic) over (partition by scn) end as rank_percent from fd)"""


@query("rb1_multiverse", f"with recursive {_U} select scenario_id, count(*) as eligible, count(*) filter (q <= {Q}) as discoveries, count(*) filter (core) as core from u group by all")
def rb1(spark: SparkSession, d: str) -> DataFrame:
    return universe(spark, d).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("q") <= Q).alias("discoveries"), F.count_if("core").alias("core"))


_STABILITY = f"{_U}, stability as (select feature_key, count(*) as runs, greatest(avg(cast(mean > 0 as integer)), avg(cast(mean < 0 as integer))) as sign_agreement, avg(cast(coalesce(q <= {Q}, false) as integer)) as discovered, avg(cast(core as integer)) as core, min(mean) as least, median(mean) as median, max(mean) as greatest, stddev_samp(rank_percent) as rank_sd from u group by all)"


@query("rb2_feature_stability", f"with recursive {_STABILITY} select feature_key, runs, round(sign_agreement, 6) as sign_agreement, round(discovered, 6) as discovered, round(core, 6) as core, round(least, 6) as least, round(median, 6) as median, round(greatest, 6) as greatest, round(rank_sd, 6) as rank_sd from stability")
def rb2(spark: SparkSession, d: str) -> DataFrame:
    """Per feature over the scenarios: runs, sign agreement, discovery and core frequency (failed comparisons count), range of effect, spread of rank."""
    return rounded(stability_of(spark, d))


def stability_of(spark: SparkSession, d: str) -> DataFrame:
    u = universe(spark, d)
    return u.groupBy("feature_key").agg(F.count(F.lit(1)).alias("runs"), F.greatest(F.avg((F.col("mean") > 0).cast("int")), F.avg((F.col("mean") < 0).cast("int"))).alias("sign_agreement"), F.avg(is_true(F.col("q") <= Q).cast("int")).alias("discovered"), F.avg(F.col("core").cast("int")).alias("core"), F.min("mean").alias("least"), F.median("mean").alias("median"), F.max("mean").alias("greatest"), F.stddev_samp("rank_percent").alias("rank_sd"))


@query("rb3_scenario_similarity", f"""with recursive {_U}, two_ as (select a.scenario_id as scenario_a, b.scenario_id as scenario_b, round(a.statistic, 9) as sa, round(b.statistic, 9) as sb, round(a.mean, 9) as ma, round(b.mean, 9) as mb from u a join u b using (feature_key) where a.scenario_id < b.scenario_id and a.statistic is not null and b.statistic is not null),
rk as (select scenario_a, scenario_b, {", ".join(f"rank() over (partition by scenario_a, scenario_b order by {c}) + (count(*) over (partition by scenario_a, scenario_b, {c}) - 1) / 2 as r_{c}" for c in ("sa", "sb", "ma", "mb"))} from two_)
select scenario_a, scenario_b, count(*) as features, round(corr(r_sa, r_sb), 6) as statistic_rho, round(corr(r_ma, r_mb), 6) as effect_rho from rk group by all""")
def rb3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.scenario_similarity(universe(spark, d)))


_LOO = "s as (select feature_key, count(*) as c, sum(delta) as s from pairs where delta is not null group by all having c >= 3), o as (select p.feature_key, entity, s / c as mean, (s - delta) / (c - 1) as w from pairs p join s using (feature_key) where delta is not null), loo as (select feature_key, max(abs(w - mean)) as worst_change, bool_or(sign(w) <> sign(mean)) as flips from o group by all)"
_TIERS_OVER_U = _STABILITY + ", " + re.sub(r"\b(logs|edge|between_|bis|df0|prior|post|stat|tested)\b", r"a_\1", _TIERS.removeprefix(PAIRS).lstrip(", "))


@query("rb5_integrated_evidence", f"""with recursive {_TIERS_OVER_U}, {_LOO}, met as (select t.*, runs, sign_agreement, core, flips, worst_change, coalesce(core >= 0.8 and sign_agreement >= 0.8 and not flips, false) as robust from tiered t left join stability using (feature_key) left join loo using (feature_key))
select feature_key, round(mean, 6) as mean, round(abundance_q, 6) as abundance_q, round(consistency, 6) as consistency, round(fraction_difference, 6) as fraction_difference, round(detection_q + 1e-12, 6) as detection_q, tier, runs, round(sign_agreement, 6) as sign_agreement, round(core, 6) as core, flips, round(worst_change, 6) as worst_change,
case when robust and tier in ('A', 'B') then 'high' when tier <> 'none' then 'single' when robust then 'stable only' else 'none' end as priority from met""")
def rb5(spark: SparkSession, d: str) -> DataFrame:
    """Tiers beside stability over scenarios and over left-out entities; missing evidence stays missing."""
    tiers, stable = tiers_of(spark, d), stability_of(spark, d).select("feature_key", "runs", "sign_agreement", "core")
    loo = robustness.leave_one_out(pairs_of(spark, d)).select("feature_key", "flips", "worst_change")
    met = tiers.join(stable, "feature_key", "left").join(loo, "feature_key", "left")
    robust = is_true((F.col("core") >= 0.8) & (F.col("sign_agreement") >= 0.8) & ~F.col("flips"))
    return rounded(nudged(met).withColumn("priority", cascade([(robust & F.col("tier").isin("A", "B"), "high"), (F.col("tier") != "none", "single"), (robust, "stable only")], "none")))


_OMIT = f"""{PAIRS}, dl as (select source_sheet as cohort, feature_key, entity, delta from pairs join (select distinct feature_key, source_sheet from feature_manifest) using (feature_key) where delta is not null and entity is not null and source_sheet is not null),
sm as (select cohort, feature_key, count(*) as c, sum(delta) as s, sum(delta * delta) as ss from dl group by all),
gr as (select cohort, null::bigint as omitted, feature_key, c, s, ss from sm union all select cohort, omitted, feature_key, c - cast(delta is not null as integer), s - coalesce(delta, 0), ss - coalesce(delta * delta, 0) from sm join (select distinct cohort, entity as omitted from dl) using (cohort) left join (select cohort, feature_key, entity as omitted, delta from dl) using (cohort, feature_key, omitted)),
om as (select cohort || '|' || coalesce(omitted::varchar, '') as scn, cohort, omitted, feature_key, c as pairs, s / c as mean, greatest((ss - s * s / c) / (c - 1), 0) as variance, true as eligible from gr where c >= {LEAST_PAIRS}),
{oracles.tests("om")}, {oracles.false_discovery("tested", "omq")}, oc as (select *, coalesce(q <= {Q} and abs(mean) >= {EFFECT}, false) as core from omq)"""


@query("rb4_leave_one_out_tests", f"""with recursive {_OMIT} select w.cohort, w.feature_key, any_value(w.pairs) as pairs, round(any_value(w.mean), 6) as mean, round(any_value(w.q), 6) as q, any_value(w.core) as core, count(o.mean) as runs, count(*) filter (o.core) as retained, count(*) filter (sign(o.mean) <> sign(w.mean)) as flips,
round(max(o.q), 6) as worst_q, round(max(abs(o.mean - w.mean) / nullif(w.ordinary_se, 0)), 5) as worst_change from oc w left join (select * from oc where omitted is not null) o using (cohort, feature_key) where w.omitted is null group by w.cohort, w.feature_key""")
def rb4_tests(spark: SparkSession, d: str) -> DataFrame:
    """Moderated tests of every cohort without each of its entities: does what is significant stay so?"""
    got = robustness.leave_one_out_tests(cohort_pairs(spark, d), LEAST_PAIRS, Q, EFFECT)
    return rounded(got.withColumn("worst_change", F.round("worst_change", 5)))


@query("vr2_pareto_fronts", f"""with recursive {PAIRS}, m_o as (select source_sheet, feature_key, count(delta) as pairs, round(abs(avg(delta)), 9) as effect, round(greatest(count(*) filter (delta > 0), count(*) filter (delta < 0)) / nullif(count(*) filter (delta <> 0), 0), 9) as direction from pairs join feature_manifest using (feature_key) group by all),
x as (select *, coalesce(effect, -1) as e, coalesce(direction, -1) as c from m_o), beats as (select a.feature_key as winner, b.feature_key as loser from x a join x b on a.source_sheet = b.source_sheet and a.pairs >= b.pairs and a.e >= b.e and a.c >= b.c and (a.pairs > b.pairs or a.e > b.e or a.c > b.c)),
chain(feature_key, depth) as (select feature_key, 1 from x union select loser, depth + 1 from chain join beats on winner = feature_key) select source_sheet, feature_key, pairs, effect, direction, cast(max(depth) as integer) as front from x join chain using (feature_key) group by all""")
def vr2(spark: SparkSession, d: str) -> DataFrame:
    """Fronts of features by pairs, |mean| and consistency, within a sheet. Numbers count as equal to nine digits."""
    m = pairing.moments(pairs_of(spark, d)).join(table(spark, d, "feature_manifest").select("feature_key", "source_sheet"), "feature_key")
    m = m.select("source_sheet", "feature_key", "pairs", F.round(F.abs("mean"), 9).alias("effect"), F.round("consistency", 9).alias("direction"))
    return selection.pareto_fronts(m, "feature_key", ["pairs", "effect", "direction"], ["source_sheet"])


_COMP = "e as (select distinct feature_key_1 as u, feature_key_2 as v from redundancy_edges where abs(spearman_rho) >= 0.9 and not isnan(spearman_rho) and feature_key_1 <> feature_key_2), bw as (select u, v from e union select v, u from e), reach(u, v) as (select u, v from bw union select r.u, b.v from reach r join bw b on r.v = b.u), comp as (select u as vertex, min(least(u, v)) as component from reach group by u)"


def redundant(spark: SparkSession, d: str) -> DataFrame:
    return selection.label_components(table(spark, d, "redundancy_edges").where((F.abs("spearman_rho") >= 0.9) & ~F.isnan("spearman_rho")), "feature_key_1", "feature_key_2")


@query("vr3_redundant_groups", f"with recursive {_COMP} select vertex, component from comp")
def vr3(spark: SparkSession, d: str) -> DataFrame:
    return redundant(spark, d)


@query("vr4_representatives", f"with recursive {_COMP}, {PAIRS}, mo as (select feature_key, count(delta) as pairs, round(avg(delta), 6) as mean from pairs group by all) select component, feature_key, coalesce(pairs, 0) as pairs from (select component, vertex as feature_key, pairs, row_number() over (partition by component order by coalesce(pairs, 0) desc, coalesce(abs(mean), -1) desc, vertex) as rn from comp left join mo on mo.feature_key = vertex) where rn = 1")
def vr4(spark: SparkSession, d: str) -> DataFrame:
    m = rounded(pairs_of(spark, d).groupBy("feature_key").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean")))
    g = redundant(spark, d).withColumnRenamed("vertex", "feature_key").join(m, "feature_key", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return selection.representatives(g, "component", [F.desc("pairs"), F.desc(F.coalesce(F.abs("mean"), F.lit(-1.0))), F.asc("feature_key")]).select("component", "feature_key", "pairs")


@query("vr6_mcnemar_pairs", f"with {STATES}, x as (select feature_key, abs(fraction_difference) as dd, discordant / entities as w from states) select feature_key, cast(case when dd > 0 and dd <= w then ceil(round((1.959963984540054 * sqrt(w) + 0.8416212335729143 * sqrt(greatest(w - dd * dd, 0))) ** 2 / (dd * dd), 6)) end as bigint) as pairs_needed from x")
def vr6(spark: SparkSession, d: str) -> DataFrame:
    s = states_of(spark, d).withColumn("discordance", F.col("discordant") / F.col("entities"))
    return s.select("feature_key", selection.mcnemar_pairs("fraction_difference", "discordance", 0.05, 0.8).alias("pairs_needed"))


@query("vr5_paired_t_pairs")
def vr5(spark: SparkSession, d: str) -> DataFrame:
    """Pairs needed to see each feature's observed standardised effect again (alpha 0.05, power 0.8)."""
    m = pairing.moments(pairs_of(spark, d)).where(F.col("pairs") >= LEAST_PAIRS).withColumn("effect", F.try_divide("mean", F.sqrt("variance")))
    return m.select("feature_key", "effect", selection.paired_t_pairs("effect", 0.05, 0.8).alias("pairs_needed"))


@query("agg6_sheet_pairs", f"with {PAIRS} select source_sheet, count(*) as rows_, sum(case when state = 3 then 1 else 0 end) as complete from pairs join feature_manifest using (feature_key) group by all".replace("select source_sheet, count(*) as rows_, sum(case when state = 3 then 1 else 0 end) as complete", "select source_sheet, count(*) as row_count, count(*) filter (state = 3) as complete"))
def sheet_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(spark, d).join(table(spark, d, "feature_manifest").select("feature_key", "source_sheet"), "feature_key").groupBy("source_sheet").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("state") == 3).alias("complete"))


@query("snk5_content_manifest")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and checksum of every file of the tables, by its name in the folder."""
    return content_manifest(spark, d, "*.parquet").select(F.regexp_extract("path", r"([^/]+(?:\.parquet/[^/]+)?)$", 1).alias("file"), "bytes", "sha256")


# baselines, influence and controls --------------------------------------------------------------------------------------
@query("ml12_inner_tuning")
def ml12(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid over five inner folds of every cohort, repeat, outer fold, view and model."""
    cells = cohort_cells(spark, d)
    return cohorts.nested_results(cells, cohort_folds(cells), True)


@query("ml13_pca_baseline")
def ml13(spark: SparkSession, d: str) -> DataFrame:
    """Held-out areas under the curve of the component baseline, fold by fold."""
    cells = cohort_cells(spark, d)
    return evaluation.roc_auc(cohorts.outer_predictions(cells, cohort_folds(cells), "pca", most=100), "score", "label", ["cohort", "repeat", "outer_fold"])


@query("ml15_heldout_importance")
def ml15(spark: SparkSession, d: str) -> DataFrame:
    cells = cohort_cells(spark, d)
    return cohorts.heldout_importance(cells, cohort_folds(cells))


@query("ml18_learning_curve")
def ml18(spark: SparkSession, d: str) -> DataFrame:
    cells = cohort_cells(spark, d)
    scores = cohorts.learning_curve_scores(cells, cohort_folds(cells), FOLDS - 1)
    return evaluation.roc_auc(scores, "score", "label", ["cohort", "repeat", "parts", "train_entities"]).drop("positives", "negatives")


@query("ml22_view_winners", f"""with {CELLS}, {_FOLDS}, {_COVERAGE}, vw as (select entity, label, 'coverage' as view, probability as score from cv union all select entity, cast(cond = 'T' as integer), 'median', round(median(y), 9) from cells group by sample_id, entity, cond),
r as (select repeat, outer_fold, view, label, rank() over (partition by repeat, outer_fold, view order by score) + (count(*) over (partition by repeat, outer_fold, view, score) - 1) / 2 as rk from vw join fl using (entity)),
a as (select repeat, outer_fold, view, round((sum(rk) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 9) as auc from r group by all having sum(label) > 0 and sum(1 - label) > 0),
b as (select *, row_number() over (partition by repeat, outer_fold order by auc desc, view) = 1 as best from a)
select view, count(*) as folds, round(min(auc), 6) as least, round(median(auc), 6) as median, round(max(auc), 6) as greatest, count(*) filter (best) as wins from b group by view""")
def ml22(spark: SparkSession, d: str) -> DataFrame:
    """Which single-number view of a sample, coverage or median, tells the conditions apart better, over all folds of all repeats."""
    cells = cells_of(spark, d)
    medians = cells.groupBy("sample_id", "entity", "cond").agg(F.round(F.median("y"), 9).alias("score"))
    views = coverage_of(spark, d).select("entity", "label", F.lit("coverage").alias("view"), F.col("probability").alias("score")).unionByName(medians.select("entity", (F.col("cond") == "T").cast("int").alias("label"), F.lit("median").alias("view"), "score"))
    return rounded(evaluation.fold_aucs(views.join(folds_of(spark, d), "entity"), "score", "label", ["repeat", "outer_fold"], "view"))


@query("ml23_overlap_control")
def ml23(spark: SparkSession, d: str) -> DataFrame:
    """Do the features that most folds select and those with a supported change overlap more than random sets?"""
    picked = ml19(spark, d).where("frequency >= 0.6").join(table(spark, d, "fold_transformer").select("feature_name", "feature_key").distinct(), "feature_name").select("feature_key").distinct().withColumn("selected", F.lit(True))
    supported = st5(spark, d).select("feature_key", is_true(F.col("q") <= Q).alias("supported"))
    keys = table(spark, d, "feature_manifest").select("feature_key").distinct()
    return evaluation.overlap_control(keys.join(picked, "feature_key", "left").join(supported, "feature_key", "left"), "feature_key", "selected", "supported", 1000, SEED)


@query("ht2_bootstrap_variance")
def ht2(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.bootstrap_explained(cohort_pairs(spark, d), 200)


@query("st13_sample_components")
def st13(spark: SparkSession, d: str) -> DataFrame:
    """Components of every cohort's samples themselves, for diagnosis: features that 80 percent of its samples have."""
    return cohorts.change_components(cohort_cells(spark, d).select("cohort", "feature_key", F.col("sample_id").alias("entity"), F.col("y").alias("delta")), 0.8).withColumnRenamed("entity", "sample_id")


_SENSITIVITY = f"""{_U}, sym as (select feature_key, trim(feature_id_original) as symbol from feature_manifest where trim(feature_id_original) <> '' and not contains(feature_id_original, ';')),
rkg as (select * from (select scenario_id, symbol, statistic as v, row_number() over (partition by scenario_id, symbol order by abs(statistic) desc, feature_key) as rn from u join sym using (feature_key) where statistic is not null) where rn = 1),
pl as (select scenario_id, symbol, v, row_number() over (partition by scenario_id order by v desc, symbol) as place, count(*) over (partition by scenario_id) as n from rkg),
mem as (select distinct source_sheet as set_id, trim(feature_id_original) as symbol from feature_manifest where feature_id_original is not null),
h as (select scenario_id, set_id, symbol, place, n, v, count(*) over (partition by scenario_id, set_id) as size, sum(abs(v)) over (partition by scenario_id, set_id) as total, row_number() over (partition by scenario_id, set_id order by place) as hit from mem join pl using (symbol)),
w as (select *, case when total > 0 then abs(v) / total else 1 / size end as w from h where size between 3 and 500 and size < n),
a as (select *, sum(w) over (partition by scenario_id, set_id order by place) - (place - hit) / (n - size) as after from w),
s as (select scenario_id, set_id, size, max(after) as up, min(after - w) as down from a group by all),
top as (select scenario_id, set_id, min(hit) filter (after = up) as first_up, min(hit) filter (after - w = down) as first_down from a join s using (scenario_id, set_id, size) group by all),
edge_ as (select scenario_id, set_id, symbol from a join s using (scenario_id, set_id, size) join top using (scenario_id, set_id) where case when abs(up) >= abs(down) then hit <= first_up else hit >= first_down end),
score as (select scenario_id, set_id, case when abs(up) >= abs(down) then up else down end as score from s),
first_ as (select set_id, symbol from edge_ where scenario_id = 'uncentered|all_pairs|{LEAST_PAIRS}|moderated'), size_ as (select set_id, count(*) as other from first_ group by all),
shared as (select e.scenario_id, e.set_id, count(*) as own, count(f.symbol) as both_ from edge_ e left join first_ f on f.set_id = e.set_id and f.symbol = e.symbol group by all)"""


@query("pw8_scenario_sensitivity", f"""with recursive {_SENSITIVITY} select scenario_id, set_id, round(c.score, 6) as score, sign(c.score) = sign(p.score) as same_direction, round(both_ / (own + other - both_), 6) as edge_jaccard
from score c left join shared using (scenario_id, set_id) left join (select set_id, score from score where scenario_id = 'uncentered|all_pairs|{LEAST_PAIRS}|moderated') p using (set_id) left join size_ using (set_id)""")
def pw8(spark: SparkSession, d: str) -> DataFrame:
    """Set scores over the ranking of every scenario against those of the primary one."""
    symbols = table(spark, d, "feature_manifest").select("feature_key", "feature_id_original")
    ranking = enrichment.collapse_ranking(universe(spark, d).join(symbols, "feature_key"), "feature_id_original", "statistic", "feature_key", ("scenario_id",))
    return rounded(enrichment.scenario_sensitivity(ranking, sets_of(spark, d), "scenario_id", f"uncentered|all_pairs|{LEAST_PAIRS}|moderated", 3, 500))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
