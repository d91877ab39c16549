"""The queries of the numbered problems on the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.components import connected_groups
from tarnwork.llm.leakage import leaked_passages
from tarnwork.llm.mixing import mix_to_targets, posterior_quality
from tarnwork.llm.pii import find_personal, redact_personal
from tarnwork.llm.splits import keep_together_splits, torn_entities
from tarnwork.llm.topn import top_n_per_group
from tarnwork.sources.tables import table

LINK_RHO = 0.80
TOP = 10
LEAK_WORDS = 13
LEAK_COVERAGE = 0.5


def _patient(column: str) -> Column:
    """The patient number in any spelling of a patient id: its first run of digits."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '([0-9]+)', 1), '') as bigint)")


def _persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    assigned = table(spark, sf_dir, "outer_fold_assignments").select("repeat", "outer_fold", _patient("patient_id").alias("patient"))
    targets = {r.split_name: r.target_share for r in table(spark, sf_dir, "split_targets").collect()}  # fixed: three rows
    entities, forest = keep_together_splits(assigned, "patient", table(spark, sf_dir, "sample_manifest"), "patient_number", "pair_id", targets)
    return assigned, entities, forest


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, entities, _ = _persons(spark, sf_dir)
    return torn_entities(assigned, "patient", ["repeat"], "outer_fold", entities).select("repeat", F.col("root").cast("int").alias("patient_number"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patient number of outer_fold_assignments with its person, rows and split."""
    return _persons(spark, sf_dir)[1].select(F.col("entity").alias("patient"), F.col("root").alias("person"), "records", "split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual against wanted shares of the rows."""
    _, entities, _ = _persons(spark, sf_dir)
    got = entities.groupBy("split").agg(F.sum("records").alias("records"), F.count_distinct("root").alias("persons"))
    total = entities.agg(F.sum("records").alias("all_records"))
    return table(spark, sf_dir, "split_targets").join(got, F.col("split") == F.col("split_name"), "left").join(F.broadcast(total)).select("split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("persons", F.lit(0)).alias("persons"), (F.coalesce("records", F.lit(0)) / F.col("all_records")).alias("actual_share"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n_per_group(table(spark, sf_dir, "pca_top_loadings"), ["resample", "component"], "feature_key", F.abs("loading"), TOP)
    return top.select("resample", "component", F.col("item").alias("feature_key"))


def _key(column: str) -> Column:
    return F.upper(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "redundancy_edges").where((F.abs("spearman_rho") >= LINK_RHO) & ~F.isnan("spearman_rho"))
    groups = connected_groups(edges.select(_key("feature_key_1").alias("u"), _key("feature_key_2").alias("v")), "u", "v")
    return groups.select("component_key", F.col("vertex").alias("feature_key"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["prompt", "answer"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("longest_run") >= LEAK_WORDS).select("doc_id", "item_id").distinct()


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks by coverage: parts of items of which tiles cover half or more, in whatever order, with their longest run."""
    return _leaks(spark, sf_dir).where(F.col("coverage") >= LEAK_COVERAGE)


TRAITS = ["owner", "layout", "kernel", "lang"]


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("owner", F.substring_index("repo", "/", 1))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_to_targets(_owned(spark, sf_dir), "doc_id", "text", "source", TRAITS, table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("falls_short").select("source_name")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wished, reachable, fitted and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p7_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each notebook is drawn."""
    return _mix(spark, sf_dir)[0]


def p7_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the classifier's posteriors fit held-out notebooks."""
    return posterior_quality(_owned(spark, sf_dir), "doc_id", "text", "source", TRAITS, table(spark, sf_dir, "mix_targets"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_hints"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("doc_id", F.explode("found").alias("f")).select("doc_id", F.col("f.kind").alias("pii_type"), F.col("f.piece").alias("pii_text")).distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook with placeholders for what p8_found finds."""
    return redact_personal(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_hints"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p2_found": p2_found, "p3_found": p3_found, "p6_found": p6_found, "p6_coverage": p6_coverage, "p7_found": p7_found, "p7_shares": p7_shares, "p7_draws": p7_draws, "p7_posteriors": p7_posteriors, "p8_found": p8_found, "p8_redacted": p8_redacted}


_SEEN = """
with recursive link as (select distinct a.patient_number as a, b.patient_number as b from sample_manifest a join sample_manifest b using (pair_id) where a.patient_number <> b.patient_number),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
person as (select a, min(least(a, b)) as root from reach group by a),
seen as (select o.repeat, o.outer_fold, o.n, coalesce(p.root, o.n) as root from (select *, cast(nullif(regexp_extract(patient_id, '([0-9]+)', 1), '') as bigint) as n from outer_fold_assignments) o left join person p on p.a = o.n)"""
_CLOSURE = (
    _SEEN
    + """
select repeat, cast(root as integer) as patient_number from seen where root is not null and outer_fold is not null group by all having count(distinct outer_fold) > 1"""
)
# the three splits in falling order of their shares take their turns along the roots of a band
_DEALT = (
    _SEEN
    + """,
roots as (select root, cast(floor(log2(count(*))) as integer) as band from seen where root is not null group by root),
turn as (select root, row_number() over (partition by band order by md5(cast(root as varchar)), root) - 1 as k from roots),
wish as (select list(split_name order by target_share desc, split_name) as names, list(target_share order by target_share desc, split_name) as shares from split_targets),
one as (select root, names, shares, k, shares[1] / list_sum(shares) as a, shares[2] / (list_sum(shares) - shares[1]) as b from turn, wish),
two as (select *, ceil((k + 1) * a - 1e-9) > ceil(k * a - 1e-9) as first, k - ceil(k * a - 1e-9) as k2 from one),
dealt as (select root, case when first then names[1] when ceil((k2 + 1) * b - 1e-9) > ceil(k2 * b - 1e-9) then names[2] else names[3] end as split from two)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CLOSURE,
        "p1_splits": _DEALT + " select n as patient, root as person, count(*) as records, any_value(split) as split from seen join dealt using (root) where n is not null group by n, root",
        "p1_shares": _DEALT + " select split_name, target_share, count(root) as records, count(distinct root) as persons, count(root) / (select count(*) from seen where n is not null) as actual_share from split_targets left join (select * from seen join dealt using (root)) on split = split_name group by all",
        "p2_found": """select resample, component, feature_key from (select *, row_number() over (partition by resample, component order by s desc, feature_key) as rn
            from (select resample, component, feature_key, max(abs(loading)) as s from pca_top_loadings where loading is not null and not isnan(loading) and feature_key is not null group by all)) where rn <= 10""",
        # no source is near its limit, so that characters give the answer that tokens give
        "p7_found": r"""with own as (select regexp_replace(lower(trim(source)), '[\s-]', '_', 'g') as name, sum(length(coalesce(text, ''))) as n from documents group by all)
            select source_name from mix_targets left join own on name = regexp_replace(lower(trim(source_name)), '[\s-]', '_', 'g')
            where max_repeats * coalesce(n, 0) < target_share * (select sum(length(coalesce(text, ''))) from documents)""",
        "p3_found": r"""with recursive e as (select distinct upper(regexp_replace(feature_key_1, '^\s+|\s+$', '', 'g')) as u, upper(regexp_replace(feature_key_2, '^\s+|\s+$', '', 'g')) as v from redundancy_edges where abs(spearman_rho) >= 0.8 and not isnan(spearman_rho)),
            both_ways as (select u, v from e where u <> v union select v, u from e where u <> v),
            reach(u, v) as (select u, v from both_ways union select r.u, b.v from reach r join both_ways b on r.v = b.u)
            select min(least(u, v)) as component_key, u as feature_key from reach group by u""",
    }
