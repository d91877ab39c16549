"""SQL of the moderated tests and of what rests on them: the same numbers by Simpson's rule, bisection and plain windows."""

from __future__ import annotations

BERNOULLI = ["1.0/6", "-1.0/30", "1.0/42", "-1.0/30", "5.0/66", "-691.0/2730", "7.0/6"]


def digamma(x: str) -> str:
    z = f"({x} + 16)"
    series = " ".join(f"- ({b}) / ({2 * k} * pow({z}, {2 * k}))" for k, b in enumerate(BERNOULLI, 1))
    return f"(ln({z}) - 1 / (2 * {z}) {series} - list_sum(list_transform(range(16), lambda i: 1 / ({x} + i))))"


def trigamma(x: str) -> str:
    z = f"({x} + 16)"
    series = " ".join(f"+ ({b}) / pow({z}, {2 * k + 1})" for k, b in enumerate(BERNOULLI, 1))
    return f"(1 / {z} + 1 / (2 * {z} * {z}) {series} + list_sum(list_transform(range(16), lambda i: 1 / pow({x} + i, 2))))"


def student_p(t: str, df: str) -> str:
    """Two-sided p of |t|, by Simpson's rule on 2,000 intervals of the angle, up to where the integrand is gone."""
    low = f"atan(abs({t}) / sqrt({df}))"
    width = f"least(pi() / 2 - {low}, 40 / greatest(({df} - 1) * tan({low}), sqrt({df})))"
    terms = f"list_transform(range(2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(greatest(cos({low} + {width} * i / 2000.0), 0.0), {df} - 1))"
    return f"(2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) * list_sum({terms}) * {width} / 6000)"


def tests(source: str) -> str:
    """CTEs that end in `tested`: source (scn, feature_key, pairs, mean, variance, eligible, ...) with prior, moderated and ordinary t and p."""
    return f"""logs as (select scn, pairs, ln(variance) as v from {source} where eligible and pairs > 1 and variance > 0),
    edge as (select scn, quantile_cont(v, 0.05) as e1, quantile_cont(v, 0.95) as e2 from logs group by all),
    between_ as (select scn, greatest(var_samp(least(greatest(v, e1), e2)) - avg({trigamma("((pairs - 1) / 2.0)")}), 1e-6) as b, avg(v - {digamma("((pairs - 1) / 2.0)")} + ln((pairs - 1) / 2.0)) as level from logs join edge using (scn) group by scn having count(*) >= 20),
    bis(scn, b, n, lo, hi) as (select scn, b, 0, ln(1e-4), ln(1e7) from between_ union all
        select scn, b, n + 1, case when {trigamma("exp((lo + hi) / 2)")} > b then (lo + hi) / 2 else lo end, case when {trigamma("exp((lo + hi) / 2)")} > b then hi else (lo + hi) / 2 end from bis where n < 70),
    df0 as (select scn, least(2 * exp((lo + hi) / 2), 1e6) as d0 from bis where n = 70),
    prior as (select scn, d0, exp(level + {digamma("(d0 / 2)")} - ln(d0 / 2)) as s0 from df0 join between_ using (scn)),
    post as (select s.*, d0, s0, (d0 * s0 + (pairs - 1) * variance) / nullif(d0 + pairs - 1, 0) as posterior from {source} s left join prior using (scn)),
    stat as (select *, sqrt(posterior / nullif(pairs, 0)) as se, mean / nullif(sqrt(posterior / nullif(pairs, 0)), 0) as moderated_t, d0 + pairs - 1 as moderated_df, sqrt(variance / nullif(pairs, 0)) as ordinary_se,
        case when sqrt(variance / nullif(pairs, 0)) > 0 then mean / sqrt(variance / pairs) end as ordinary_t from post),
    tested as (select *, case when eligible and moderated_t is not null then least(1.0, {student_p("moderated_t", "moderated_df")}) end as p, case when eligible and ordinary_t is not null then least(1.0, {student_p("ordinary_t", "(pairs - 1.0)")}) end as ordinary_p from stat)"""


#: the half width of a 95 percent interval for each number of degrees of freedom
HALF = f"""dfs as (select distinct moderated_df as nu from tested where p is not null),
    qs(nu, n, lo, hi) as (select nu, 0, 0.0::double, 1e4::double from dfs union all select nu, n + 1, case when {student_p("((lo + hi) / 2)", "nu")} > 0.05 then (lo + hi) / 2 else lo end, case when {student_p("((lo + hi) / 2)", "nu")} > 0.05 then hi else (lo + hi) / 2 end from qs where n < 60),
    half as (select nu as moderated_df, (lo + hi) / 2 as h from qs where n = 60)"""


def false_discovery(source: str, out: str, p: str = "p", family: str = "scn", q: str = "q") -> str:
    """CTE `out`: source with q of p within the family."""
    whole = f"partition by {family}, {p} is null"
    return f"""{out}_ranked as (select *, row_number() over ({whole} order by {p}, feature_key) as rk, count({p}) over ({whole}) as m_ from {source}),
    {out} as (select * exclude (rk, m_), case when {p} is not null then least(1.0, min({p} * m_ / rk) over ({whole} order by rk desc rows unbounded preceding)) end as {q} from {out}_ranked)"""


def robust_z(value: str, source: str, by: str = "") -> str:
    """(key of the source, z of the value) as a subquery: 0 where the MAD is 0."""
    over = f"partition by {by}" if by else ""
    return f"""(select *, case when {value} is null then null when d_ > 0 then ({value} - m_) / (1.4826 * d_) else 0 end as z from (select *, median(abs({value} - m_)) over ({over}) as d_ from (select *, median({value}) over ({over}) as m_ from {source})))"""


def flags(profile: str, rho: str) -> str:
    """CTEs that end in `flagged` (sample_id, entity, cond, flags, flagged, pair_flagged)."""
    z = lambda v: robust_z(v, "prof", "cond")
    return f"""{profile}, prof as (select sample_id, entity, cond, observed / features as observed_fraction, median as level, p75 - p25 as iqr, outside from q join ot using (sample_id), fs),
    {rho}, rhos as (select entity, corr(rn, rt) as rho from r group by all), low as (select entity, z from {robust_z("rho", "(select * from rhos where rho is not null)")}),
    counted as (select p.sample_id, p.entity, p.cond, cast(coalesce(abs(a.z) > 3.5, false) as integer) + cast(coalesce(abs(b.z) > 3.5, false) as integer) + cast(coalesce(abs(c.z) > 3.5, false) as integer) + cast(coalesce(abs(e.z) > 3.5, false) as integer) + cast(coalesce(low.z < -3.5, false) as integer) as flags
        from prof p join {z("observed_fraction")} a using (sample_id) join {z("level")} b using (sample_id) join {z("iqr")} c using (sample_id) join {z("outside")} e using (sample_id) left join low on low.entity = p.entity),
    flagged as (select *, flags >= 2 as flagged, bool_or(flags >= 2) over (partition by entity) as pair_flagged from counted)"""


# codes: every known one in the text, the longest first; locators: quoted pieces, else all up to a separator outside round brackets
PACKED = r"""with codes as (select '(' || string_agg(regexp_replace(limitation_id, '([.+*?()\[\]{}|^$\\])', '\\\1', 'g'), '|' order by length(limitation_id) desc, limitation_id) || ')' as rx from limitation_register where limitation_id is not null),
    l as (select ledger_id, regexp_extract_all(limitation_ids, rx) as v from claim_ledger, codes),
    bare as (select ledger_id, case when regexp_matches(trim(evidence_locator), '^\[.*\]$', 's') or regexp_matches(trim(evidence_locator), '^\{.*\}$', 's') then substring(trim(evidence_locator), 2, length(trim(evidence_locator)) - 2) else evidence_locator end as t from claim_ledger),
    e as (select ledger_id, list_filter(list_transform(regexp_extract_all(t, '[ ]*("(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|‘[^’]*’|(?:\([^)]*\)|[^,;|\t\n\r(])+)'),
        lambda x: case when regexp_matches(trim(x), '^".*"$', 's') then trim(replace(substring(trim(x), 2, length(trim(x)) - 2), '""', '"')) when regexp_matches(trim(x), '^(''.*''|“.*”|‘.*’)$', 's') then trim(replace(substring(trim(x), 2, length(trim(x)) - 2), '''''', '''')) else trim(x) end), lambda x: x <> '') as v from bare)
    select ledger_id, 'limitation_ids' as field_name, cast(generate_subscripts(v, 1) as integer) as item_position, unnest(v) as item_value from l union all select ledger_id, 'evidence_locator', cast(generate_subscripts(v, 1) as integer), unnest(v) from e"""
