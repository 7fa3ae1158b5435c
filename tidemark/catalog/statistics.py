"""Population study, distributions, hazards, resampling and samples."""

import math

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.catalog.registry import query
from tidemark.catalog.sqlparts import SERIES, scored
from tidemark.operators import audits as au
from tidemark.operators import filters as fi
from tidemark.operators import fits
from tidemark.operators import ranks as rk
from tidemark.operators import resample as rs
from tidemark.operators import sampling as sa
from tidemark.operators import series as ser
from tidemark.plans import population as pop
from tidemark.plans import scoring as plan
from tidemark.session import staged
from tidemark.sources import files

CELL = pop.CELL
_CELL_COLS = "category subcategory period"
_COMP = "comp as (select * from population where in_scope and ils_dl is not null)"
_ANN = " + ".join(f"regexp_matches(question, '{p}')::int" for p in C.ANNOUNCEMENT_PATTERNS)
_FOR = " + ".join(f"regexp_matches(question, '{p}')::int" for p in C.FORMAL_PATTERNS)
_SUB = f"case when {_ANN} > {_FOR} then 'regulatory_decision_announcement' else 'regulatory_decision_formal' end"


# -------------------------------------------------------------- population
_POP_SQL = SERIES.replace("series as (select market_id, ts, mid_price::double as p, 'quotes' as source from prices\n           where market_id in (select market_id from nq)\n           union all select market_id, ts, p, 'trade_vwap' from dense)",
                          "series as (select market_id, ts, mid_price::double as p, 'quotes' as source from prices)") + """,
    nqp as (select market_id, count(*) as n_quotes from prices group by all),
    pre as (select *, case when resolution_type = 'deadline_resolved' and outcome = 0 then 'deadline_NO' else '' end as pre from markets
            where t_resolve is not null and resolution_type <> 'unclassifiable'),
    base as (select p.*, b.t_news as t_event, b.confidence as conf, n.n_quotes, (epoch_us(b.t_news) - epoch_us(p.t_open)) / 86400000000.0::double as tau
             from pre p left join (select market_id, t_news, confidence from (select *, row_number() over (partition by market_id order by tier, confidence desc, t_news) as rn from news) where rn = 1) b
             on b.market_id = p.market_id left join nqp n on n.market_id = p.market_id),
    raw as (select market_id, t_open, t_resolve, outcome as p_resolve, t_event, t_event - interval 1 minute as t0 from base
            where pre = '' and conf >= 0.7 and t_event > t_open and outcome is not null),
    refs as (select market_id, t_open, case when t0 <= t_open then t_open else t0 end as t_ref, t_resolve, p_resolve,
             list_filter(['t_event_recovered', case when t0 <= t_open then 'lookback_predates_topen' end], lambda x: x is not null) as lead from raw),
""" + scored("refs") + """,
    casc as (select b.*, s.status, s.p_open as po, s.p_ref as pe, s.ils as ils0, s.flags as fl, s.ils_30min as w1, s.ils_2h as w2, s.ils_6h as w3, s.ils_24h as w4,
      case when resolution_type = 'deadline_resolved' and outcome = 0 then 'deadline_NO'
        when t_event is null or conf < 0.7 then 'low_confidence_t_event' when tau <= 0 then 'negative_tau' when coalesce(n_quotes, 0) = 0 then 'no_quote_coverage'
        when coalesce(s.status, 'missing') <> 'ok' then 'ils_compute_error: ' || coalesce(s.status, 'missing')
        when abs(s.p_open - 0.5) >= 0.4 then 'edge_effect' when abs(coalesce(outcome, 0) - coalesce(s.p_open, 0.5)) < 0.05 then 'trivial_resolution'
        when s.ils is null then 'ils_null: ' || s.flags else '' end as reason from base b left join scores s on s.market_id = b.market_id)
"""
_POP_COLS = ("market_id category subcategory period resolution_type t_event:t tau_days:d volume_usdc:d p_open:d p_event:d p_resolve:l ils_dl:d ils_dl_30min:d "
             "ils_dl_2h:d ils_dl_6h:d ils_dl_24h:d in_scope:b exclusion_reason ils_dl_ci_low:d ils_dl_ci_high:d")


def _events(v):
    from tidemark.operators.features import best_news
    return best_news(v.news).select("market_id", F.col("t_news").alias("t_event"), "confidence", F.lit(1).alias("n_sources"))


_POISSON = " ".join(f"when u < {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} then {k}" for k in range(14))
# the weighted resample of every in-scope market's YES trades, repeated by the shared digest
_POP_CI = f""",
    yes as (select t.market_id, t.tx_hash || ':' || t.log_index as id, t.price::double as x, t.notional_usdc::double as w from trades t
            join casc c on c.market_id = t.market_id and c.reason = '' where t.outcome_index = 1 and t.ts between c.t_open and c.t_event),
    yes_n as (select market_id, count(*) as n_trades from yes group by all),
    drawn as (select *, case {_POISSON} end as k from (select yes.*, b, (('0x' || substring(md5('20260430|' || ((b - 1) // 4) || '|' || id), 8 * ((b - 1) % 4) + 1, 8))::bigint) / 4294967296.0::double as u
              from yes cross join (select unnest(range(1, {C.BOOTSTRAP_B} + 1)) as b))),
    reps as (select market_id, b, sum(k * w * x) / nullif(sum(k * w), 0) as m from drawn where k > 0 group by all),
    ci as (select r.market_id, count((m - po) / nullif(outcome - po, 0)) as n_valid, quantile_cont((m - po) / nullif(outcome - po, 0), 0.025) as lo,
           quantile_cont((m - po) / nullif(outcome - po, 0), 0.975) as hi from reps r join casc c on c.market_id = r.market_id group by all),
    ok as (select c.market_id, round(lo, 6) as lo, round(hi, 6) as hi from casc c join ci on ci.market_id = c.market_id join yes_n n on n.market_id = c.market_id
           where n_trades >= 50 and abs(outcome - po) >= 0.05 and n_valid >= {C.BOOTSTRAP_B} * {C.MIN_VALID_SHARE})
"""


@query("population_ils", _POP_COLS, _POP_SQL + _POP_CI + f"""
    select casc.market_id, category, case when category = 'regulatory_decision' then {_SUB} end as subcategory,
      case when t_resolve::date < date '2024-11-01' then 'pre_2024' else 'post_2024' end as period, resolution_type,
      case when pre = '' and conf >= 0.7 then t_event end as t_event, case when pre = '' and conf >= 0.7 then tau end as tau_days, volume as volume_usdc,
      case when reason in ('', 'edge_effect', 'trivial_resolution') then po end as p_open, case when reason = '' then pe end as p_event, outcome as p_resolve,
      case when reason = '' then ils0 end as ils_dl, case when reason = '' then w1 end as ils_dl_30min, case when reason = '' then w2 end as ils_dl_2h,
      case when reason = '' then w3 end as ils_dl_6h, case when reason = '' then w4 end as ils_dl_24h, reason = '' as in_scope,
      case when reason = '' and ok.lo is null then 'low_trade_count' else reason end as exclusion_reason, ok.lo as ils_dl_ci_low, ok.hi as ils_dl_ci_high
      from casc left join ok on ok.market_id = casc.market_id""")
def population_ils(v):
    return pop.with_intervals(staged(pop.population_scores(v.markets, _events(v), v.prices, v.trades, v.history)), v.trades, portable=True)


_REASONS = ["deadline_NO", "low_confidence_t_event", "negative_tau", "no_quote_coverage", "ils_compute_error", "edge_effect", "trivial_resolution", "ils_null"]


@query("scope_cascade", "exclusion_reason n:l", _POP_SQL + " select string_split(reason, ':')[1] as exclusion_reason, count(*) as n from casc group by all")
def scope_cascade(v):
    p = pop.population_scores(v.markets, _events(v), v.prices, v.trades, v.history)
    return p.groupBy(F.split("exclusion_reason", ":")[0].alias("exclusion_reason")).agg(F.count("*").alias("n"))


@query("filter_attrition", "step:l stage n:l dropped:l", _POP_SQL + """,
    r as (select list_position(['deadline_NO', 'low_confidence_t_event', 'negative_tau', 'no_quote_coverage', 'ils_compute_error', 'edge_effect', 'trivial_resolution', 'ils_null'],
          string_split(reason, ':')[1]) as pos from casc),
    s as (select i as step, count(*) filter (coalesce(pos, 0) = 0 or pos > i) as n from r cross join (select unnest(range(9)) as i) group by i)
    select step, case when step = 0 then 'initial' else 'after_' || ['deadline_NO', 'low_confidence_t_event', 'negative_tau', 'no_quote_coverage', 'ils_compute_error', 'edge_effect',
      'trivial_resolution', 'ils_null'][step] end as stage, n, coalesce(lag(n) over (order by step) - n, 0) as dropped from s""")
def filter_attrition(v):
    return au.filter_attrition(pop.population_scores(v.markets, _events(v), v.prices, v.trades, v.history), _REASONS)


@query("regulatory_subcategory", "market_id subcategory", f"""
    select market_id, case when category = 'regulatory_decision' then {_SUB} end as subcategory from population""")
def regulatory_subcategory(v):
    return pop.with_regulatory_subcategory(v.population)


@query("regulatory_review_sample", "market_id question subcategory manual_subcategory agreement", f"""
    select market_id, question, {_SUB} as subcategory, '' as manual_subcategory, '' as agreement from population where category = 'regulatory_decision'
    order by md5('{C.SEED}|' || market_id), market_id limit 50""")
def regulatory_review_sample(v):
    return pop.review_sample(v.population)


_VALS = "list_filter([ils_dl, ils_dl_30min, ils_dl_2h, ils_dl_6h, ils_dl_24h], lambda x: x is not null)"
_ANCHOR = f"""{_COMP}, a as (select *, {_VALS} as vals from comp),
    fl as (select *, case when len(vals) < 2 then '' when list_max(vals) >= 0 and list_min(vals) < 0 then 'sign_flip'
      when list_max(vals) - list_min(vals) > 0.3 then 'spread' else '' end as reason from a)"""


@query("anchor_robust", "market_id anchor_robust:b reason", "with " + _ANCHOR + " select market_id, reason = '' as anchor_robust, reason from fl")
def anchor_robust(v):
    return pop.anchor_flags(v.population).select("market_id", "anchor_robust",
                                                 F.split("anchor_failure_reason", "_[0-9]")[0].alias("reason"))


@query("anchor_summary", "category n_total:l n_anchor_robust:l pct_anchor_robust:d spearman:d", "with " + _ANCHOR + """,
    r as (select category, rank() over (partition by category order by ils_dl) + (count(*) over (partition by category, ils_dl) - 1) / 2.0 as ra,
      rank() over (partition by category order by ils_dl_24h) + (count(*) over (partition by category, ils_dl_24h) - 1) / 2.0 as rb from comp where ils_dl_24h is not null),
    c as (select category, round(corr(ra, rb), 4) as spearman from r group by all having count(*) >= 5)
    select fl.category, count(*) as n_total, count(*) filter (reason = '') as n_anchor_robust, round(100.0::double * count(*) filter (reason = '') / count(*), 1) as pct_anchor_robust,
      any_value(c.spearman) as spearman from fl left join c on c.category = fl.category group by fl.category""")
def anchor_summary(v):
    return pop.anchor_summary(v.population)


@query("spearman", "category n_pairs:l spearman:d verdict", """
    with r as (select category, rank() over (partition by category order by ils_dl_6h) + (count(*) over (partition by category, ils_dl_6h) - 1) / 2.0 as ra,
      rank() over (partition by category order by ils_dl_24h) + (count(*) over (partition by category, ils_dl_24h) - 1) / 2.0 as rb
      from population where ils_dl_24h is not null and ils_dl_6h is not null)
    select category, count(*) as n_pairs, corr(ra, rb) as spearman, case when corr(ra, rb) > 0.7 then 'robust' when corr(ra, rb) > 0.4 then 'moderate' else 'sensitive' end as verdict
    from r group by all""")
def spearman(v):
    return pop.spearman(v.population, ["category"], "ils_dl_6h", "ils_dl_24h").withColumn("verdict", pop.verdict(F.col("spearman")))


_ADJ = _COMP + """,
    cells as (select category, subcategory, period, case when count(tau_days) >= 5 then 1 / avg(tau_days) else (select 1 / avg(tau_days) from comp) end as lam from comp group by all),
    j as (select c.*, l.lam, (epoch_us(t_resolve) - epoch_us(t_open)) / 86400000000.0::double as tt from comp c join cells l
          on l.category is not distinct from c.category and l.subcategory is not distinct from c.subcategory and l.period is not distinct from c.period),
    e as (select *, case when 1 - exp(-lam * tt) < 1e-9 then p_open else greatest(0, least(1, p_open * (exp(-lam * greatest(tt - tau_days, 0)) - exp(-lam * tt)) / (1 - exp(-lam * tt)))) end as edp from j),
    adj as (select *, case when abs(p_resolve - p_open) < 1e-6 then null else (p_event - edp) / (p_resolve - p_open) end as ils_dl_adj from e)
"""


@query("hazard_adjusted_ils", "market_id expected_decay_price:d ils_dl_adj:d adj_method", "with " + _ADJ + """
    select market_id, edp as expected_decay_price, ils_dl_adj, case when ils_dl_adj is null then 'trivial_resolution' else 'exp_hazard' end as adj_method from adj""")
def hazard_adjusted_ils(v):
    return pop.hazard_adjusted(v.population)


@query("cell_param_lookup", _CELL_COLS + " n:l lam:d", "with " + _ADJ + """
    select category, subcategory, period, count(*) as n, max(lam) as lam from adj group by all""")
def cell_param_lookup(v):
    return pop.hazard_adjusted(v.population).groupBy(*CELL).agg(F.count("*").alias("n"), F.max("lam").alias("lam"))


_BUCKET = """case when coalesce(subcategory, '') like '%announcement%' then 'regulatory_announcement'
    when coalesce(subcategory, '') like '%formal%' then 'regulatory_formal' else 'other' end"""


@query("hazard_adjusted_summary", "bucket period kind n:l mean:d std:d p10:d p25:d p50:d p75:d p90:d", "with " + _ADJ + f""",
    l as (select {_BUCKET} as bucket, period, 'raw' as kind, ils_dl as x from adj union all select {_BUCKET}, period, 'adj', ils_dl_adj from adj)
    select bucket, period, kind, count(x) as n, avg(x) as mean, stddev_pop(x) as std, quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.25) as p25, quantile_cont(x, 0.5) as p50,
      quantile_cont(x, 0.75) as p75, quantile_cont(x, 0.9) as p90 from l group by all having count(x) >= 3""")
def hazard_adjusted_summary(v):
    return pop.hazard_adjusted_summary(pop.hazard_adjusted(v.population))


_QS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


@query("distribution_summary", _CELL_COLS + " n:l statistic value:d", "with " + _COMP + f""",
    m as (select category, subcategory, period, avg(ils_dl) as mu from comp group by all),
    c as (select c.*, m.mu from comp c join m on m.category is not distinct from c.category and m.subcategory is not distinct from c.subcategory and m.period is not distinct from c.period),
    w as (select category, subcategory, period, count(*) as n, avg(ils_dl) as mean, median(ils_dl) as median, stddev_pop(ils_dl) as std,
      avg(pow(ils_dl - mu, 3)) / pow(avg(pow(ils_dl - mu, 2)), 1.5) as skewness, kurtosis_pop(ils_dl) as kurtosis,
      {', '.join(f'quantile_cont(ils_dl, {q / 100}) as p{q:02d}' for q in _QS)} from c group by all having count(*) >= 5)
    unpivot w on mean, median, std, skewness, kurtosis, {', '.join(f'p{q:02d}' for q in _QS)} into name statistic value value""")
def distribution_summary(v):
    return pop.distribution_summary(v.population)


@query("detection_thresholds", _CELL_COLS + " n:l top_10:d top_5:d top_1:d", "with " + _COMP + """
    select category, subcategory, period, count(*) as n, quantile_cont(ils_dl, 0.9) as top_10, quantile_cont(ils_dl, 0.95) as top_5, quantile_cont(ils_dl, 0.99) as top_1
    from comp group by all having count(*) >= 5""")
def detection_thresholds(v):
    return pop.detection_thresholds(v.population)


@query("detection_threshold_ci", _CELL_COLS + " stat n_valid:l ci_low:d ci_high:d")
def detection_threshold_ci(v):
    reps = rs.percentile_replicates(pop.computed(v.population), CELL, "ils_dl", {"top_10": 0.9, "top_5": 0.95, "top_1": 0.99}, C.BOOTSTRAP_B)
    return rs.interval(reps, [*CELL, "stat"], "value")


_CASES = """cs as (select line->>'$.case_id' as case_id, coalesce(line->>('$.markets[' || i || '].market_id_prefix'), line->>('$.markets[' || i || '].market_id'), '') as prefix
      from (select line, unnest(range(json_array_length(line, '$.markets')::bigint)) as i from case_lines)),
    rk as (select market_id, ils_dl, substring(market_id, 1, 10) as prefix, cume_dist() over (partition by category, subcategory, period order by ils_dl) as cume,
      count(*) over (partition by category, subcategory, period) as cell_n from comp),
    hit as (select prefix, arg_min(struct_pack(m := market_id, i := ils_dl, c := cume, n := cell_n), market_id) as h from rk group by prefix),
    pp as (select substring(market_id, 1, 10) as prefix, arg_min(exclusion_reason, market_id) as er from population group by 1),
    tt as (select substring(market_id, 1, 10) as prefix, arg_min('pre_filtered: cat=' || coalesce(category, 'None') || ', res_type=' || coalesce(resolution_type, 'None') || ', outcome=' || coalesce(outcome::varchar, 'None'), market_id) as t from markets group by 1),
    loc as (select cs.case_id, cs.prefix, h.m as market_id, h.i as ils_dl, case when h.n >= 2 then round(h.c * 100, 2) end as rank_pctile, h.c * 100 as pct, h.n as cell_n,
      case when h.m is not null then case when h.n < 2 then 'cell_too_small' else '' end when pp.er is not null then 'in_population_excluded: ' || pp.er when tt.t is not null then tt.t
        when cs.prefix <> '' then 'not_in_typology' else 'no_market_id' end as note
      from cs left join hit on hit.prefix = cs.prefix left join pp on pp.prefix = cs.prefix left join tt on tt.prefix = cs.prefix)"""


def _localised(v):
    return pop.localise_cases(pop.flatten_cases(v.case_lines), v.population, v.markets)


@query("case_localise_join", "case_id prefix market_id ils_dl:d note", "with " + _COMP + ", " + _CASES + " select * from loc")
def case_localise_join(v):
    return _localised(v)


@query("rank_in_cell", "case_id prefix rank_pctile:d in_top_10:b in_top_5:b in_top_1:b", "with " + _COMP + ", " + _CASES + """
    select *, case when cell_n >= 2 then pct >= 90 end as in_top_10, case when cell_n >= 2 then pct >= 95 end as in_top_5, case when cell_n >= 2 then pct >= 99 end as in_top_1 from loc""")
def rank_in_cell(v):
    return _localised(v)


@query("rank_bootstrap_ci", "case_id prefix rank_pctile:d ci_low:d ci_high:d")
def rank_bootstrap_ci(v):
    d = _localised(v).where("rank_pctile is not null")
    ci = rs.proportion_interval(F.col("cell_n"), F.round(F.col("cume") * F.col("cell_n")), F.concat_ws("|", "case_id", "prefix"), C.BOOTSTRAP_B)
    return d.withColumn("ci", ci).select("case_id", "prefix", "rank_pctile", (F.col("ci.ci_low") * 100).alias("ci_low"), (F.col("ci.ci_high") * 100).alias("ci_high"))


@query("binomial_concordance", "threshold n:l observed:l expected:d p_value:d", "with " + _COMP + ", " + _CASES + """,
    x as (select pct from loc where cell_n >= 2), n as (select count(*) as n from x),
    o as (select 'top_10' as threshold, 0.1::double as p, count(*) filter (pct >= 90) as k from x union all select 'top_5', 0.05, count(*) filter (pct >= 95) from x
      union all select 'top_1', 0.01, count(*) filter (pct >= 99) from x)
    select threshold, n, k as observed, round(n * p, 2) as expected, round((select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))
      from (select unnest(range(k, n + 1)) as i) r), 4) as p_value from o, n""")
def binomial_concordance(v):
    return fits.binomial_concordance(_localised(v))


@query("cell_cume_dist", "market_id cume:d cell_n:l", "with " + _COMP + """
    select market_id, cume_dist() over (partition by category, subcategory, period order by ils_dl) as cume, count(*) over (partition by category, subcategory, period) as cell_n from comp""")
def cell_cume_dist(v):
    return rk.with_ranks(pop.computed(v.population), CELL, "ils_dl")


@query("average_rank", "market_id avg_rank:d", """
    select market_id, rank() over (partition by category order by p_open) + (count(*) over (partition by category, p_open) - 1) / 2.0 as avg_rank from population""")
def average_rank(v):
    return rk.with_ranks(v.population, ["category"], "p_open")


_TAIL = "with " + _COMP + """,
    t as (select market_id, category, ils_dl from (select *, row_number() over (order by ils_dl desc, market_id) as a, row_number() over (order by ils_dl, market_id) as b from comp) where a <= 10 or b <= 10)
    select *, row_number() over (order by ils_dl desc, market_id) as rank from t"""


@query("tail_review", "market_id category ils_dl:d rank:l", _TAIL)
def tail_review(v):
    return pop.tail_review(v.population)


@query("nlargest_nsmallest", "market_id ils_dl:d", _TAIL)
def nlargest_nsmallest(v):
    return pop.tail_review(v.population)


@query("concat_dedupe", "category market_id", """
    select distinct category, market_id from (select category, market_id from scored where ils >= 1 union all select category, market_id from scored where volume_pre_share > 0.9)""")
def concat_dedupe(v):
    s = v.scored.select("category", "market_id", "ils", "volume_pre_share")
    return s.where("ils >= 1").unionByName(s.where("volume_pre_share > 0.9")).dropDuplicates(["market_id"])


@query("ranked_list", "market_id rank:l", """
    select market_id, row_number() over (order by ils desc nulls last, market_id) as rank from scored""")
def ranked_list(v):
    return rk.with_place(v.scored, "ils", "market_id", "rank")


_PROXY = SERIES + """,
    snapped as (select m.market_id, m.t_resolve, m.outcome as p_resolve, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000 then b.first_ts else m.t_open end as t_open from sc m join bounds b on b.market_id = m.market_id),
    op as (select r.market_id, arg_min(s.p, s.ts) as p_open from snapped r join series s on s.market_id = r.market_id and s.ts between date_trunc('minute', r.t_open) and date_trunc('minute', r.t_open) + interval 24 hour group by all),
    q as (select r.*, o.h, r.t_resolve - to_hours(o.h) as t from snapped r, (select unnest([24, 6, 2, 1]) as h) o),
    rp as (select q.market_id, q.h, arg_min(s.p, (abs(epoch(s.ts - date_trunc('minute', q.t))), s.ts)) as p_ref from q join series s on s.market_id = q.market_id
      and s.ts between date_trunc('minute', q.t) - interval 5 minute and date_trunc('minute', q.t) + interval 5 minute where q.t >= q.t_open group by all),
    sw as (select q.market_id, q.h, case when abs(q.p_resolve - op.p_open) >= 0.05 then round_even((rp.p_ref - op.p_open) / (q.p_resolve - op.p_open), 6) end as ils
      from q left join op on op.market_id = q.market_id left join rp on rp.market_id = q.market_id and rp.h = q.h)"""


@query("proxy_summary", "offset_hours:l n:l median:d mean:d pct_pos:d pct_extreme:d", _PROXY + """
    select h as offset_hours, count(ils) as n, median(ils) as median, avg(ils) as mean, 100.0 * count(*) filter (ils > 0) / count(ils) as pct_pos,
      100.0 * count(*) filter (abs(ils) > 1) / count(ils) as pct_extreme from sw where ils is not null group by h""")
def proxy_summary(v):
    return au.proxy_summary(plan.offset_sweep(v.markets, v.prices, v.trades, history=v.history))


@query("monotone_trend", "n_aligned:l n_increasing:l n_decreasing:l", _PROXY + """,
    w as (select market_id, max(ils) filter (h = 24) as a, max(ils) filter (h = 6) as b, max(ils) filter (h = 2) as c, max(ils) filter (h = 1) as d from sw group by all)
    select count(*) as n_aligned, count(*) filter (a <= b and b <= c and c <= d) as n_increasing, count(*) filter (a >= b and b >= c and c >= d) as n_decreasing
    from w where a is not null and b is not null and c is not null and d is not null""")
def monotone_trend(v):
    return au.monotone_trend(plan.offset_sweep(v.markets, v.prices, v.trades, history=v.history), [24, 6, 2, 1])


@query("group_comparison", "grp n:l median:d mean:d min:d max:d pct_pos:d", """
    select resolution_type as grp, count(*) as n, median(ils_dl) as median, avg(ils_dl) as mean, min(ils_dl) as min, max(ils_dl) as max,
      100.0 * count(*) filter (ils_dl > 0) / count(*) as pct_pos from population group by all""")
def group_comparison(v):
    return au.group_comparison(v.population.withColumn("grp", F.col("resolution_type")), ["grp"], "ils_dl")


@query("group_category_medians", "category pilot:d control:d delta:d", """
    select category, median(ils_dl) filter (resolution_type = 'event_resolved') as pilot, median(ils_dl) filter (resolution_type = 'unclassifiable') as control,
      median(ils_dl) filter (resolution_type = 'event_resolved') - median(ils_dl) filter (resolution_type = 'unclassifiable') as delta from population group by category""")
def group_category_medians(v):
    m = au.group_comparison(v.population, ["category", "resolution_type"], "ils_dl")
    one = lambda t: F.max(F.when(F.col("resolution_type") == t, F.col("median")))
    return m.groupBy("category").agg(one("event_resolved").alias("pilot"), one("unclassifiable").alias("control")) \
        .withColumn("delta", F.col("pilot") - F.col("control"))


# ------------------------------------------------------------------ hazards
_DELAYS = "del as (select * from population where in_scope and tau_days > 0)"


@query("hazard_exponential", _CELL_COLS + " n:l lambda_hat:d half_life_days:d mean_tau_days:d tau_p25:d tau_p50:d tau_p75:d", "with " + _DELAYS + """
    select category, subcategory, period, count(*) as n, 1 / avg(tau_days) as lambda_hat, ln(2) * avg(tau_days) as half_life_days, avg(tau_days) as mean_tau_days,
      quantile_cont(tau_days, 0.25) as tau_p25, quantile_cont(tau_days, 0.5) as tau_p50, quantile_cont(tau_days, 0.75) as tau_p75 from del group by all having count(*) >= 20""")
def hazard_exponential(v):
    return fits.hazard_exponential(fits.positive_delays(v.population))


def _drawn(rows, row_id):
    """SQL of the portable draws: ``rows`` with replicate b and Poisson count k, four replicates to a digest of seed, four and row."""
    return (f"(select *, case {_POISSON} end as k from (select r.*, b, (('0x' || substring(md5('20260430|' || ((b - 1) // 4) || '|' || {row_id}), 8 * ((b - 1) % 4) + 1, 8))::bigint) / 4294967296.0::double as u "
            f"from {rows} r cross join (select unnest(range(1, {C.BOOTSTRAP_B} + 1)) as b)))")


@query("lambda_bootstrap_ci", _CELL_COLS + " n_valid:l ci_low:d ci_high:d", "with " + _DELAYS + f""",
    reps as (select category, subcategory, period, b, sum(k) / sum(k * tau_days) as lam from {_drawn('del', 'market_id')} group by all having sum(k) > 0)
    select category, subcategory, period, count(lam) as n_valid, quantile_cont(lam, 0.025) as ci_low, quantile_cont(lam, 0.975) as ci_high from reps group by all""")
def lambda_bootstrap_ci(v):
    reps = rs.replicate_means(fits.positive_delays(v.population), CELL, "market_id", "tau_days", replicates=C.BOOTSTRAP_B, portable=True)
    return rs.interval(reps.withColumn("lam", 1.0 / F.col("mean")), CELL, "lam")


def _narrowed(k):
    """SQL of one bisection round on 32 parts: the score of the Weibull shape rises, so the parts left of its root are counted."""
    at = "lo + (hi - lo) * j / 32"
    score = (f"list_sum(list_transform(ys, lambda y: y * exp(({at}) * y))) / list_sum(list_transform(ys, lambda y: exp(({at}) * y))) - 1 / ({at})")
    return (f"w{k + 1} as (select category, subcategory, period, n, ml, ys, lo + (hi - lo) * j / 32 as lo, lo + (hi - lo) * (j + 1) / 32 as hi "
            f"from (select *, len(list_filter(range(1, 32), lambda j: {score} <= 0)) as j from w{k}))")


_ROUNDS = 8
_FORMS = "with " + _DELAYS + f""",
    st as (select category, subcategory, period, count(*) as n, avg(tau_days) as m, avg(ln(tau_days)) as ml, stddev_pop(ln(tau_days)) as sl, list(ln(tau_days)) as ls from del group by all having count(*) >= 20),
    w0 as (select category, subcategory, period, n, ml, list_transform(ls, lambda x: x - ml) as ys, 0.02::double as lo, 60::double as hi from st),
    {", ".join(map(_narrowed, range(_ROUNDS)))},
    wb as (select *, (lo + hi) / 2 as k, ml + ln(list_avg(list_transform(ys, lambda y: exp((lo + hi) / 2 * y)))) / ((lo + hi) / 2) as ls from w{_ROUNDS}),
    fm as (select category, subcategory, period, n, 'exponential' as distribution, 1 as k, -n * (ln(m) + 1) as ll, m as scale, null::double as shape from st
      union all select category, subcategory, period, n, 'lognormal', 2, -n * (ml + ln(sl) + 0.5 * ln(2 * pi()) + 0.5), exp(ml), sl from st
      union all select category, subcategory, period, n, 'weibull', 2, n * (ln(k) - k * ls + (k - 1) * ml - 1), exp(ls), k from wb)"""


# the normal distribution as the series exp(-x^2) * sum 4^k k! x^(2k+1) / (2k+1)!, x = z / sqrt(2); beyond 8 it is 0 or 1 in 15 digits
_Z = "ln(d.tau_days / f.scale) / f.shape"
_PHI = f"""case when abs({_Z}) > 8 then case when {_Z} > 0 then 1 else 0 end else 0.5 + coalesce(sign({_Z}) / sqrt(pi()) * list_sum(list_transform(range(0, 160),
      lambda k: exp(k * ln(4) + (2 * k + 1) * ln(nullif(abs({_Z}), 0) / sqrt(2)) + lgamma(k + 1) - lgamma(2 * k + 2) - pow({_Z}, 2) / 2))), 0) end"""


_KS = _FORMS + f""",
    r as (select d.category, d.subcategory, d.period, f.distribution, case f.distribution when 'exponential' then 1 - exp(-d.tau_days / f.scale)
        when 'weibull' then 1 - exp(-pow(d.tau_days / f.scale, f.shape)) else {_PHI} end as cdf,
        row_number() over (partition by d.category, d.subcategory, d.period, f.distribution order by d.tau_days) as i, f.n
      from del d join fm f on f.category is not distinct from d.category and f.subcategory is not distinct from d.subcategory and f.period is not distinct from d.period),
    k as (select category, subcategory, period, distribution, max(greatest(cdf - (i - 1) / n::double, i / n::double - cdf)) as ks, max(n) as n from r group by all),
    x as (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * ks as x from k),
    kp as (select *, case when x < 0.2 then 1 else greatest(0, least(1, (select sum(2 * pow(-1, j - 1) * exp(-2 * j * j * x * x)) from (select unnest(range(1, 41)) as j) q))) end as ks_pvalue from x)"""


@query("functional_form", _CELL_COLS + " distribution n:l log_lik:d aic:d bic:d ks:d ks_pvalue:d", _KS + """
    select fm.*, ll as log_lik, 2 * k - 2 * ll as aic, k * ln(fm.n) - 2 * ll as bic, ks, ks_pvalue from fm join kp on kp.category is not distinct from fm.category
      and kp.subcategory is not distinct from fm.subcategory and kp.period is not distinct from fm.period and kp.distribution = fm.distribution""")
def functional_form(v):
    return fits.forms_with_ks(fits.positive_delays(v.population))


@query("functional_form_weibull", _CELL_COLS + " distribution n:l log_lik:d scale:d shape:d", _FORMS + " select *, ll as log_lik from fm where distribution = 'weibull'")
def functional_form_weibull(v):
    return fits.functional_forms(fits.positive_delays(v.population)).where("distribution = 'weibull'")


@query("functional_form_winner", _CELL_COLS + " winner aic_delta:d", _FORMS + """,
    a as (select *, 2 * k - 2 * ll as aic from fm)
    select category, subcategory, period, arg_min(distribution, aic) as winner, round(list_sort(list(aic))[2] - min(aic), 3) as aic_delta from a group by all""")
def functional_form_winner(v):
    return fits.best_form(fits.functional_forms(fits.positive_delays(v.population)))


@query("ks_statistic", _CELL_COLS + " distribution ks:d n:l ks_pvalue:d", _KS + " select * from kp")
def ks_statistic(v):
    d = fits.positive_delays(v.population)
    return fits.ks_statistic(d, fits.functional_forms(d))


@query("ks_parametric_bootstrap", _CELL_COLS + " distribution ks:d n:l ks_pvalue_bootstrap:d")
def ks_parametric_bootstrap(v):
    d = fits.positive_delays(v.population)
    return fits.ks_parametric_bootstrap(fits.ks_statistic(d, fits.functional_forms(d)))


@query("mann_whitney_u", "u:d n1:l n2:l z:d", """
    with p as (select resolution_type as g, ils_dl as x from population where resolution_type in ('event_resolved', 'unclassifiable') and ils_dl is not null),
    r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rk from p),
    t as (select sum(c * c * c - c)::double as ties from (select count(*)::double as c from p group by x)),
    a as (select sum(rk) filter (g = 'event_resolved') as r1, (count(*) filter (g = 'event_resolved'))::double as n1, (count(*) filter (g <> 'event_resolved'))::double as n2 from r)
    select r1 - n1 * (n1 + 1) / 2 as u, n1, n2, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) as z from a, t""")
def mann_whitney_u(v):
    return fits.mann_whitney(v.population, "resolution_type", "ils_dl", "event_resolved", "unclassifiable")


@query("mann_whitney_p", "p:d r:d verdict")
def mann_whitney_p(v):
    m = fits.mann_whitney(v.population, "resolution_type", "ils_dl", "event_resolved", "unclassifiable")
    return au.one_row(m, _median_diff_interval(v)).withColumn("verdict", au.comparison_verdict(F.col("p"), F.col("ci_lo"), F.col("ci_hi")))


# --------------------------------------------------------------- resampling

@query("bootstrap_engine", _CELL_COLS + " b:l mean:d", "with " + _COMP + f""",
    u as (select c.*, b, (('0x' || substring(md5('20260430|' || ((b - 1) // 4) || '|' || market_id), 8 * ((b - 1) % 4) + 1, 8))::bigint) / 4294967296.0::double as u from comp c cross join (select unnest(range(1, {C.BOOTSTRAP_B} + 1)) as b)),
    w as (select *, case {_POISSON} end as k from u)
    select category, subcategory, period, b, sum(k * ils_dl) / sum(k) as mean from w group by all having sum(k) > 0""")
def bootstrap_engine(v):
    return rs.replicate_means(pop.computed(v.population), CELL, "market_id", "ils_dl", replicates=C.BOOTSTRAP_B, portable=True)


@query("bootstrap_ils_ci", "market_id n_trades:l ci_low:d ci_high:d", SERIES + """,
    refs as (select m.market_id, case when epoch_us(b.first_ts) - epoch_us(m.t_open) > 300000000 then b.first_ts else m.t_open end as t_open, n.t_news as t_ref, m.t_resolve,
             m.outcome as p_resolve, []::varchar[] as lead from sc m join best n on n.market_id = m.market_id join bounds b on b.market_id = m.market_id),
""" + scored("refs") + f""",
    yes as (select t.market_id, t.tx_hash || ':' || t.log_index as id, t.price::double as x, t.notional_usdc::double as w from trades t join scores c on c.market_id = t.market_id
            where t.outcome_index = 1 and t.ts between c.t_open and c.t_ref),
    yes_n as (select market_id, count(*) as n_trades from yes group by all),
    reps as (select market_id, b, sum(k * w * x) / nullif(sum(k * w), 0) as m from {_drawn('yes', 'id')} where k > 0 group by all),
    ci as (select r.market_id, count((m - p_open) / nullif(p_resolve - p_open, 0)) as n_valid, quantile_cont((m - p_open) / nullif(p_resolve - p_open, 0), 0.025) as lo,
           quantile_cont((m - p_open) / nullif(p_resolve - p_open, 0), 0.975) as hi from reps r join scores c on c.market_id = r.market_id group by all),
    ok as (select c.*, coalesce(n_trades >= 50 and abs(p_resolve - p_open) >= 0.05 and n_valid >= {C.BOOTSTRAP_B} * {C.MIN_VALID_SHARE}, false) as ok, n_trades, lo, hi
           from scores c left join ci on ci.market_id = c.market_id left join yes_n n on n.market_id = c.market_id)
    select market_id, n_trades, case when ok then round(lo, 6) end as ci_low, case when ok then round(hi, 6) end as ci_high from ok""")
def bootstrap_ils_ci(v):
    points, bounds = v.history, ser.history_bounds(v.history)
    refs = plan.snap_open(plan.standard_refs(v.markets, v.news), bounds)
    s = plan.score(refs, points, bounds).select("market_id", "t_open", F.col("t_ref").alias("t_event"), "p_open", "p_resolve")
    return rs.score_interval(v.trades, staged(s), portable=True)


def _buckets(v):
    return pop.computed(v.population).withColumn("bucket", fi.study_bucket(F.col("subcategory")))


@query("bootstrap_median_ci", "bucket period n_valid:l ci_low:d ci_high:d")
def bootstrap_median_ci(v):
    return rs.interval(rs.percentile_replicates(_buckets(v), ["bucket", "period"], "ils_dl", {"median": 0.5}), ["bucket", "period"], "value")


@query("bootstrap_fraction_positive", "bucket period n:l frac_positive:d", "with " + _COMP + f"""
    select {_BUCKET} as bucket, period, count(*) as n, avg((ils_dl > 0)::int) as frac_positive from comp group by all having count(*) >= 3""")
def bootstrap_fraction_positive(v):
    return _fraction(v)


def _fraction(v):
    return _buckets(v).groupBy("bucket", "period").agg(
        F.count("*").alias("n"), F.count_if(F.col("ils_dl") > 0).alias("k"),
        F.avg((F.col("ils_dl") > 0).cast("int")).alias("frac_positive")).where("n >= 3")


@query("fraction_positive_ci", "bucket period frac_positive:d ci_low:d ci_high:d")
def fraction_positive_ci(v):
    d = _fraction(v).withColumn("ci", rs.proportion_interval(F.col("n"), F.col("k"), F.concat_ws("|", "bucket", "period")))
    return d.select("bucket", "period", "frac_positive", "ci.ci_low", "ci.ci_high")


def _median_diff_interval(v):
    two = v.population.where("resolution_type in ('event_resolved', 'unclassifiable')")
    reps = rs.percentile_replicates(two, ["resolution_type"], "ils_dl", {"median": 0.5})
    side = lambda t: F.max(F.when(F.col("resolution_type") == t, F.col("value")))
    diff = reps.groupBy("b").agg((side("event_resolved") - side("unclassifiable")).alias("d"))
    n = C.CELL_BOOTSTRAP_B
    return diff.agg(F.sort_array(F.collect_list("d")).alias("d")).select(  # one value per replicate
        F.try_element_at("d", F.lit(int(0.025 * n) + 1)).alias("ci_lo"), F.try_element_at("d", F.lit(int(0.975 * n) + 1)).alias("ci_hi"),
        F.size("d").alias("n_bootstrap"))


@query("bootstrap_median_diff", "median_diff:d ci_lo:d ci_hi:d n_bootstrap:l")
def bootstrap_median_diff(v):
    ci = _median_diff_interval(v)
    two = v.population.where("resolution_type in ('event_resolved', 'unclassifiable')")
    med = rk.percentiles(two, ["resolution_type"], "ils_dl", {"m": 0.5}).agg(
        (F.max(F.when(F.col("resolution_type") == "event_resolved", F.col("m"))) - F.max(F.when(F.col("resolution_type") == "unclassifiable", F.col("m")))).alias("median_diff"))
    return au.one_row(ci, med)


# ------------------------------------------------------------------ samples
@query("stratified_sample", "market_id bucket rn:l", "with " + _COMP + f""",
    s as (select market_id, {_BUCKET} as bucket from comp),
    r as (select *, row_number() over (partition by bucket order by md5('{C.SEED}|' || market_id), market_id) as rn from s)
    select * from r where rn <= case bucket when 'regulatory_announcement' then 12 when 'regulatory_formal' then 18 else 20 end""")
def stratified_sample(v):
    return sa.stratified_sample(_buckets(v), "bucket", "market_id", C.REVIEW_QUOTAS)


@query("proportional_sample", "market_id category rn:l", f"""
    with q as (select category, count(*) / (sum(count(*)) over ())::double as q from population where resolution_type = 'event_resolved' group by category),
    r as (select market_id, category, row_number() over (partition by category order by md5('{C.SEED}|' || market_id), market_id) as rn from population where resolution_type = 'unclassifiable')
    select r.* from r left join q on q.category = r.category where rn <= greatest(1, round_even(coalesce(q.q, 0) * 1000, 0))""")
def proportional_sample(v):
    return sa.proportional_sample(v.population.where("resolution_type = 'unclassifiable'"), v.population.where("resolution_type = 'event_resolved'"),
                                  "category", "market_id", C.CONTROL_TARGET)


_TOPIC = """case k % 6 when 0 then 'geopolitics' when 1 then 'politics' when 2 then 'sports' when 3 then 'crypto' when 4 then 'economics' else 'entertainment' end"""
_QUOTA_SQL = f"""
    with c as (select m.market_id, {_TOPIC.replace('k %', 'num %')} as topic, m.t_resolve - interval 24 hour as cutoff from markets m
      where m.outcome is not null and m.t_resolve is not null),
    ok as (select c.* from c where exists (select 1 from trades t where t.market_id = c.market_id and t.ts < c.cutoff)
           or exists (select 1 from prices p where p.market_id = c.market_id and p.ts < c.cutoff)),
    r as (select *, row_number() over (partition by topic order by md5('{C.SEED}|' || market_id), market_id) as rn, case when topic in ('geopolitics', 'entertainment') then 20 else 16 end as q,
      case topic when 'politics' then 'geopolitics' when 'geopolitics' then 'politics' when 'crypto' then 'economics' when 'economics' then 'crypto' when 'sports' then 'entertainment' else 'sports' end as sib from ok),
    own as (select market_id, topic, topic as slot from r where rn <= q),
    short as (select t.slot, t.q - coalesce(n, 0) as short from (select distinct topic as slot, q from r) t left join (select slot, count(*) as n from own group by slot) o on o.slot = t.slot)
    select market_id, topic, slot from own union all
    select r.market_id, r.topic, s.slot from r join short s on s.slot = r.sib where r.rn > r.q and r.rn - r.q <= s.short"""


@query("quota_sample_with_substitution", "market_id topic slot", _QUOTA_SQL)
def quota_sample_with_substitution(v):
    return sa.quota_sample(_pool(v), "topic", "market_id", _QUOTAS)


_QUOTAS = {t: 20 if t in ("geopolitics", "entertainment") else 16 for t in sa.TOPIC_QUOTAS}


def _pool(v):
    m = plan.scorable(v.markets).withColumn("topic", F.expr(_TOPIC.replace("k %", "num %")))
    cut = m.select("market_id", (F.col("t_resolve") - F.expr("interval 24 hours")).alias("cutoff"))
    base = ser.baseline_price(cut, v.prices, v.trades).where("baseline_price is not null")
    return m.join(base, "market_id")


@query("fixture_export", "marketId question category categoryRule resolutionOutcome:l resolvedAt baselineDate baselineMidPrice:d baselineSource ilsScore:d volumeUsdc:d tradeCount:l eventGroupId isBucketMarket:b", f"""
    with s as ({_QUOTA_SQL}), n as (select market_id, count(*) as n from trades group by all), q as (select distinct p.market_id from prices p join markets m on m.market_id = p.market_id
      where p.ts < m.t_resolve - interval 24 hour),
    bq as (select m.market_id, arg_max(p.mid_price, p.ts)::double as x from markets m join prices p on p.market_id = m.market_id and p.ts < m.t_resolve - interval 24 hour group by all),
    bt as (select m.market_id, 1 - sum(t.size_shares * t.price)::double / sum(t.size_shares)::double as x from markets m join trades t on t.market_id = m.market_id and t.ts < m.t_resolve - interval 24 hour group by all),
    g as (select event_group from markets m where t_resolve >= timestamp '2024-01-01' and outcome in (0, 1) and volume >= {C.MIN_VOLUME} and not coalesce(neg_risk, false)
      and m.market_id in (select market_id from trades) group by all having count(*) >= 3 and sum(outcome) = 1)
    select m.market_id as "marketId", m.question, round(coalesce(bq.x, bt.x), 6) as "baselineMidPrice", null as "ilsScore", s.topic as category, m.category as "categoryRule", m.outcome as "resolutionOutcome", strftime(m.t_resolve, '%Y-%m-%dT%H:%M:%SZ') as "resolvedAt",
      strftime(m.t_resolve - interval 24 hour, '%Y-%m-%dT%H:%M:%SZ') as "baselineDate", case when q.market_id is not null then 'quote_mid' else 'trade_vwap' end as "baselineSource",
      m.volume as "volumeUsdc", n.n as "tradeCount", m.event_group as "eventGroupId", coalesce(m.neg_risk, false)
        or (m.t_resolve >= timestamp '2024-01-01' and m.volume >= {C.MIN_VOLUME} and coalesce(m.event_group in (select event_group from g where event_group is not null), false)) as "isBucketMarket"
    from s join markets m on m.market_id = s.market_id left join n on n.market_id = s.market_id left join q on q.market_id = s.market_id
    left join bq on bq.market_id = s.market_id left join bt on bt.market_id = s.market_id""")
def fixture_export(v):
    s = sa.quota_sample(_pool(v), "topic", "market_id", _QUOTAS)
    groups = au.exclusive_groups(v.markets, v.trades, F.expr("timestamp '2024-01-01'")).select("market_id", F.col("is_bucket_market").alias("_bucket"))
    s = s.join(au.per_market(v.trades, "n_trades"), "market_id", "left").join(groups, "market_id", "left")
    return files.fixture_rows(s.withColumn("is_bucket_market", F.coalesce("neg_risk", F.lit(False)) | F.coalesce("_bucket", F.lit(False))))
