"""Text rules, parsing and event recovery."""

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark import topics
from tidemark.catalog.registry import query
from tidemark.functions import numeric as N
from tidemark.functions import parsing as P
from tidemark.functions import text as T
from tidemark.operators import audits as au
from tidemark.plans import recovery as rec


def _re(p):
    return p.replace("'", "''")


def duck_ts(x):
    """SQL for a date text with an optional offset (the offset is subtracted)."""
    off = r"T.*([+-])([0-9]{2}):?([0-9]{2})$"
    part = lambda i: f"regexp_extract({x}, '{off}', {i})"
    return (f"(try_cast(regexp_replace({x}, '(Z|([+-][0-9]{{2}}:[0-9]{{2}}))$', '') as timestamp) - to_minutes(coalesce("
            f"case {part(1)} when '+' then 1 when '-' then -1 end * (try_cast({part(2)} as int) * 60 + try_cast({part(3)} as int)), 0)))")


_TEXT = "concat_ws(' ', nullif(question, ''), nullif(description, ''), nullif(category_raw, ''))"


@query("classify_category", "market_id assigned", f"""
    select market_id, case {' '.join(f"when regexp_matches({_TEXT}, '{_re(p)}') then '{n}'" for n, p in C.CATEGORY_PATTERNS)}
      else 'other' end as assigned from markets""")
def classify_category(v):
    return v.markets.select("market_id", T.classify_category(F.col("question"), F.col("description"), F.col("category_raw")).alias("assigned"))


_DL_Q = f"regexp_matches(question, '{_re(C.DEADLINE_PATTERN)}')"
_DL_D = f"coalesce(regexp_matches(description, '{_re(C.DEADLINE_PATTERN)}'), false)"


@query("classify_resolution_type", "market_id assigned description_only:b", f"""
    select market_id, case when {_DL_Q} or {_DL_D} then 'deadline_resolved' else 'unclassifiable' end as assigned,
      not {_DL_Q} and {_DL_D} as description_only from markets""")
def classify_resolution_type(v):
    return T.with_resolution_type(v.markets).withColumnRenamed("resolution_type", "assigned")


@query("classification_counts", "resolution_type n:l n_description_only:l", f"""
    select case when {_DL_Q} or {_DL_D} then 'deadline_resolved' else 'unclassifiable' end as resolution_type, count(*) as n,
      count(*) filter (not {_DL_Q} and {_DL_D}) as n_description_only from markets group by all""")
def classification_counts(v):
    return T.classification_counts(v.markets)


def _hits(patterns, text):
    return " + ".join(f"regexp_matches({text}, '{_re(p)}')::int" for p in patterns)


_QD = "concat_ws(' ', question, nullif(description, ''))"


@query("classify_regulatory", "market_id assigned", f"""
    select market_id, case when {_hits(C.ANNOUNCEMENT_PATTERNS, _QD)} > {_hits(C.FORMAL_PATTERNS, _QD)}
      then 'regulatory_decision_announcement' else 'regulatory_decision_formal' end as assigned from markets""")
def classify_regulatory(v):
    return v.markets.select("market_id", T.classify_regulatory(F.col("question"), F.col("description")).alias("assigned"))


def _topic_sql():
    hay = "' ' || lower(concat_ws(' ', nullif(category_raw, ''), nullif(question, ''))) || ' '"
    arms = " ".join("when " + " or ".join(f"contains(h, '{w}')" for w in ws) + f" then '{n}'" for n, ws in topics.TOPIC_KEYWORDS)
    cats = " ".join(f"when category = '{c}' then '{t}'" for c, t in topics.CATEGORY_TOPIC.items())
    return f"select market_id, case {arms} {cats} else 'politics' end as topic from (select *, {hay} as h from markets)"


@query("classify_topic", "market_id topic", _topic_sql())
def classify_topic(v):
    return v.markets.select("market_id", T.classify_topic(F.col("category"), F.col("category_raw"), F.col("question")).alias("topic"))


@query("classifier_diff", "category n:l n_v1:l n_v2:l n_changed:l pct_v2:d", f"""
    with x as (select category, regexp_matches({_QD}, '{_re(C.NAIVE_DEADLINE_PATTERN)}') as v1, {_DL_Q} or {_DL_D} as v2 from markets)
    select category, count(*) as n, count(*) filter (v1) as n_v1, count(*) filter (v2) as n_v2, count(*) filter (v1 <> v2) as n_changed,
      round(100.0::double * count(*) filter (v2) / count(*), 1) as pct_v2 from x group by all""")
def classifier_diff(v):
    d = T.with_resolution_type(v.markets).withColumn("v1", T.naive_deadline(F.col("question"), F.col("description")))
    one = lambda c: F.count_if(F.col(c) == "deadline_resolved")
    return d.groupBy("category").agg(
        F.count("*").alias("n"), one("v1").alias("n_v1"), one("resolution_type").alias("n_v2"),
        F.count_if(F.col("v1") != F.col("resolution_type")).alias("n_changed"),
        F.round(100.0 * one("resolution_type") / F.count("*"), 1).alias("pct_v2"))


def _keywords_sql(q="question"):
    stop = ", ".join(f"'{w}'" for w in C.KEYWORD_STOPWORDS)
    words = f"list_filter(list_transform(regexp_extract_all({q}, '\\b([a-zA-Z]{{3,}})\\b', 1), lambda w: lower(w)), lambda w: w not in ({stop}))"
    first = f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"
    return f"list_slice({first}, 1, 5)"


@query("extract_keywords", "market_id keywords", f"select market_id, array_to_string({_keywords_sql()}, ' ') as keywords from markets")
def extract_keywords(v):
    return v.markets.select("market_id", F.array_join(T.extract_keywords(F.col("question")), " ").alias("keywords"))


_EVENT_KEY = ("array_to_string(list_filter(regexp_extract_all(lower(question), '\\b([a-z0-9]+)\\b', 1), lambda w: w not in ("
              + ", ".join(f"'{w}'" for w in C.EVENT_KEY_STOPWORDS) + ")), ' ')")


@query("event_key", "event_key n:l first_id", f"""
    select {_EVENT_KEY} as event_key, count(*) as n, min(market_id) as first_id from population group by all""")
def event_key(v):
    return v.population.groupBy(T.event_key(F.col("question")).alias("event_key")).agg(
        F.count("*").alias("n"), F.min("market_id").alias("first_id"))


@query("parse_iso_ts", "ingest_no:l created:t closed:t", """
    select ingest_no, try_cast(coalesce(line->>'$.createdAt', line->>'$.startDate') as timestamp) as created,
      try_cast(line->>'$.closedTime' as timestamp) as closed from raw_markets""")
def parse_iso_ts(v):
    g = lambda p: F.get_json_object("line", p)
    return v.raw_markets.select("ingest_no", P.parse_iso_ts(F.coalesce(g("$.createdAt"), g("$.startDate"))).alias("created"),
                                P.parse_iso_ts(g("$.closedTime")).alias("closed"))


_CLEAN_DATE = "regexp_replace(regexp_extract(text, 'DATE:\\s*(\\S+)', 1), '[*,;.\\s]+$', '')"


@query("parse_multi_format_ts", "market_id tier:l raw t:t", f"""
    select market_id, tier, {_CLEAN_DATE} as raw, {duck_ts(_CLEAN_DATE)} as t from answers where text like 'DATE:%'""")
def parse_multi_format_ts(v):
    raw = F.regexp_extract("text", r"DATE:\s*(\S+)", 1)
    return v.answers.where("text like 'DATE:%'").select(
        "market_id", "tier", F.regexp_replace(raw, r"[*,;.\s]+$", "").alias("raw"), P.parse_multi_format_ts(raw).alias("t"))


@query("minute_floor", "event_id:l minute:t", "select event_id, date_trunc('minute', ts) as minute from trades")
def minute_floor(v):
    return v.trades.select("event_id", F.date_trunc("minute", "ts").alias("minute"))


_FIRST_PRICE = """try_cast(case when json_type(line, '$.outcomePrices') = 'ARRAY' then line->>'$.outcomePrices[0]'
    else (line->>'$.outcomePrices')->>'$[0]' end as double)"""
_OUTCOME = f"case when abs({_FIRST_PRICE} - 1) < 0.01 then 1 when abs({_FIRST_PRICE}) < 0.01 then 0 end"


@query("outcome_from_prices", "ingest_no:l outcome:l", f"select ingest_no, {_OUTCOME} as outcome from raw_markets")
def outcome_from_prices(v):
    return v.raw_markets.select("ingest_no", P.outcome_from_prices(F.get_json_object("line", "$.outcomePrices")).alias("outcome"))


@query("token_at", "ingest_no:l token", "select ingest_no, (line->>'$.clobTokenIds')->>'$[1]' as token from raw_markets")
def token_at(v):
    return v.raw_markets.select("ingest_no", P.token_at(F.get_json_object("line", "$.clobTokenIds")).alias("token"))


@query("decode_hex_text", "num:l txt", "select num, decode(unhex(ancillary_hex)) as txt from requests")
def decode_hex_text(v):
    return v.requests.select("num", P.decode_hex_text(F.col("ancillary_hex")).alias("txt"))


@query("pick_evidence_url", "num:l url", """
    with u as (select num, regexp_extract_all(decode(unhex(ancillary_hex)), 'https?://[^\\s,"'']+') as urls from requests)
    select num, coalesce(list_filter(urls, lambda x: not contains(x, 'polymarket.com'))[1], urls[1]) as url from u""")
def pick_evidence_url(v):
    return v.requests.select("num", P.pick_evidence_url(P.decode_hex_text(F.col("ancillary_hex"))).alias("url"))


@query("outcome_from_oracle_price", "num:l outcome:l", """
    select num, case when resolved_price is null then null when try_cast(resolved_price as double) / 1e18 >= 0.5 then 1 else 0 end as outcome from requests""")
def outcome_from_oracle_price(v):
    return v.requests.select("num", P.outcome_from_oracle_price(F.col("resolved_price")).alias("outcome"))


_TAIL = "('0x' || right({}, 8))::bigint % 2147483648"
_LOG_INDEX = f"""case when contains(id, '_') then case when regexp_matches(regexp_extract(id, '^[^_]*_(.*)$', 1), '^0x[0-9a-fA-F]+$')
    then {_TAIL.format('id')} else {_TAIL.format("md5(regexp_extract(id, '^[^_]*_(.*)$', 1))")} end
    when regexp_matches(id, '-[0-9]+$') then regexp_extract(id, '-([0-9]+)$', 1)::bigint
    when regexp_matches(id, '^[0-9]+$') then (id::hugeint % 2147483648)::bigint else 0 end"""


@query("log_index", "ingest_no:l idx:l", f"select ingest_no, {_LOG_INDEX} as idx from (select ingest_no, line->>'$.id' as id from raw_fills)")
def log_index(v):
    return v.raw_fills.select("ingest_no", P.log_index(F.get_json_object("line", "$.id")).alias("idx"))


@query("pseudo_log_index", "event_id:l idx:l", f"""
    select event_id, {_TAIL.format("md5(concat_ws(':', tx_hash, taker_address, size_shares::varchar, price::varchar, event_id::varchar))")} as idx from trades""")
def pseudo_log_index(v):
    parts = [F.col("tx_hash"), F.col("taker_address"), F.col("size_shares").cast("string"), F.col("price").cast("string"),
             F.col("event_id").cast("string")]
    return v.trades.select("event_id", P.pseudo_log_index(*parts).alias("idx"))


@query("side_normalise", "ingest_no:l side", "select ingest_no, case when lower(line->>'$.side') = 'buy' then 'BUY' else 'SELL' end as side from raw_fills")
def side_normalise(v):
    return v.raw_fills.select("ingest_no", P.side_normalise(F.get_json_object("line", "$.side")).alias("side"))


@query("side_of_asset", "ingest_no:l asset side", """
    with m as (select ingest_no, line->>'$.clobTokenIds' as t from raw_markets where line->>'$.clobTokenIds' is not null),
    a as (select ingest_no, t->>'$[1]' as yes, unnest([t->>'$[0]', t->>'$[1]', null]) as asset from m)
    select ingest_no, asset, case when asset = yes then 'BUY' else 'SELL' end as side from a""")
def side_of_asset(v):
    t = F.from_json(F.get_json_object("line", "$.clobTokenIds"), "array<string>")
    m = v.raw_markets.select("ingest_no", t.alias("t")).where("t is not null")
    a = m.select("ingest_no", F.get("t", F.lit(1)).alias("yes"), F.explode(F.array(F.get("t", F.lit(0)), F.get("t", F.lit(1)), F.lit(None))).alias("asset"))
    return a.withColumn("side", P.side_of_asset(F.col("asset"), F.col("yes")))


@query("json_path", "ingest_no:l title neg_risk first_tag", """
    select ingest_no, line->>'$.events[0].title' as title, line->>'$.events[0].negRisk' as neg_risk,
      case when json_type(line, '$.tags') = 'ARRAY' then line->>'$.tags[0]' end as first_tag from raw_markets""")
def json_path(v):
    m = v.raw_markets.select("ingest_no", P.payload(F.col("line")).alias("p"))
    return m.select("ingest_no", P.field("p", "$.events[0].title").alias("title"), P.field("p", "$.events[0].negRisk").alias("neg_risk"), P.field("p", "$.tags[0]").alias("first_tag"))


@query("usdc_scale", "l_orderkey:l l_linenumber:l value_units:l usdc:d", """
    select l_orderkey, l_linenumber, value_units, value_units::decimal(30,0) * 0.000001 as usdc from transfers""")
def usdc_scale(v):
    return v.transfers.withColumn("usdc", N.usdc(F.col("value_units")))


@query("decimal_ratio", "event_id:l r:d", """
    select event_id, round_even(units::double / (10000 - units)::double, 6) as r
    from (select event_id, (price * 10000)::bigint as units from trades)""")
def decimal_ratio(v):
    return v.trades.select("event_id", N.decimal_ratio(F.col("price"), F.lit(1) - F.col("price")).alias("r"))


@query("clamp01", "market_id x:d", "select market_id, greatest(0, least(1, ils_dl)) as x from population")
def clamp01(v):
    return v.population.select("market_id", N.clamp01(F.col("ils_dl")).alias("x"))


@query("tau_days", "market_id tau:d minutes:d", """
    select market_id, (epoch_us(t_event) - epoch_us(t_open)) / 86400000000.0::double as tau,
      round((epoch_us(t_resolve) - epoch_us(t_event)) / 60000000.0::double, 1) as minutes from population""")
def tau_days(v):
    return v.population.select("market_id", N.days_between(F.col("t_event"), F.col("t_open")).alias("tau"),
                               N.minutes_between(F.col("t_resolve"), F.col("t_event")).alias("minutes"))


@query("minutes_before", "event_id:l minutes:d", """
    select t.event_id, round((epoch_us(m.t_resolve) - epoch_us(t.ts)) / 60000000.0::double, 1) as minutes from trades t join markets m on m.market_id = t.market_id""")
def minutes_before(v):
    from tidemark.operators.hot import join_hot
    j = join_hot(v.trades.select("event_id", "market_id", "ts"), v.markets.select("market_id", "t_resolve"), ["market_id"], spread=["event_id"])
    return j.select("event_id", N.minutes_between(F.col("t_resolve"), F.col("ts")).alias("minutes"))


_P_IN = "case model " + " ".join(f"when '{m}' then {i}" for m, i, _, _ in C.TOKEN_PRICES) + " end"
_P_OUT = "case model " + " ".join(f"when '{m}' then {o}" for m, _, o, _ in C.TOKEN_PRICES) + " end"
_P_S = "case model " + " ".join(f"when '{m}' then {s}" for m, _, _, s in C.TOKEN_PRICES) + " end"
_COST = f"(in_tokens * ({_P_IN})::double + out_tokens * ({_P_OUT})::double + n_searches * ({_P_S})::double)"


@query("token_cost", "market_id tier:l cost:d", f"select market_id, tier, {_COST} as cost from answers")
def token_cost(v):
    return rec.token_cost(v.answers)


@query("decode_settle_log", "num:l txt price proposer", """
    with w as (select num, topic2, substring(data, 3) as b from settle_logs),
    o as (select *, ('0x' || right(substring(b, 129, 64), 15))::bigint as off, substring(b, 193, 64) as pr from w),
    n as (select *, ('0x' || right(substring(b, off * 2 + 1, 64), 15))::bigint as len from o)
    select num, decode(unhex(substring(b, off * 2 + 65, len * 2))) as txt,
      case when regexp_matches(pr, '^[89a-f]') then -(('0x' || translate(pr, '0123456789abcdef', 'fedcba9876543210'))::hugeint + 1) else ('0x' || pr)::hugeint end::varchar as price,
      '0x' || substring(topic2, 27) as proposer from n""")
def decode_settle_log(v):
    f = P.settle_log_fields(F.col("data"), F.col("topic2"))
    return v.settle_logs.select("num", f["ancillary_text"].alias("txt"), f["price"].alias("price"), f["proposer"].alias("proposer"))


@query("format_iso", "event_id:l iso", """
    select event_id, case when epoch_us(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') end as iso from trades""")
def format_iso(v):
    return v.trades.select("event_id", P.format_iso(F.col("ts")).alias("iso"))


def _publish_sql():
    ld = "regexp_extract(html, '(?is)<script[^>]*type=\"application/ld\\+json\"[^>]*>(.*?)</script>', 1)"
    keys = ", ".join(f"{ld}->>'$.{k}', {ld}->>'$[0].{k}'" for k in C.JSONLD_DATE_KEYS)
    metas = ", ".join(
        f"nullif(regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*(property|name)=\"{k}\"[^>]*>'), '(?i)content=\"([^\"]*)\"', 1), '')"
        for k in ["article:published_time", "og:article:published_time", "pubdate", "publish-date", "date"])
    raw = (f"coalesce(case when {ld} <> '' then coalesce({keys}) end, {metas}, "
           "nullif(regexp_extract(html, '(?i)<time\\b[^>]*datetime=\"([^\"]*)\"', 1), ''))")
    return f"""with r as (select page_id, url, {raw} as raw from articles
        where regexp_matches(lower(url), '^https?:') and not regexp_matches(url, '{C.DENIED_HOSTS}'))
        select page_id, url, {duck_ts('raw')} as t_news, 0.95 as confidence from r where raw is not null"""


@query("extract_publish_ts", "page_id:l url t_news:t confidence:d", _publish_sql())
def extract_publish_ts(v):
    return rec.from_pages(v.articles)


_ARTICLE_SQL = f"""
    with k as (select market_id, t_open, t_resolve, unnest({_keywords_sql()}) as kw from markets where t_resolve is not null),
    m as (select k.market_id, min(w.ts) as t_news from k join wires w on w.ts >= k.t_open and w.ts <= k.t_resolve
          and contains(w.themes, upper(k.kw)) group by k.market_id)
    select m.market_id, m.t_news, min(w.url) as source_url, 2 as tier, 0.70 as confidence from m
    join k on k.market_id = m.market_id join wires w on w.ts = m.t_news and contains(w.themes, upper(k.kw)) group by all"""


@query("first_article_match", "market_id t_news:t source_url tier:l confidence:d", _ARTICLE_SQL)
def first_article_match(v):
    return rec.from_articles(v.markets, v.wires)


_LAB_SOURCES = "list_filter(list_transform(string_split(regexp_extract(text, 'SOURCES:\\s*(.+)', 1), ','), lambda s: trim(s)), lambda s: s <> '' and lower(s) <> 'none')"
_LAB = f"""(select market_id, tier, num, model, in_tokens, out_tokens, n_searches, text, case when contains(upper(raw), 'UNKNOWN') then null else {duck_ts('raw')} end as t_event,
    {_LAB_SOURCES} as sources, trim(regexp_extract(text, 'REASON:\\s*(.+)', 1)) as notes from (select *, {_CLEAN_DATE} as raw from answers where text like 'DATE:%'))"""


@query("parse_answer_text", "market_id tier:l t_event:t sources notes confidence:d", f"""
    select market_id, tier, t_event, case when t_event is null then null else array_to_string(sources, ';') end as sources, notes,
      case when t_event is null then null when len(sources) > 0 then 0.8 else 0.6 end as confidence from {_LAB}""")
def parse_answer_text(v):
    a = rec.labelled_answer(F.col("text"))
    return v.answers.where("text like 'DATE:%'").select(
        "market_id", "tier", a["t_event"].alias("t_event"), F.array_join(a["sources"], ";").alias("sources"),
        a["notes"].alias("notes"), a["confidence"].alias("confidence"))


_JS = f"""(select *, case when json_valid(obj) then obj end as ok from (select *, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') as obj
    from answers where text not like 'DATE:%'))"""
_JS_T = f"case when lower(ok->>'$.T_event') in ('null', 'none', '') then null else {duck_ts(chr(40) + 'ok->>' + chr(39) + '$.T_event' + chr(39) + chr(41))} end"


@query("parse_answer_json", "market_id tier:l t_event:t confidence:d n_sources:l reasoning", f"""
    select market_id, tier, {_JS_T} as t_event, coalesce((ok->>'$.confidence')::double, 0) as confidence,
      case when ok is null then 0 else coalesce((ok->>'$.n_sources')::int, json_array_length(ok, '$.sources')) end as n_sources,
      case when ok is not null then ok->>'$.reasoning' when obj is null then 'No JSON in response' else 'JSON parse error' end as reasoning from {_JS}""")
def parse_answer_json(v):
    a = rec.json_answer(F.col("text"))
    return v.answers.where("text not like 'DATE:%'").select("market_id", "tier", *[a[k].alias(k) for k in (
        "t_event", "confidence", "n_sources", "reasoning")])


_PARSED = f"""parsed as (select num, market_id, tier, model, {_COST} as cost, t_event, coalesce(case when t_event is null then null when len(sources) > 0 then 0.8 else 0.6 end, 0) as confidence from {_LAB}
    union all select num, market_id, tier, model, {_COST} as cost, {_JS_T}, coalesce((ok->>'$.confidence')::double, 0) from {_JS})"""
_CASCADE = _PARSED + """,
    pick as (select market_id, coalesce(min(case when t_event is not null and confidence >= {thr} then tier end), max(tier)) as chosen_tier,
             min(case when t_event is not null and confidence >= {thr} then tier end) is not null as accepted from parsed group by market_id),
    res as (select p.market_id, k.chosen_tier, k.accepted, max(case when p.tier = k.chosen_tier then t_event end) as t_event,
      max(case when p.tier = k.chosen_tier then confidence end) as confidence, sum(cost) as cost
      from parsed p join pick k on k.market_id = p.market_id where p.tier <= k.chosen_tier group by all)"""


@query("recovery_cascade", "market_id chosen_tier:l accepted:b t_event:t confidence:d cost:d", "with " + _CASCADE.replace("{thr}", "0.7") + " select * from res")
def recovery_cascade(v):
    return rec.recovery_cascade(rec.parsed_answers(v.answers))


@query("recovery_two_stage", "market_id chosen_tier:l accepted:b t_event:t confidence:d cost:d", "with " + _CASCADE.replace("{thr}", "0.5") + " select * from res")
def recovery_two_stage(v):
    return rec.recovery_cascade(rec.parsed_answers(v.answers), 0.5)


@query("reuse_by_event", "market_id event_key leader t_event:t confidence:d cost:d", "with " + _CASCADE.replace("{thr}", "0.7") + f""",
    k as (select market_id, {_EVENT_KEY} as event_key from population),
    l as (select k.event_key, min(r.market_id) as leader from k join res r on r.market_id = k.market_id group by all)
    select k.market_id, k.event_key, l.leader, r.t_event, r.confidence, case when k.market_id = l.leader then r.cost else 0 end as cost
    from k join l on l.event_key = k.event_key join res r on r.market_id = l.leader""")
def reuse_by_event(v):
    keyed = v.population.select("market_id", T.event_key(F.col("question")).alias("event_key"))
    return rec.reuse_by_event(keyed, rec.recovery_cascade(rec.parsed_answers(v.answers)))


@query("recovery_cost_stats", "model n:l n_recovered:l total_cost:d cost_per_answer:d passes:b", "with " + _PARSED + """
    select model, count(*) as n, count(t_event) as n_recovered, sum(cost) as total_cost, avg(cost) as cost_per_answer,
      count(t_event) >= 0.7 * count(*) as passes from parsed group by model""")
def recovery_cost_stats(v):
    return au.recovery_cost_stats(rec.parsed_answers(v.answers))


_PASSES = "with " + _PARSED + """,
    j as (select a.market_id, a.t_event::date as d1, b.t_event::date as d2, a.num % 3 as bucket from parsed a join parsed b on b.market_id = a.market_id
          where a.tier = 1 and b.tier = 3),
    x as (select *, d1 = d2 as exact_match, abs(d1 - d2) <= 1 as within_24h, abs(d1 - d2) as delta_days,
          case when d1 <> d2 then case when abs(d1 - d2) <= 7 then 'minor' else 'major' end end as severity from j)
"""


def _passes(v):
    p = rec.parsed_answers(v.answers).select("market_id", "num", "tier", F.to_date("t_event").alias("d"))
    a = p.where("tier = 1").select("market_id", F.col("d").alias("d1"), (F.col("num") % 3).cast("string").alias("bucket"))
    j = a.join(p.where("tier = 3").select("market_id", F.col("d").alias("d2")), "market_id")
    return au.date_disagreement(j, "d1", "d2")


@query("pass_compare", "market_id d1 d2 exact_match:b within_24h:b delta_days:l severity", _PASSES + " select * from x")
def pass_compare(v):
    return _passes(v)


@query("disagreement", "severity n:l max_days:l", _PASSES + " select severity, count(*) as n, max(delta_days) as max_days from x group by severity")
def disagreement(v):
    return _passes(v).groupBy("severity").agg(F.count("*").alias("n"), F.max("delta_days").alias("max_days"))


@query("agreement_rates", "scope n:l exact_match_rate:d within_24h_rate:d within_6h_rate:d source_overlap_rate:d n_minor:l n_major:l", _PASSES + f""",
    src as (select market_id, tier, from_json(ok->'$.sources', '["VARCHAR"]') as u from {_JS} where ok is not null),
    o as (select x.*, coalesce(list_has_any(a.u, b.u), false) as overlap from x left join src a on a.market_id = x.market_id and a.tier = 1
          left join src b on b.market_id = x.market_id and b.tier = 3)
    select scope, count(*) as n, round(avg(exact_match::int), 4) as exact_match_rate, round(avg(within_24h::int), 4) as within_24h_rate,
      round(avg((d1 = d2)::int), 4) as within_6h_rate, round(avg(overlap::int), 4) as source_overlap_rate,
      count(*) filter (severity = 'minor') as n_minor, count(*) filter (severity = 'major') as n_major
    from (select 'overall' as scope, * from o union all select bucket::varchar, * from o) group by scope""")
def agreement_rates(v):
    s = v.answers.where("text not like 'DATE:%'").select("market_id", "tier", rec.json_answer(F.col("text"))["sources"].alias("u"))
    side = lambda t, name: s.where(F.col("tier") == t).select("market_id", F.col("u").alias(name))
    j = _passes(v).join(side(1, "u1"), "market_id", "left").join(side(3, "u2"), "market_id", "left")
    return au.agreement_rates(j.withColumn("source_overlap", au.sources_overlap(F.col("u1"), F.col("u2"))), "bucket")


@query("source_overlap", "market_id overlap:b", f"""
    with s as (select market_id, tier, case when ok is null then [] else from_json(ok->'$.sources', '["VARCHAR"]') end as u from {_JS})
    select a.market_id, list_has_any(a.u, b.u) as overlap from s a join s b on b.market_id = a.market_id where a.tier = 1 and b.tier = 2""")
def source_overlap(v):
    s = v.answers.where("text not like 'DATE:%'").select("market_id", "tier", rec.json_answer(F.col("text"))["sources"].alias("u"))
    j = s.where("tier = 1").alias("a").join(s.where("tier = 2").alias("b"), "market_id")
    return j.select("market_id", au.sources_overlap(F.col("a.u"), F.col("b.u")).alias("overlap"))


@query("tier_fallback", "market_id t_news:t tier_used", """
    select m.market_id, coalesce(s.t_news, a.t_news, b.t_news) as t_news, case when s.t_news is not null then 'stored' when a.t_news is not null then 'tier1'
      when b.t_news is not null then 'tier2' else 'no t_news' end as tier_used
    from markets m left join news s on s.market_id = m.market_id and s.tier = 3 left join news a on a.market_id = m.market_id and a.tier = 1
    left join news b on b.market_id = m.market_id and b.tier = 2""")
def tier_fallback(v):
    n = lambda t: v.news.where(F.col("tier") == t)
    return rec.tier_fallback(v.markets, n(3), n(1), n(2))
