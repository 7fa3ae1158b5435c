"""Event and news times from pages, articles and recovered answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import parsing as P
from tidemark.functions.text import extract_keywords
from tidemark.operators.asof import first_at_or_after
from tidemark.operators.filters import url_allowed
from tidemark.operators.hot import join_hot
from tidemark.session import staged

_NULLS = ["null", "none", ""]


def page_ts(c: Column) -> Column:
    """Page dates: a full time needs an offset; a bare date is midnight."""
    s = F.trim(c)
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2}))?$")
    return F.when(ok, P.parse_multi_format_ts(s))


def publish_ts(html: Column) -> Column:
    """Publish time of a page: JSON-LD, then metadata by name order, then the first time tag."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    in_script = F.flatten(F.transform(scripts, lambda s: F.array(*[
        page_ts(F.coalesce(F.get_json_object(s, f"$.{k}"), F.get_json_object(s, f"$[0].{k}"))) for k in C.JSONLD_DATE_KEYS])))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    named = []
    for name in C.META_DATE_NAMES:
        q = name.replace(".", r"\.")
        has = lambda attr, q=q: F.get(F.filter(
            metas, lambda t: t.rlike(rf"(?i)\b{attr}=[\"']" + q + r"[\"']")), F.lit(0))
        tag = F.coalesce(has("property"), has("name"))
        named.append(page_ts(F.regexp_extract(tag, r"(?i)\bcontent=[\"']([^\"']*)[\"']", 1)))
    times = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<time\b[^>]*\bdatetime=[\"']([^\"']*)[\"']"), 1), lambda x: page_ts(x))
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first(in_script), *named, first(times))


def from_pages(pages: DataFrame) -> DataFrame:
    """News times from fetched pages (url, html), skipping denied hosts."""
    t = publish_ts(F.col("html"))
    return (pages.where(url_allowed(F.col("url"))).withColumn("t_news", t).where("t_news is not null")
            .withColumn("tier", F.lit(1)).withColumn("confidence", F.lit(C.CONFIDENCE_PAGE)))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of a word of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))


def words_within(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct (kw, run) with the part ``kw`` anywhere inside the word ``run``; parts of under three characters are in none.

    The words have one posting for each of their trigrams, so the index is linear in their length. A part is looked for at its rarest
    trigram only, is dropped when any of its trigrams has no posting, and is verified in the words found there.
    """
    postings = staged(words.where(F.length("run") >= 3).select("run").distinct().select("run", F.explode(trigrams(F.col("run"))).alias("gram")))
    often = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = parts.where(F.length("kw") >= 3).select("kw").distinct().select("kw", F.explode(trigrams(F.col("kw"))).alias("gram"))
    rarest = (asked.join(often, "gram", "left").groupBy("kw").agg(F.min_by("gram", "n").alias("gram"), F.count("n").alias("met"), F.count(F.lit(1)).alias("all"))
              .where("met = `all`"))
    return rarest.join(postings, "gram").where(F.col("run").contains(F.col("kw"))).select("kw", "run")


def from_articles(markets: DataFrame, articles: DataFrame) -> DataFrame:
    """Earliest article in the life of each market whose themes contain one of its keywords.

    A theme contains a keyword when one of its letter runs does; runs and keywords are matched once per distinct word.
    """
    lo = F.coalesce("t_open", F.col("t_resolve") - F.expr(f"interval {C.ARTICLE_WINDOW_DAYS} days"))
    kw = (markets.where("t_resolve is not null")
          .select("market_id", lo.alias("lo"), F.col("t_resolve").alias("hi"),
                  F.explode(extract_keywords(F.col("question"))).alias("kw"))
          .withColumn("kw", F.upper("kw")))
    runs = articles.select("ts", "url", "publisher", F.explode(F.array_distinct(
        F.regexp_extract_all(F.upper("themes"), F.lit("([A-Z]{3,})"), 1))).alias("run"))
    contains = words_within(kw.select("kw"), runs.select("run"))
    lookups = join_hot(kw, contains, ["kw"], spread=["market_id"]).select("market_id", "run", "lo", "hi").distinct()
    facts = runs.groupBy("run", "ts").agg(F.min(F.struct("url", "publisher")).alias("article"))
    hit = first_at_or_after(lookups, facts.withColumnRenamed("run", "frun"), "run", "lo", "hi", "ts", "article", fact_key="frun")
    best = hit.where("article is not null").groupBy("market_id").agg(F.min(F.struct(
        F.col("article_ts").alias("t_news"), F.col("article.url").alias("source_url"),
        F.col("article.publisher").alias("publisher"))).alias("b"))
    return best.select("market_id", "b.*").withColumn("tier", F.lit(2)).withColumn("confidence", F.lit(C.CONFIDENCE_ARTICLE))


def labelled_answer(text: Column) -> dict[str, Column]:
    """Answers of the form DATE / SOURCES / REASON."""
    raw = F.regexp_extract(text, r"DATE:\s*(\S+)", 1)
    t = F.when((raw != "") & ~F.upper(raw).contains("UNKNOWN"), P.parse_multi_format_ts(raw))
    src = F.filter(F.transform(F.split(F.regexp_extract(text, r"SOURCES:\s*(.+)", 1), ","), lambda s: F.trim(s)),
                   lambda s: (s != "") & (F.lower(s) != "none"))
    return {"t_event": t, "sources": F.when(t.isNotNull(), src), "notes": F.trim(F.regexp_extract(text, r"REASON:\s*(.+)", 1)),
            "confidence": F.when(t.isNotNull(), F.when(F.size(src) > 0, C.CONFIDENCE_ANSWER_SOURCED)
                                 .otherwise(C.CONFIDENCE_ANSWER_UNSOURCED))}


def json_answer(text: Column) -> dict[str, Column]:
    """Answers holding one JSON object, possibly fenced or with text around it."""
    body = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    obj = P.blank_to_null(F.regexp_extract(body, r"(?s)(\{.*\})", 1))
    rec = F.from_json(obj, "T_event string, confidence double, sources array<string>, n_sources int, reasoning string, _bad string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = obj.isNotNull() & rec["_bad"].isNull()
    src = F.filter(F.coalesce(rec["sources"], F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
    raw = rec["T_event"]
    return {"t_event": F.when(ok & ~F.lower(raw).isin(_NULLS), P.parse_multi_format_ts(raw)),
            "confidence": F.when(ok, F.coalesce(rec["confidence"], F.lit(0.0))).otherwise(0.0),
            "sources": F.when(ok, src), "n_sources": F.when(ok, F.coalesce(rec["n_sources"], F.size(src))).otherwise(0),
            "reasoning": F.when(ok, F.coalesce(rec["reasoning"], F.lit(""))).when(obj.isNull(), "No JSON in response")
            .otherwise("JSON parse error")}


def token_cost(answers: DataFrame) -> DataFrame:
    """Add the cost of each answer from the price list of its model."""
    p_in = p_out = p_search = None
    for model, i, o, s in C.TOKEN_PRICES:
        is_m = F.col("model") == model
        p_in = F.when(is_m, i) if p_in is None else p_in.when(is_m, i)
        p_out = F.when(is_m, o) if p_out is None else p_out.when(is_m, o)
        p_search = F.when(is_m, s) if p_search is None else p_search.when(is_m, s)
    return answers.withColumn("cost", F.col("in_tokens") * p_in + F.col("out_tokens") * p_out + F.col("n_searches") * p_search)


def parsed_answers(answers: DataFrame) -> DataFrame:
    """Answers in either form with time, confidence and cost."""
    lab, js = labelled_answer(F.col("text")), json_answer(F.col("text"))
    is_lab = F.col("text").rlike(r"DATE:\s*\S")
    pick = lambda k: F.when(is_lab, lab[k]).otherwise(js[k])
    return token_cost(answers).withColumn("t_event", pick("t_event")).withColumn(
        "confidence", F.coalesce(pick("confidence"), F.lit(0.0)))


def recovery_cascade(parsed: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """One answer per market: the first tier that is confident and dated, else the last tier tried.

    The cost is the sum over the tiers up to the chosen one.
    """
    good = F.col("t_event").isNotNull() & (F.col("confidence") >= threshold)
    # over a window, not by a join with itself: the answers are parsed and shuffled once
    w = Window.partitionBy("market_id")
    rows = parsed.where("market_id is not null").select("market_id", "tier", "model", "t_event", "confidence", "cost")
    j = (rows.withColumn("_acc", F.min(F.when(good, F.col("tier"))).over(w)).withColumn("chosen_tier", F.coalesce("_acc", F.max("tier").over(w)))
         .where("tier <= chosen_tier"))
    at = F.col("tier") == F.col("chosen_tier")
    return j.groupBy("market_id", "chosen_tier").agg(
        F.max(F.when(at, F.col("t_event"))).alias("t_event"), F.max(F.when(at, F.col("confidence"))).alias("confidence"),
        F.max(F.when(at, F.col("model"))).alias("model"), F.sum("cost").alias("cost"),
        F.bool_or(F.col("_acc").isNotNull()).alias("accepted"))


def reuse_by_event(markets_with_key: DataFrame, results: DataFrame) -> DataFrame:
    """Give every market of one event the result of the event's first market, at no further cost."""
    keyed = markets_with_key.select("market_id", "event_key").join(results, "market_id", "left")
    lead = keyed.groupBy("event_key").agg(F.min(F.when(F.col("chosen_tier").isNotNull(), F.struct(
        F.col("market_id").alias("leader"), "t_event", "confidence", "cost"))).alias("r")).where("r is not null")
    j = join_hot(markets_with_key.select("market_id", "event_key"), lead, ["event_key"], spread=["market_id"])
    return j.select("market_id", "event_key", "r.leader", "r.t_event", "r.confidence",
                    F.when(F.col("market_id") == F.col("r.leader"), F.col("r.cost")).otherwise(0.0).alias("cost"))


def tier_fallback(markets: DataFrame, stored: DataFrame, tier1: DataFrame, tier2: DataFrame) -> DataFrame:
    """News time of each market: stored, else from pages, else from articles."""
    one = lambda d, tag: d.select("market_id", F.col("t_news").alias(f"_{tag}"))
    j = (markets.select("market_id").join(one(stored, "s"), "market_id", "left").join(one(tier1, "a"), "market_id", "left")
         .join(one(tier2, "b"), "market_id", "left"))
    used = (F.when(F.col("_s").isNotNull(), "stored").when(F.col("_a").isNotNull(), "tier1")
            .when(F.col("_b").isNotNull(), "tier2").otherwise("no t_news"))
    return j.select("market_id", F.coalesce("_s", "_a", "_b").alias("t_news"), used.alias("tier_used"))
