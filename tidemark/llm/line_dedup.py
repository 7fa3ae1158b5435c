"""Line deduplication by the spread of a line over distinct sites.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation. Lines whose estimate
is near the threshold get an exact distinct count. A line on enough sites is boilerplate: it stays at its first place in
the corpus and is removed everywhere else.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free, let, text_key
from tidemark.session import staged

MIN_SITES = 5
#: shorter lines recur by chance in any prose
MIN_WORDS = 5
#: log2 of the sketch's registers: a standard error of 1.6 %
SKETCH_BITS = 12
#: estimates within this share of the threshold (and one site) are counted exactly; six standard errors
NEAR = 0.1
#: lines of fewer words that have so many characters (scripts without spaces) are judged like any other
SHORT_CHARS = 20


def _lines(docs: DataFrame, min_words: int, short_lines: bool = False) -> DataFrame:
    """The lines that count: document key, position, site, a 128-bit digest of the trimmed line, and with ``short_lines`` whether it is ``short``."""
    line = F.btrim("line", F.lit(" \t\r\f\v"))
    site = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    lines = (docs.where("text is not null")
             .select("doc_id", text_key(F.col("text")).alias("th"), site.alias("site"), F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
             .withColumn("line", line))
    wordy = F.col("line").rlike(rf"^\S+(\s+\S+){{{min_words - 1}}}")
    if short_lines:
        short = ~wordy & (F.length("line") < SHORT_CHARS)
        return lines.where("line <> ''").select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), short.alias("short"))
    lines = lines.where(wordy)
    return lines.select("doc_id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Digest (h, g) and first place of every line of ``lines`` that stands on ``min_sites`` sites or more."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    spread = (lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min(place).alias("first"))
              .select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = staged(spread.where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high)
    exact = (lines.join(near.select("h", "g"), ["h", "g"], "left_semi")
             .groupBy("h", "g").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites))
    return spread.where(F.col("sites") > high).select("h", "g", "first").unionByName(
        near.join(exact, ["h", "g"], "left_semi").select("h", "g", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, short_share: float | None = None) -> DataFrame:
    """Every document with its boilerplate lines removed; adds ``n_lines`` and ``n_removed``, and renews ``n_chars`` if it is there.

    Lines are cut at ``\\n`` and compared without the white space around them; the first place (lowest doc_id, NULL last) keeps its
    line. NULL texts stay NULL with no lines, empty texts have one empty line; NULL sources count as one site. Rows
    that repeat both doc_id and text are treated as one document, so each of them keeps or loses the same lines. Every
    row stays, if need be with an empty text. Lines of fewer than ``min_words`` words stay everywhere if ``short_share`` is None; else they
    count too, those under ``SHORT_CHARS`` characters only if they stand on that share of all sites. Columns named ``n_lines`` and ``n_removed`` are replaced.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "pos")
    lines = staged(_lines(docs, min_words, short_share is not None))
    if short_share is None:
        wide = boilerplate_lines(lines, min_sites)
    else:
        sites = docs.select("source").distinct().count()
        wide = boilerplate_lines(lines.where("not short"), min_sites).unionByName(
            boilerplate_lines(lines.where("short"), max(min_sites, math.ceil(short_share * sites - 1e-9))))
    d, t, drop = (free(c, docs) for c in ("_doc_id", "_th", "_drop"))
    drops = (lines.join(wide, ["h", "g"])
             .where(~first.eqNullSafe(F.col("first")))
             .groupBy(F.col("doc_id").alias(d), F.col("th").alias(t)).agg(F.collect_set("pos").alias(drop)))
    th = text_key(F.col("text"))
    out = docs.join(drops, docs["doc_id"].eqNullSafe(drops[d]) & (th == F.col(t)), "left")
    kept = let(F.split("text", "\n", -1), lambda a: F.array_join(F.transform(
        F.array_except(F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)), F.col(drop)), lambda i: F.get(a, i)), "\n"))
    new = {"text": F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept),
           "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(
               F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1),
           "n_removed": F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop))}
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in rest], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in rest else out
