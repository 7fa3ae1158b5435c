"""Fields of landed payloads: JSON, hex, ids, prices and times as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import URL_PATTERN, VENUE_DOMAIN

_MOD31 = 2 ** 31
_TWO256, _WORD256 = 2 ** 256, re.compile("[0-9a-fA-F]{64}")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once however often ``f`` names it; Spark repeats an expression in each branch that names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def payload(line: Column) -> Column:
    """A JSON line as VARIANT, parsed once for all its fields; NULL when it is broken."""
    return F.try_parse_json(line)


def field(p: Column | str, path: str, kind: str = "string") -> Column:
    """A field of a parsed line by path (``$.a[0].b``); lists and objects as JSON text, NULL when missing, JSON null or of another kind."""
    return F.try_variant_get(F.col(p) if isinstance(p, str) else p, path, kind)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_iso_ts(c: Column) -> Column:
    """ISO-8601 with Z, an offset or neither (then UTC); NULL when unreadable."""
    return F.try_to_timestamp(blank_to_null(c))


# accepted shapes: full time with offset, minutes with or without offset, a bare date
_DATE_SHAPE = (r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})|T\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?)?$")


def parse_multi_format_ts(c: Column) -> Column:
    """Date or time in one of the accepted shapes, after trailing punctuation is removed; offsets are honoured."""
    s = F.regexp_replace(F.trim(c), r"[*,;.\s]+$", "")
    full = F.regexp_replace(F.regexp_replace(s, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2"), r"(T\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(s.rlike(_DATE_SHAPE), F.try_to_timestamp(full))


def json_list(c: Column) -> Column:
    """Array of strings from a JSON list, given as a list or as a string that holds one."""
    return F.from_json(c, "array<string>")


def outcome_from_prices(c: Column) -> Column:
    """1 when the first price is within 0.01 of 1, 0 when within 0.01 of 0, else NULL."""
    def outcome(prices: Column) -> Column:
        first = F.when(F.size(prices) >= 2, F.get(prices, F.lit(0)).try_cast("double"))
        return F.when(F.abs(first - 1) < 0.01, 1).when(F.abs(first) < 0.01, 0)

    return once(json_list(c), outcome)


def token_at(c: Column, position: int = 1) -> Column:
    """Element of a JSON id list (0-based); NULL when the list has fewer than two."""
    return once(json_list(c), lambda ids: F.when(F.size(ids) >= 2, F.get(ids, F.lit(position))))


def decode_hex_text(c: Column) -> Column:
    """Hex to UTF-8 text; text that is not hex stays as it is."""
    clean = F.replace(F.replace(c, F.lit("0x"), F.lit("")), F.lit(" "), F.lit(""))
    is_hex = clean.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(is_hex, F.try_validate_utf8(F.unhex(clean).cast("string"))).otherwise(c)


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL_PATTERN})"), 1)


def pick_evidence_url(text: Column) -> Column:
    """First URL outside the venue's own domain, else the first URL."""
    urls = urls_in(text)
    other = F.filter(urls, lambda u: ~u.contains(VENUE_DOMAIN))
    return F.coalesce(F.get(other, F.lit(0)), F.get(urls, F.lit(0)))


def embedded_ids(text: Column) -> Column:
    """All tokens of a text that may be a market id: hex numbers with 0x, and runs of decimal digits."""
    return F.regexp_extract_all(text, F.lit(r"(0x[0-9a-f]{64}|(?<![0-9a-z])(?:0x[0-9a-f]+|\d+)(?![0-9a-z]))"), 1)


def outcome_from_oracle_price(c: Column) -> Column:
    p = c.try_cast("double")
    return F.when(p.isNotNull(), F.when(p / 1e18 >= 0.5, 1).otherwise(0))


def _hex_tail(c: Column) -> Column:
    """Last 8 hex digits modulo 2^31: the value of the whole number modulo 2^31."""
    tail = F.right(F.lpad(c, 64, "0"), F.lit(8))
    return F.conv(tail, 16, 10).cast("bigint") % _MOD31


def _digits_mod31(c: Column) -> Column:
    """A decimal number of any length modulo 2^31, nine digits at a time."""
    pieces = F.ceil(F.length(c) / 9).cast("int")
    padded = F.lpad(c, pieces * 9, F.lit("0"))
    return F.aggregate(F.sequence(F.lit(0), pieces - 1), F.lit(0).cast("bigint"), lambda acc, i: (
        acc * 1_000_000_000 + F.substr(padded, i * 9 + 1, F.lit(9)).try_cast("bigint")) % _MOD31)


def log_index(raw_id: Column) -> Column:
    """Row number (bigint) of a fill inside its transaction, from the three id shapes in use.

    ``tx_0xhash``: hash modulo 2^31; ``tx_other``: stable digest of the suffix; ``tx-n``: n, or n modulo 2^31 where
    it exceeds a bigint; a plain number of any length modulo 2^31; anything else 0.
    """
    suffix = F.regexp_extract(raw_id, "^[^_]*_(.*)$", 1)
    dash = F.regexp_extract(raw_id, r"-(\d+)$", 1)
    hex_ok = suffix.rlike("^0x[0-9a-fA-F]+$")
    return (F.when(raw_id.contains("_"), F.when(hex_ok, _hex_tail(F.substr(suffix, F.lit(3))))
                   .otherwise(_hex_tail(F.md5(suffix))))
            .when(raw_id.contains("-") & (dash != ""), F.coalesce(dash.try_cast("bigint"), _digits_mod31(dash)))
            .when(raw_id.rlike(r"^\d+$"), _digits_mod31(raw_id))
            .otherwise(F.lit(0).cast("bigint")))


def pseudo_log_index(*parts: Column) -> Column:
    """Digest of the joined parts modulo 2^31, for feeds without a log index."""
    return _hex_tail(F.md5(F.concat_ws(":", *parts)))


def side_normalise(c: Column) -> Column:
    return F.when(F.lower(F.coalesce(c, F.lit("Buy"))) == "buy", "BUY").otherwise("SELL")


def side_of_asset(taker_asset: Column, yes_token: Column) -> Column:
    """BUY where the taker receives the YES token, SELL for any other asset, unknown ones and NULL too."""
    return F.when(taker_asset.cast("string") == yes_token.cast("string"), "BUY").otherwise("SELL")


def format_iso(ts: Column) -> Column:
    """ISO text with Z; microseconds only when there are any."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def signed_hex_text(word: Column) -> Column:
    """A 256-bit two's complement word (64 hex digits) as exact decimal text; NULL for anything else.

    No Spark number holds it, and Python's whole numbers do: a batch of words is a column of texts both ways.
    """
    @F.pandas_udf("string")
    def texts(words: pd.Series) -> pd.Series:
        def text(w: str | None) -> str | None:
            if w is None or not _WORD256.fullmatch(w):
                return None
            n = int(w, 16)
            return str(n - _TWO256 if n >> 255 else n)

        return words.map(text)

    return texts(word)


def settle_log_fields(data: Column, topic2: Column) -> dict[str, Column]:
    """Fields of a settlement log: text at its dynamic offset, signed price, proposer.

    ``price`` is the whole 256-bit number as decimal text, since no Spark number holds its 77 digits.
    """
    word = lambda at: F.substr(data, at * 64 + 3, F.lit(64))  # noqa: E731 - after 0x
    num = lambda w: F.conv(F.right(w, F.lit(15)), 16, 10).cast("bigint")
    offset = num(word(F.lit(2)))
    length = num(F.substr(data, (offset * 2 + 3).cast("int"), F.lit(64)))
    text = F.substr(data, (offset * 2 + 67).cast("int"), (length * 2).cast("int"))
    long_enough = F.length(data) >= 322
    return {
        "ancillary_hex": F.when(long_enough, F.concat(F.lit("0x"), text)),
        "ancillary_text": F.when(long_enough, once(text, decode_hex_text)),
        "price": F.when(long_enough, signed_hex_text(word(F.lit(3)))),
        "proposer": F.concat(F.lit("0x"), F.substr(topic2, F.lit(27))),
    }
