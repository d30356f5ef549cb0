"""Scalar functions as column expressions: text, dates, numbers, vectors, hashes."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- text -------------------------------------------------------------------------------------


def canonical_name(c) -> Column:
    """ASCII form of name folding (exact NFC/casefold: `canonical_name_exact`)."""
    return F.lower(F.trim(_c(c)))


@F.pandas_udf(StringType())
def canonical_name_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip().casefold())


def prefix_similarity(a, b) -> Column:
    """Shared leading characters over the longer length; two empty strings are alike."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    short = F.least(F.char_length(a), F.char_length(b))
    same = F.aggregate(
        F.sequence(F.lit(0), short),
        F.lit(0),
        lambda acc, i: F.when((i > 0) & (acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    return F.when(longest == 0, 1.0).otherwise(same / longest)


def digits_of(c) -> Column:
    return F.regexp_replace(_c(c), "[^0-9]", "")


def luhn(c) -> Column:
    d = digits_of(c)
    return (F.char_length(d) > 0) & F.call_function("luhn_check", d)


def iban_ok(c) -> Column:
    """ISO 13616 check: rearranged, letters as numbers, remainder 1 of 97."""
    s = F.upper(F.regexp_replace(_c(c), r"\s", ""))
    moved = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    step = lambda acc, ch: F.when(ch.rlike("[A-Z]"), (acc * 100 + F.ascii(ch) - 55) % 97).otherwise((acc * 10 + ch.cast("int")) % 97)
    chars = F.filter(F.split(moved, ""), lambda x: x != "")
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (F.aggregate(chars, F.lit(0), lambda a, x: step(a, x).cast("int")) == 1)


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ein": r"[0-9]{2}-[0-9]{7}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}",
    "nino": r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]",
    "nic": r"[0-9]{9}[vVxX]|[0-9]{12}",
    "pan": r"[A-Z]{5}[0-9]{4}[A-Z]",
    "phone": r"\+?[0-9][0-9 ().-]{6,}[0-9]",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "uk_postcode": r"[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "person_name": r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}",
}


def matches_format(c, kind: str) -> Column:
    """Whole-value match of a recogniser (cards also pass Luhn, IBANs their check)."""
    ok = _c(c).rlike(f"^(?:{FORMATS[kind]})$")
    return ok & luhn(c) if kind == "card" else ok & iban_ok(c) if kind == "iban" else ok


def safe_identifier(c) -> Column:
    return _c(c).rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,127}$")


def escape_members(c) -> Column:
    out = _c(c)
    for ch in "\\,[]":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out


def decoded_views(c) -> Column:
    """The value, and what it hides: URL-, base64- and hex-decoded forms."""
    c = _c(c)
    b64 = F.when(c.rlike("^[A-Za-z0-9+/]+=*$") & (F.char_length(c) % 4 == 0), F.try_to_binary(c, F.lit("base64")))
    hexed = F.when(c.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(c))
    return F.array_compact(F.array(c, F.try_url_decode(c), b64.cast("string"), hexed.cast("string")))


def format_bits(c) -> Column:
    """Bits of the value's shape: a digit log2 10, a letter log2 26."""
    c = _c(c)
    return F.char_length(F.regexp_replace(c, "[^0-9]", "")) * F.lit(3.321928094887362) + F.char_length(F.regexp_replace(c, "[^A-Za-z]", "")) * F.lit(4.700439718141092)


def generalise_prefix(c, keep: int, fill: str = "*") -> Column:
    c = _c(c)
    return F.rpad(F.substring(c, 1, keep), F.char_length(c), fill)


def generalise_postcode(c) -> Column:
    """The outward part: all before the last three characters."""
    s = F.regexp_replace(F.upper(_c(c)), " ", "")
    return F.regexp_extract(s, "^(.*).{3}$", 1)


def map_category(c, mapping: dict[str, str], other: str = "OTHER") -> Column:
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.element_at(m, F.lower(F.trim(_c(c)))), F.lit(other))


def leading_digit(c) -> Column:
    x = F.abs(_c(c))
    return F.when(x > 0, F.floor(x / F.pow(F.lit(10.0), F.floor(F.log10(x)))).cast("int"))


# -- dates ------------------------------------------------------------------------------------


def micros(c) -> Column:
    """UTC microseconds of a (naive or zoned) timestamp."""
    return F.unix_micros(_c(c).cast("timestamp"))


def period_key(c, unit: str) -> Column:
    return F.date_format(_c(c), {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])


def period_end(c, unit: str) -> Column:
    start = F.trunc(_c(c), "month" if unit == "month" else "day") if unit == "month" else F.to_date(_c(c))
    return F.add_months(start, 1) if unit == "month" else F.date_add(start, 1)


def from_offset(anchor: str, c, unit: str) -> Column:
    """Anchor (ISO) plus an offset in s, h or d."""
    k = {"s": 1, "h": 3600, "d": 86400}[unit]
    return F.timestamp_seconds(F.unix_timestamp(F.lit(anchor).cast("timestamp")) + _c(c) * k)


def tenure_start(anchor: str, months) -> Column:
    """Thirty days a month before the anchor date."""
    return F.date_sub(F.lit(anchor).cast("date"), (_c(months) * 30).cast("int"))


def window_index(c, epoch_micros: int, width_micros: int) -> Column:
    """Floor, for instants before the epoch, too."""
    return F.floor((micros(c) - epoch_micros) / width_micros)


def time_axis(c, kind: str) -> Column:
    """POSIX seconds of timestamps, proleptic ordinals of dates, NULL for text and booleans."""
    c = _c(c)
    if kind == "timestamp":
        return micros(c) / 1e6
    if kind == "date":
        return (F.unix_date(c) + 719163).cast("double")
    return c.cast("double") if kind in ("int", "double") else F.lit(None).cast("double")


def date_bucket(c, unit: str) -> Column:
    c = _c(c)
    if unit == "quarter":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c))
    return F.date_format(c, {"year": "yyyy", "month": "yyyy-MM"}[unit])


# -- numbers ----------------------------------------------------------------------------------


def bucket(c, width: float, origin: float = 0.0) -> Column:
    return F.floor((_c(c) - origin) / width) * width + origin


def magnitude_band(c) -> Column:
    """Sign-aware power of ten: [10^e, 10^(e+1))."""
    c = _c(c)
    return F.when(c == 0, "0").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), F.lit("1e"), F.floor(F.log10(F.abs(c))).cast("int").cast("string")))


def logit(c) -> Column:
    p = F.greatest(F.least(_c(c), F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(p / (1 - p))


def finite(c) -> Column:
    """The value, NULL for NaN and infinities."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def hash_uniform(seed: int, *cols) -> Column:
    """Uniform in (0, 1), a function of seed and values alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(_c, cols)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hash_normal(seed: int, *cols) -> Column:
    """Box-Muller on two hash uniforms."""
    return F.sqrt(-2 * F.ln(hash_uniform(seed, *cols))) * F.cos(2 * F.pi() * hash_uniform(seed + 1, *cols))


def hash_lognormal(seed: int, mean: float, sigma: float, *cols) -> Column:
    return F.exp(F.lit(mean) + F.lit(sigma) * hash_normal(seed, *cols))


# -- vectors ----------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


@F.pandas_udf(ArrayType(DoubleType()))
def feature_hash(tokens: pd.Series) -> pd.Series:
    """Signed feature hashing of tokens into a unit vector of 256."""

    def one(ts):
        v = [0.0] * 256
        for t in ts:
            d = hashlib.blake2b(t.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % 256] += 1.0 if d[4] & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    return tokens.map(lambda t: None if t is None else one(t))


# -- hashes -----------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def blake2_128(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


def keyed_hash(c, key: bytes) -> Column:
    """HMAC-SHA256 in column functions, `h_` and 32 hex digits; NULL stays NULL."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    ipad, opad = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    inner = F.sha2(F.unhex(F.concat(F.lit(ipad), F.hex(_c(c).cast("string").cast("binary")))), 256)
    return F.concat(F.lit("h_"), F.substring(F.sha2(F.unhex(F.concat(F.lit(opad), inner)), 256), 1, 32))


def register_sql(spark) -> None:
    """The Python-backed functions under SQL names."""
    spark.udf.register("blake2_128", blake2_128)
    spark.udf.register("canonical_name_exact", canonical_name_exact)
    spark.udf.register("feature_hash", feature_hash)
