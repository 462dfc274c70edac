"""Scalar text functions as Spark columns. Null in, null out, unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
#: Units that are read after a number.
UNITS = ["mg/L", "m3/h", "kWh", "kPa", "NTU", "ppm", "degC", "percent", "metres", "minutes", "hours", "days", "%p", "%", "℃", "개월", "시간", "포인트", "건", "분", "일", "주", "회", "대"]
#: Other spellings of units.
SYNONYMS = {"percent": "%", "degC": "℃", "minutes": "분", "hours": "시간", "days": "일", "pct": "%", "bp": "bps"}
#: Factors from one unit to another.
FACTORS = {("시간", "분"): 60.0, ("분", "시간"): 1 / 60, ("일", "시간"): 24.0, ("kPa", "Pa"): 1000.0, ("mg/L", "ppm"): 1.0, ("ppm", "mg/L"): 1.0}


def clean(x) -> Column:
    """Control characters out, dashes to '-', blanks collapsed, at most one empty line, trimmed."""
    c = F.regexp_replace(_c(x), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"[\x{2010}-\x{2015}]", "-")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n\r\t]+|[ \n\r\t]+$", "")


def words(x) -> Column:
    """Runs of letters, digits and underscores, lower case; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(x, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of lo..hi characters, repeats kept, of the text in lower case with blanks collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"\s+", " ")
    # the text is cut into characters once, so that the work is linear in its length
    chars = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    one = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(chars), lambda c: F.flatten(F.array(*[one(c, n) for n in range(lo, hi + 1)]))))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct elements that the text has; 0 for an empty query."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, text)), F.size(F.array_distinct(query))), F.lit(0.0))


def measurements(x) -> Column:
    """array<string> of number and unit, e.g. '3.5 mg/L'."""
    unit = "|".join(sorted((u.replace("%", "%") for u in UNITS), key=len, reverse=True))
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(rf"({NUMBER}) ?(?:{unit})"), F.lit(0))


def measured_value(m: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(m, NUMBER, 0), ",", "").try_cast("double")


def measured_unit(m: Column) -> Column:
    """The unit, synonyms put to one spelling."""
    u = F.regexp_replace(m, rf"^{NUMBER} ?", "")
    return F.coalesce(*[F.when(u == k, F.lit(v)) for k, v in SYNONYMS.items()], u)


def convert(value: Column, source: Column, target: Column) -> Column:
    """A value in another unit; the same unit changes nothing, unknown pairs give null."""
    c = F.when(source == target, value)
    for (a, b), f in FACTORS.items():
        c = c.when((source == a) & (target == b), value * f)
    return c


def iso_date(x) -> Column:
    """The first date of a text, of the forms Y년 M월 D일, Y.M.D, Y/M/D and Y-M-D, as YYYY-MM-DD; null if there is none."""
    p = r"([0-9]{4})(?:년 ?|[./-])([0-9]{1,2})(?:월 ?|[./-])([0-9]{1,2})"
    g = lambda i: F.regexp_extract(_c(x), p, i)
    return F.when(g(1) != "", F.concat_ws("-", g(1), F.lpad(g(2), 2, "0"), F.lpad(g(3), 2, "0")))


def parse_timestamp(x) -> Column:
    """A timestamp from eight text forms, epoch seconds or milliseconds; naive ones are UTC, others null."""
    c = F.trim(_c(x))
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd"]
    epoch = F.when(c.rlike(r"^[0-9]{10}$"), F.timestamp_seconds(c.try_cast("bigint"))).when(c.rlike(r"^[0-9]{13}$"), F.timestamp_millis(c.try_cast("bigint")))
    return F.coalesce(epoch, *[F.try_to_timestamp(c, F.lit(f)) for f in forms])


def parse_value(x) -> Column:
    """A number from text with commas, units and signs; null if there is none."""
    return F.regexp_replace(_c(x), r"[^0-9.eE+\-]", "").try_cast("double")


def quality_flag(missing: Column, error: Column, estimated: Column) -> Column:
    return F.when(missing, "missing").when(error, "error").when(estimated, "estimated").otherwise("ok")


def sentiment(x) -> Column:
    """-1..1 from a number (clamped) or a word."""
    c = F.lower(F.trim(_c(x)))
    word = F.when(c == "very positive", 0.8).when(c == "positive", 0.5).when(c == "negative", -0.5).when(c == "very negative", -0.8).when(c == "neutral", 0.0)
    n = c.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n))).otherwise(word)


def content_hash(x) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def noise(x) -> Column:
    """0..1: share of U+FFFD, of suspicious marks and of punctuation."""
    t = F.coalesce(_c(x), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    bad, odd, punct = (F.regexp_count(t, F.lit(p)) for p in (r"\x{FFFD}", r"[|~^`\\]", r"[^\p{L}\p{N}\s]"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * bad / n + 0.4 * odd / F.greatest(F.lit(1.0), n / 20.0) + 0.2 * punct / n))


def truncate(x, limit: int) -> Column:
    """At most ``limit`` characters, to the last full stop or line end after 70 %, else with '...'."""
    head = F.substring(_c(x), 1, limit)
    kept = F.regexp_extract(head, r"(?s)^(.*[.\n])", 1)
    return F.when(F.length(_c(x)) <= limit, _c(x)).when(F.length(kept) > int(limit * 0.7), F.rtrim(kept)).otherwise(F.concat(head, F.lit("...")))


#: Patterns of question types in order; a digit makes a question numeric.
TYPES = [("numeric", r"[0-9]|얼마|몇|how many|how much|what is the limit"), ("procedure", r"어떻게|해야|should|how often|how did"), ("definition", r"무엇|란 |정의|what does|mean"), ("deadline", r"기한|언제|deadline|when")]
#: Weights of vector and keyword search by type.
WEIGHTS = {"numeric": (0.3, 0.7), "procedure": (0.6, 0.4), "definition": (0.7, 0.3), "deadline": (0.4, 0.6), "general": (0.5, 0.5)}


def question_type(x) -> Column:
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    c = F.when(t.rlike(TYPES[0][1]), TYPES[0][0])
    for name, p in TYPES[1:]:
        c = c.when(t.rlike(p), name)
    return c.otherwise("general")


def polarity(x, up: list[str], down: list[str]) -> Column:
    """'+', '-', 'mixed' or null by the words a text contains."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    has = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(t, w))
    p, n = has(up), has(down)
    return F.when(p & n, "mixed").when(p, "+").when(n, "-")


def article(x) -> Column:
    """'제n조' or 'section n' as art-n, the first of a text; null if there is none."""
    n = F.coalesce(F.nullif(F.regexp_extract(_c(x), r"제 ?([0-9]+) ?조", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(_c(x)), r"section ([0-9]+)", 1), F.lit("")))
    return F.concat(F.lit("art-"), n)


def calibrate(score: Column, temperature: float = 1.0, bias: float = 0.0) -> Column:
    """1 / (1 + exp(-(score / T + b)))."""
    return 1 / (1 + F.exp(-(score / temperature + bias)))


def band(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.6, "medium").when(conf >= 0.4, "low").otherwise("very_low")


def expand(x, additions: dict[str, list[str]]) -> Column:
    """A text with the additions of every key word that it contains (case disregarded), in order of the key words."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    parts = [F.when(F.contains(t, F.lit(k.lower())), F.lit(" ".join(v))) for k, v in additions.items()]
    return F.when(_c(x).isNotNull(), F.concat_ws(" ", _c(x), *parts))


def strengthened(conf: Column, support: Column) -> Column:
    """Confidence + .02 a support, at most .99."""
    return F.least(F.lit(0.99), conf + 0.02 * support)


def weakened(conf: Column, against: Column) -> Column:
    """Confidence x .9 for every contradiction, at least .05."""
    return F.greatest(F.lit(0.05), conf * F.pow(F.lit(0.9), against))
