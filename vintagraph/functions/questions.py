"""What a question asks for, as Spark columns: routes, slots, entities, units of readings, numbers that are no quantities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagraph.functions.text import NUMBER

_t = lambda x: F.lower(F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit("")))
#: Numbers that are no quantities: dates, clock times, versions and ids (fixed patterns).
NO_QUANTITY = r"[0-9]{4}년( [0-9]{1,2}월)?( [0-9]{1,2}일)?|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[vV][0-9]+(\.[0-9]+)*|[A-Za-z]+[-_][0-9]+|[0-9]+-[0-9]+"
#: Spellings of units in readings, and factors (fixed values).
UNIT_OF = {"pct": ("%", 1.0), "percent": ("%", 1.0), "bp": ("bps", 1.0), "decimal_rate": ("%", 100.0)}
#: Particles that follow the name of a place.
PARTICLES = r"(?:에서의|에서|으로|까지|부터|에는|에|로|의|은|는|이|가|을|를)$"


def quantities(x) -> Column:
    """The numbers of a text that are quantities."""
    c = F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(""))
    return F.regexp_extract_all(F.regexp_replace(c, NO_QUANTITY, " "), F.lit(NUMBER), F.lit(0))


def ranges(x, units: list[str]) -> Column:
    """Values or ranges with a unit and the word before them, of a text: 'word 3 ~ 5 mg/L'."""
    u = "|".join(sorted((w.replace("%", "%") for w in units), key=len, reverse=True))
    c = F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(""))
    return F.regexp_extract_all(c, F.lit(rf"[^\s]+ {NUMBER}(?: ?[~-] ?{NUMBER})? ?(?:{u})"), F.lit(0))


def ingested_unit(unit: Column) -> tuple[Column, Column]:
    """(unit, factor) as readings are stored; an unknown unit stays, trimmed, with factor 1."""
    u = F.trim(unit)
    return F.coalesce(*[F.when(F.lower(u) == k, F.lit(v)) for k, (v, _) in UNIT_OF.items()], u), F.coalesce(*[F.when(F.lower(u) == k, F.lit(f)) for k, (_, f) in UNIT_OF.items()], F.lit(1.0))


def route(x, priority: list[tuple[str, list[str]]], words: dict[str, list[str]], default: str, margin: int = 1) -> Column:
    """The route of a question: the first one with a priority word, else the one with most key words if it leads by
    ``margin`` (ties to the first in order), else ``default``."""
    q = _t(x)
    has = lambda ws: reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in ws])
    count = {r: sum((F.contains(q, F.lit(w)).cast("int") for w in ws), F.lit(0)) for r, ws in words.items()}
    c = F.lit(None).cast("string")
    for r, n in reversed(count.items()):
        others = [m for o, m in count.items() if o != r]
        lead = n - (F.greatest(*others) if len(others) > 1 else others[0] if others else F.lit(0)) >= margin
        c = F.when((n > 0) & lead, r).otherwise(c)
    for r, ws in reversed(priority):
        c = F.when(has(ws), r).otherwise(c)
    return F.coalesce(c, F.lit(default))


def place(x, suffix: str = "") -> Column:
    """A place name without particles, with ``suffix`` if it lacks it; blank or null gives null."""
    c = F.regexp_replace(F.trim(x if isinstance(x, Column) else F.col(x)), PARTICLES, "")
    c = F.when(F.endswith(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix))) if suffix else c
    return F.nullif(c, F.lit(""))


def slots(x) -> dict[str, Column]:
    """aggregate, period, top and condition that a question names, null where it names none."""
    q = _t(x)
    agg = F.when(q.rlike("평균|average|mean"), "avg").when(q.rlike("합계|총|total|sum of"), "sum").when(q.rlike("최대|가장 높|highest|maximum"), "max").when(q.rlike("최소|가장 낮|lowest|minimum"), "min").when(q.rlike("몇|건수|how many|count"), "count")
    period = F.when(q.rlike("시간대|hourly|per hour"), "hour").when(q.rlike("일별|daily|per day"), "day").when(q.rlike("월별|monthly|per month"), "month")
    top = F.coalesce(F.nullif(F.regexp_extract(q, "상위 ?([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(q, "top ([0-9]+)", 1), F.lit(""))).cast("int")
    cond = F.nullif(F.regexp_extract(q, r"([0-9]+(?:\.[0-9]+)?) ?(?:이상|or more|at least)", 1), F.lit("")).cast("double")
    return {"aggregate": agg, "period": period, "top": top, "at_least": cond}


def statement(table: str, measure: str, time: str, s: dict[str, Column]) -> Column:
    """The SELECT of a question's slots over one table."""
    value = F.when(s["aggregate"] == "count", F.lit("count(*)")).otherwise(F.concat(F.coalesce(s["aggregate"], F.lit("avg")), F.lit(f"({measure})")))
    unit = F.concat(F.lit("date_trunc('"), s["period"], F.lit(f"', {time})"))
    where = F.concat(F.lit(f" WHERE {measure} >= "), s["at_least"].cast("string"))
    return F.concat(F.lit("SELECT "), F.coalesce(F.concat(unit, F.lit(" AS period, ")), F.lit("")), value, F.lit(f" AS result FROM {table}"), F.coalesce(where, F.lit("")), F.coalesce(F.concat(F.lit(" GROUP BY "), unit), F.lit("")), F.coalesce(F.concat(F.lit(" ORDER BY result DESC LIMIT "), s["top"].cast("string")), F.lit("")))


def reasoning(x) -> Column:
    """What a question reasons about: cause, effect, compare, condition, or fact."""
    q = _t(x)
    return F.when(q.rlike("왜|원인|why|because"), "cause").when(q.rlike("영향|이후|effect|mean for|how did"), "effect").when(q.rlike("비교|차이|compare|difference"), "compare").when(q.rlike("하면|되면|when |if "), "condition").otherwise("fact")


def dialect_ok(x) -> Column:
    """Whether a statement is a query and uses none of the functions that differ between engines."""
    q = _t(x)
    return (F.trim(q) != "") & q.rlike(r"\b(?:select|with)\b") & ~q.rlike(r"\b(?:date_trunc|to_date|to_timestamp|extract|date_part)\b")
