"""Plain questions over tables as typed query specifications, built into DataFrames (never into SQL text)."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a read-only query must not contain.
FORBIDDEN = ("DELETE", "DROP", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE")
#: What is asked for -> table, date column, measure, group column.
TARGETS = {"orders": ("orders", "o_orderdate", "o_totalprice", "o_orderpriority"), "customers": ("customer", None, "c_acctbal", "c_mktsegment")}


@dataclass
class QuerySpec:
    table: str
    kind: str = "list"
    measure: str | None = None
    group: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    date: str | None = None
    contains: str | None = None
    limit: int | None = None
    join: tuple[str, str, str] | None = None
    columns: list[str] = field(default_factory=list)


def is_safe(sql: str) -> bool:
    """Whether text is a single read: begins with SELECT, has FROM and none of the forbidden words."""
    t = sql.strip().upper()
    return t.startswith("SELECT") and " FROM " in f" {t} " and not any(re.search(rf"\b{w}\b", t) for w in FORBIDDEN)


def date_range(phrase: str, anchor: dt.date) -> tuple[dt.date, dt.date] | None:
    """Half-open range of a relative phrase: today, yesterday, (this|last|next) (week|month|year); weeks begin on Monday."""
    p = phrase.lower()
    if m := re.search(r"\b(today|yesterday|tomorrow)\b|오늘|어제|내일", p):
        n = {"today": 0, "오늘": 0, "yesterday": -1, "어제": -1, "tomorrow": 1, "내일": 1}[m[0]]
        return anchor + dt.timedelta(n), anchor + dt.timedelta(n + 1)
    words = {"지난": "last", "이번": "this", "다음": "next", "주": "week", "달": "month", "월": "month", "년": "year", "해": "year"}
    m = re.search(r"\b(this|last|next) (week|month|year)\b", p) or re.search(r"(지난|이번|다음) ?(주|달|월|년|해)", p)
    if not m:
        return None
    which, unit = (words.get(x, x) for x in m.groups())
    n = {"last": -1, "this": 0, "next": 1}[which]
    if unit == "week":
        a = anchor - dt.timedelta(anchor.weekday()) + dt.timedelta(7 * n)
        return a, a + dt.timedelta(7)
    if unit == "month":
        k = anchor.year * 12 + anchor.month - 1 + n
        return dt.date(k // 12, k % 12 + 1, 1), dt.date((k + 1) // 12, (k + 1) % 12 + 1, 1)
    return dt.date(anchor.year + n, 1, 1), dt.date(anchor.year + n + 1, 1, 1)


def parse(question: str, anchor: str | None = None) -> QuerySpec:
    """A specification from a question by rules; raises ValueError if no table is named."""
    q = question.lower()
    day = dt.date.fromisoformat(anchor) if anchor else dt.date.today()
    target = next((v for k, v in TARGETS.items() if k in q), None)
    if target is None:
        raise ValueError(f"no table in {question!r}")
    s = QuerySpec(table=target[0], date=target[1])
    if m := re.search(r"\btop (\d+) nations\b", q):
        s.kind, s.group, s.limit, s.join = "ranking", "n_name", int(m[1]), ("nation", "c_nationkey", "n_nationkey")
    elif "average" in q or "평균" in q:
        s.kind, s.measure = "average", target[2]
    elif "how many" in q or "몇" in q:
        s.kind = "count"
    if s.kind != "ranking" and re.search(r"\bby (priority|segment)\b", q):
        s.group = target[3]
    if m := re.search(r"\bcontaining (\S+)", q):
        s.contains = m[1]
    if s.date and (r := date_range(q, day)):
        s.start, s.end = r
    return s


def run(s: QuerySpec, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a specification; Catalyst does the rest."""
    df = tables[s.table]
    if s.join:
        other, a, b = s.join
        df = df.join(tables[other], F.col(a) == F.col(b))
    if s.start:
        df = df.where((F.col(s.date) >= F.lit(s.start)) & (F.col(s.date) < F.lit(s.end)))
    if s.contains and s.group:
        df = df.where(F.contains(s.group, F.lit(s.contains)))
    n = F.count(F.lit(1)).alias("n")
    if s.kind == "list":
        return df.select(*s.columns) if s.columns else df
    agg = F.avg(s.measure).alias("mean") if s.kind == "average" else n
    out = df.groupBy(s.group).agg(agg) if s.group else df.agg(agg)
    if s.kind == "ranking":
        out = out.orderBy(F.col("n").desc(), s.group).limit(s.limit or 10)
    return out
