"""Chunkers: fixed windows, sliding windows that end at boundaries, sentence packing, structured legal text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries a window's end moves back to, strongest first.
ENDS = (".。!?", ",:\n", " ")
SENTENCE = re.compile(r"(?<=[.!?。])\s+")


def fixed(docs: DataFrame, size: int = 500) -> DataFrame:
    """id, chunk, start, text: pieces of ``size`` characters; null and empty texts give none."""
    n = F.length("text")
    i = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return docs.where("length(text) > 0").select("id", "text", i.alias("chunk")).select("id", "chunk", (F.col("chunk") * size).alias("start"), F.substring("text", F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def slide(text: str, size: int = 802, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of windows size - overlap apart; an end moves back within 10 % to a boundary, the next start does not."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            back = end - size // 10
            for marks in ENDS:
                at = max((text.rfind(m, back, end) for m in marks), default=-1)
                if at >= 0:
                    end = at + 1
                    break
        out.append((start, end))
        if end >= len(text):
            break
        start += size - overlap
    return out


def pack(text: str, most: int = 600, carry: int = 100, least: int = 50) -> list[str]:
    """Sentences packed up to ``most`` characters, each chunk led by the last sentences of the one before (up to ``carry``)."""
    out, cur, n = [], [], 0
    for s in SENTENCE.split(text):
        if cur and n + len(s) > most:
            out.append(" ".join(cur))
            tail, m = [], 0
            while cur and m + len(cur[-1]) <= carry:
                m += len(cur[-1])
                tail.insert(0, cur.pop())
            cur, n = tail, m
        cur.append(s)
        n += len(s)
    if cur:
        out.append(" ".join(cur))
    # a short chunk goes with the one before it, so that nothing of the text is lost
    kept: list[str] = []
    for c in out:
        if kept and len(c) < least:
            kept[-1] += " " + c
        else:
            kept.append(c)
    if len(kept) > 1 and len(kept[0]) < least:
        kept[:2] = [kept[0] + " " + kept[1]]
    return kept


def chunked(docs: DataFrame, how, name: str) -> DataFrame:
    """id, chunk, text by a Python chunker from text to (start, end) or strings; null texts give none."""

    @F.pandas_udf("array<string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([[t[p[0] : p[1]] if isinstance(p, tuple) else p for p in how(t)] if t else [] for t in texts])

    return docs.select("id", F.posexplode(run("text")).alias("chunk", "text")).withColumn("kind", F.lit(name))


#: An article's heading at the start of a line.
_ARTICLE = r"[^\w\n]*제 ?([0-9]+) ?조"


def legal(docs: DataFrame) -> DataFrame:
    """id, article, n_lines, text: lines grouped under the article heading above them; lines before any are article 0.

    Texts are cut before headings only, however many lines they have. A number beyond bigint is null, its article still its own.
    """
    s = docs.where("text is not null").select("id", F.posexplode(F.split("text", f"\n(?={_ARTICLE})")).alias("n", "part"))
    digits = F.ltrim(F.regexp_extract("part", f"^{_ARTICLE}", 1), F.lit("0"))
    lines = F.length("part") - F.length(F.replace("part", F.lit("\n"), F.lit(""))) + 1
    g = s.groupBy("id", digits.alias("_digits")).agg(F.sum(lines).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return g.select("id", F.when(F.col("_digits") == "", F.lit(0)).otherwise(F.col("_digits").try_cast("bigint")).alias("article"), "n_lines", "text")


#: A number with what follows it, which no cut may part (fixed pattern of the windows below).
_MEASURE = re.compile(r"[0-9]+(?:[.,][0-9]+)* ?[^\W\d_]{0,8}")


def bounded(text: str, most: int = 384, least: int = 128, shared: float = 0.25) -> list[tuple[int, int]]:
    """(start, end) of windows of ``least`` to ``most`` characters (50 more to reach a boundary) that share a quarter.

    An end goes to the boundary nearest to .8 of the window, if one lies beyond ``least``; it then moves out of a
    measurement that it would part. The next window starts ``shared`` of the window before the end, or ``least`` on.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(n, start + most)
        if end < n:
            want = start + int(0.8 * most)
            marks = [i + 1 for i in range(start + least, min(n, end + 50)) if text[i] in ".!?。\n" and (i + 1 == n or text[i + 1].isspace())]
            if marks:
                end = min(marks, key=lambda m: (abs(m - want), m))
            for m in _MEASURE.finditer(text, max(start, end - 50), min(n, end + 50)):
                if m.start() < end < m.end() and m.start() > start + least:
                    end = m.start()
        out.append((start, end))
        if end >= n:
            break
        back = end - int(shared * most)
        start = back if back > start else start + least
    return out


def sections(text: str, heads: str, most: int = 600) -> list[tuple[int, int]]:
    """(start, end): cut where a line matches ``heads``, and sections longer than ``most`` into windows of sentences."""
    at = [m.start() for m in re.finditer(heads, text, re.M)]
    cuts = sorted({0, *at, len(text)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        while b - a > most:
            stop = max((m.end() for m in SENTENCE.finditer(text, a, a + most)), default=a + most)
            out.append((a, stop))
            a = stop
        if b > a:
            out.append((a, b))
    return out


#: Headings of legal texts, outermost first (fixed patterns): chapter, section, article.
LEGAL = r"^\W*(?:제 ?[0-9]+ ?[장절조]|(?:Chapter|Section|Article) [0-9]+)"


def articles(text: str, most: int = 1000) -> list[tuple[int, int]]:
    """Chapters, sections and articles of a legal text, long ones by sentences; a text without headings goes by paragraphs."""
    return sections(text, LEGAL if re.search(LEGAL, text, re.M) else r"(?<=\n\n)^", most)


def numeric(chunks: DataFrame, pattern: str, around: int = 100) -> DataFrame:
    """id, chunk, text: for every chunk (id, chunk, text) with a number an extra one, made of the end of the chunk before,
    the text, the beginning of the next, and the numbers twice."""
    w = Window.partitionBy("id").orderBy("chunk")
    numbers = F.array_join(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), " ")
    c = chunks.withColumn("_a", F.lag("text").over(w)).withColumn("_b", F.lead("text").over(w)).withColumn("_n", numbers).where("_n <> ''")
    return c.select("id", "chunk", F.concat_ws(" ", F.right("_a", F.lit(around)), "text", F.left("_b", F.lit(around)), "_n", "_n").alias("text"))
