"""Splitting oversized texts at natural boundaries (problem 2), by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint (paragraph, then sentence, then word),
the halves again until they fit into the limit less the overlap; then every piece but the first is extended
backwards by the overlap, to the boundary nearest to it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: Positions after which a text may be cut, from strong to weak.
_KINDS = (re.compile(r"\n[ \t\r]*\n\s*"), re.compile(r"[.!?。！？…][\"')\]”’]*\s+|\n+"), re.compile(r"\s+"))


def _joined(text: str, p: int) -> bool:
    """Whether a cut at p would part a character from its combining marks or joiners."""
    c = text[p]
    return bool(unicodedata.combining(c)) or c in "‍️︎" or text[p - 1] == "‍"


def _nearest(places: list[int], want: float, lo: int, hi: int) -> int | None:
    """Of the places in lo..hi (included) the one nearest to ``want``; the smaller one of two."""
    a, b = bisect_left(places, lo), bisect_right(places, hi)
    if a >= b:
        return None
    i = bisect_left(places, want, a, b)
    near = [places[j] for j in (i - 1, i) if a <= j < b]
    return min(near, key=lambda p: (abs(p - want), p))


def split(text: str | None, limit: int = 800, overlap: int = 80) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as (start, own, end): [start, end) is the piece, [own, end) its part after the overlap.

    The text counts without leading and trailing blanks, tabs, CR and LF; a null text, or one of nothing else, has no
    pieces; one within the limit is one piece. The own parts of the pieces, put together, are the text.
    """
    if text is None:
        return []
    body = text.strip(BLANKS)
    if not body:
        return []
    first = len(text) - len(text.lstrip(BLANKS))
    n = len(body)
    if n <= limit:
        return [(first, first, first + n)]
    kinds = [[m.end() for m in k.finditer(body) if 0 < m.end() < n] for k in _KINDS]
    room, cuts, stack = limit - overlap, [], [(0, n)]
    while stack:
        s, e = stack.pop()
        if e - s <= room:
            continue
        mid, reach = (s + e) / 2, (e - s) // 4
        cut = next((c for k in kinds if (c := _nearest(k, mid, max(s + 1, int(mid) - reach), min(e - 1, int(mid) + reach))) is not None), None)
        if cut is None:  # no boundary near the middle: the nearest one there is, else the middle itself
            cut = next((c for k in kinds if (c := _nearest(k, mid, s + 1, e - 1)) is not None), None)
        if cut is None:
            cut = int(mid)
            while cut > s + 1 and _joined(body, cut):
                cut -= 1
        cuts.append(cut)
        stack += [(s, cut), (cut, e)]
    edges = [0, *sorted(cuts), n]
    pieces = []
    for i, (s, e) in enumerate(zip(edges, edges[1:])):
        start = s
        if i and overlap:
            least = max(edges[i - 1], e - limit)
            want = max(least, s - overlap)
            near = _nearest(kinds[2], want, max(least, want - overlap // 2), min(s - 1, want + overlap // 2))
            start = want if near is None else near
        pieces.append((first + start, first + s, first + e))
    return pieces


def pieces(chunks: DataFrame, id_: str, content: str, keep: list[str], limit: int = 800, overlap: int = 80) -> DataFrame:
    """One row per piece: ``id_``, the columns of ``keep``, piece_no (from 1), n_pieces, start, own, end, piece.

    start, own and end are code points of the content (see ``split``). Null and blank contents give no row. Other
    columns are left out, so clashing names do no harm.
    """
    kind = "array<struct<piece_no:int,n_pieces:int,start:int,own:int,end:int,piece:string>>"

    @F.pandas_udf(kind)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                p = split(t, limit, overlap)
                out.append([(i + 1, len(p), s, o, e, t[s:e]) for i, (s, o, e) in enumerate(p)])
            yield pd.Series(out)

    rows = chunks.select(id_, *keep, F.explode(cut(content)).alias("_p"))
    return rows.select(id_, *keep, "_p.*")
