"""Template residue and error-page text (problem 10).

Documents are masked (numbers, addresses, dates) and cut into messages (lines and sentences); equal messages, by hash,
are one group over all documents and sources. Each group is judged once, from one example and from its use:

- by use: a message that recurs in several sources and stands mostly in documents that hold little else stands in for
  content, whatever its words say (error pages, demands for scripts, filler, navigation around them);
- by phrase rules: messages of error pages, demands for scripts and filler, if they recur across sources or stand at
  an edge of a document or in one that holds little else;
- by placeholder rules: a field between marks. Fields are grouped themselves; forms that ordinary text uses too count
  only where the same form recurs across sources around unlike text;
- by vocabulary: dummy Latin, whose words are learned from the company of the first words of the standard passage;
- by its end: a message that breaks off into one of the messages found before.

A document with a message of such a group is residue.
"""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagraph.session import cut, small, spread

#: Sources from which a message or form recurs; of a message judged by its use.
SOURCES, WIDE = 2, 3
#: Messages up to which a document holds little else, and the share of such documents a group must reach (lower end of
#: its confidence interval, with so many deviations).
SHORT, ALONE, DEVIATIONS = 5, 0.5, 1.96
#: Learned words of dummy text: messages, share of these beside known ones; share of a message's words, and words.
LEARNED, BESIDE, DUMMY, DUMMY_WORDS = 3, 0.8, 0.8, 4
_NAME = r"[A-Za-z가-힣_][A-Za-z0-9가-힣_.#\-]*(?: [가-힣A-Za-z_][A-Za-z0-9가-힣_.#\-]*)?"
#: A name as code writes it: no second word in Latin letters (a<b and b>c is no placeholder).
_ONE = r"(?:[A-Za-z_][A-Za-z0-9_#]*(?:[.\-][A-Za-z0-9_#]+)*|[가-힣]+(?: [가-힣]+)?)"
#: HTML elements are markup, not placeholders.
_HTML = r"(?:a|b|i|p|br|hr|li|ul|ol|td|tr|th|em|h[1-6#]|div|img|pre|sub|sup|span|code|body|head|html|link|meta|main|form|table|tbody|thead|title|style|strong|script|noscript|section)"
_ASKED = r"(?:입력|기입|작성|삽입|기재)"
#: Placeholders: forms that only template languages have, and forms that ordinary text may use.
STRICT = [
    r"\{\{\s*" + _NAME + r"\s*\}\}",
    r"\{%\s*" + _NAME + r"\s*%\}",
    r"[$#]\{\s*" + _NAME + r"\s*\}",
    r"<%=?\s*" + _NAME + r"\s*%>",
    r"\[\[\s*" + _NAME + r"\s*\]\]",
    r"%\(" + _NAME + r"\)[sdf]|%\{" + _NAME + r"\}",
    r"\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|enter) [^\[\]]{1,40}\]|\[[^\[\]]{1,40} " + _ASKED + r"\]",
    r"@@" + _NAME + r"@@",
    r"<<\s*" + _NAME + r"\s*>>",
    r"(?<!\w)__[A-Za-z가-힣][A-Za-z0-9가-힣_.# \-]*?__(?!\w)",
    r"(?<![A-Za-z])XX[A-Za-z가-힣_][A-Za-z0-9가-힣_.#\-]*(?: [가-힣]+)?XX(?![A-Za-z])",
    r"(?<!\w)%%?[A-Z_]{3,}%%?(?!\w)",
    r"(?<!\w)(?:TODO|FIXME|TBD)\s*[:：]",
    r"#?XX년|XX월 XX일|YYYY년|MM월 DD일",
    r"[○□△◇〇]{2,}",
]
LOOSE = [
    r"(?<![\w{$#])\{" + _ONE + r"\}",
    r"«\s*" + _NAME + r"\s*»",
    r"&lt;\s*" + _ONE + r"\s*&gt;",
    r"(?<![<\w])<(?!/?" + _HTML + r"\b)" + _ONE + r">(?!>)",
    r"\((?:[A-Za-z_][A-Za-z0-9_.\-]*|[가-힣]+(?: [가-힣]+)?) " + _ASKED + r"\)|\((?:여기에|이곳에) [^()]{1,30}\)",
    r"[가-힣 ]{1,12}안에 [가-힣 ]{1,12}(?:을|를) (?:쓰세요|적으세요|입력하세요|넣으세요)",
]
#: A message without any of these marks has no placeholder.
_MARK = r"[{<«&\[@(○□△◇〇%]|__|XX|YYYY|MM월|TODO|FIXME|TBD|안에"
#: First words of the standard passage of dummy text (fixed values).
PASSAGE = ["lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore", "aliqua"]
#: Phrases of filler, in general terms.
FILLER = [
    r"(?i)\blorem ipsum\b",
    r"(?i)^(?:placeholder|dummy|sample|example) (?:paragraph|text|copy|content|heading|title)\b",
    r"(?i)^(?:click|tap) to (?:edit|add)\b",
    r"(?i)^(?:add|insert|enter|write) (?:a|an|your) (?:short |brief )?(?:description|summary|title|text)\b",
    r"(?i)^your (?:text|content|title|copy|heading) (?:goes? )?here",
    r"(?i)(?:\btest\b\W+){2,}test",
    r"(?i)\b(?:asdf|qwer|qwerty|zxcv)\b(?:\W+\b(?:asdf|qwer|qwerty|zxcv)\b)+",
    r"가나다라마바사",
    r"^(?:예시|샘플|임시) (?:문단|텍스트|문구)",
    r"^(?:이곳|여기)에 [가-힣 ]{1,14}(?:을|를|이|가) (?:입력|작성|들어|붙여|넣)",
    r"^[가-힣 ]{1,10}(?:을|를) (?:여기에 |이곳에 )?(?:붙여 넣|입력해 |입력하|작성해 |작성하)",
    r"^내용 (?:준비|작성) 중",
]
#: The reason phrases of HTTP errors come from the standard library.
_REASONS = "|".join(sorted({s.phrase for s in HTTPStatus if s >= 400}))
#: Phrases of servers and programs that failed, in general terms (numbers are masked as #).
ERRORS = [
    r"(?i)^(?:http )?(?:error|오류) ?#\W*(?:$|(?:" + _REASONS + r"|요청|페이지|서비스))",
    r"(?i)^(?:# )?(?:" + _REASONS + r")\W*$",
    r"(?i)^fatal error\s*:",
    r"^Traceback \(most recent call last\)",
    r"^[A-Z][A-Za-z]+(?:Error|Exception)\s*:",
    r"(?i)^(?:uncaught |unhandled )?exception (?:in|at|:)",
    r"(?i)^sql ?state\W",
    r"(?i)server has gone away\W*$",
    r"(?i)^upstream (?:timed out|connect error)",
    r"(?i)^please try again (?:in|after) # (?:second|minute)s?\b",
    r"(?i)^(?:the|this) (?:page|document|site) (?:has moved|could not be (?:found|served|loaded)|is (?:temporarily )?unavailable)\W*$",
    r"(?i)^(?:access denied|permission denied|connection (?:refused|reset|timed out)|page not found|session expired)\W*$",
    r"^요청하신 (?:페이지|주소|문서|자료)(?:를|을) 찾을 수 없",
    r"^세션이 만료되었",
    r"^(?:시스템|서버|사이트) 점검 중",
    r"^일시적(?:인|으로)? ?(?:장애|오류)",
    r"^(?:서비스 )?접근 권한이 없",
]
#: Demands to switch scripts on, in general terms.
SCRIPTS = [
    r"(?i)<noscript>",
    r"(?i)^(?:please |you need to |you must )?(?:turn on|enable|allow|activate|switch on) (?:java)?scripts?\b",
    r"(?i)^(?:this|your|if) (?:app|page|site|viewer|report|browser|nothing)\b.*\b(?:java)?script(?:s|ing)?\b",
    r"(?i)^(?:java)?scripts? (?:is|are) (?:required|disabled|switched off)\b",
    r"^(?:이 [가-힣]+(?:를|을) .*|브라우저에서 )?(?:자바)?스크립트(?:가|를| 실행이) .*(?:설정|허용|켜|차단|꺼져|비활성)",
]
RULES = {"filler": FILLER, "error": ERRORS, "scripts": SCRIPTS}
#: What ends a message: a sentence or line, with the marks of lists that may follow. Blanks are collapsed before.
_END = r"(?:(?<=[.!?。])\s+|[\n\r\x0b\x0c][\s]*)(?:(?:[-*•>#]+|#\)) +)*"
#: Blanks that count as a space, and characters that don't count.
_BLANK = "\t\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_VOID = "".join(chr(c) for c in [*range(9), *range(14, 32), 127, 0x200B, 0x200C, 0x200D, 0xFEFF])


def _any(col: Column, rules: list[str]) -> Column:
    plain, free = [r for r in rules if not r.startswith("(?i)")], [r[4:] for r in rules if r.startswith("(?i)")]
    tests = ([col.rlike("|".join(f"(?:{r})" for r in plain))] if plain else []) + ([col.rlike("(?i)" + "|".join(f"(?:{r})" for r in free))] if free else [])
    return tests[0] if len(tests) == 1 else tests[0] | tests[1] if tests else F.lit(False)


def masked(text: Column) -> Column:
    """A text without what varies: addresses, mail, dates and numbers (all #)."""
    return F.regexp_replace(text, r"https?://\S+|www\.\S+|[\w.+\-]+@[\w\-]+\.[\w.\-]+|\d+(?:[.,\-/]\d+)*", "#")


def messages(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """_doc, _src, message (masked), k (messages of the document), edge (first or last), copy (hash of the document's
    messages, of its id if it has but one): the distinct lines and sentences of each document, blanks collapsed, control
    characters out. Messages of one character are left out."""
    rows = spread(docs.select(doc_id, text, source).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()))
    clean = F.regexp_replace(masked(F.translate(text, _BLANK + _VOID, " " * len(_BLANK))), " {2,}", " ")
    parts = F.array_distinct(F.split(F.concat(F.lit("\n"), F.trim(clean)), _END))
    rows = rows.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(source), F.lit("")).alias("_src"), parts.alias("_m"))
    n = F.size("_m") - 1  # the first part is empty
    each = rows.select("_doc", "_src", n.alias("k"), F.when(n == 1, F.xxhash64("_doc")).otherwise(F.xxhash64("_m")).alias("copy"), F.posexplode_outer("_m").alias("i", "message"))  # the inner form would cut the texts twice, once for its own filter
    return each.where("length(message) > 1").select("_doc", "_src", "k", "copy", ((F.col("i") == 1) | (F.col("i") == F.col("k"))).alias("edge"), "message")


def groups(m: DataFrame) -> DataFrame:
    """h, n_docs, n_sources, n_short (documents that hold little else), edge, example of every masked message.

    ``n_sources`` is a lower bound: the sources fall into 64 cells, of which those in use are counted.
    """
    cell = F.expr("shiftleft(1L, cast(pmod(xxhash64(_src), 64) as int))")
    g = m.groupBy(F.col("message").alias("example")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("k") <= SHORT).alias("n_short"), F.max("edge").alias("edge"), F.bit_count(F.bit_or(cell)).cast("bigint").alias("n_sources"))
    return g.select(F.xxhash64("example").alias("h"), "*")


def phrase_kind(message: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """The kind of a masked message by the phrase rules, null if none applies."""
    return F.coalesce(*[F.when(_any(message, r), F.lit(kind)) for kind, r in (RULES if rules is None else rules).items()], F.lit(None).cast("string"))


def by_use() -> Column:
    """Whether a group stands in for content: the lower end of the interval (Wilson) of its share of short documents."""
    n, z = F.col("n_docs"), DEVIATIONS
    p = F.col("n_short") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (F.col("n_sources") >= WIDE) & (low >= ALONE)


def placeholders(g: DataFrame) -> DataFrame:
    """h of the groups with a placeholder that was never filled; loose forms count where they recur across sources.

    A form recurs if at least SOURCES groups have it and their sources are as many (a group of n sources counts n).
    """
    marked = g.where(F.col("example").rlike(_MARK))
    forms = [F.when(F.col("example").rlike(r), F.struct(F.lit(i).alias("form"), F.lit(i < len(STRICT)).alias("strict"))) for i, r in enumerate([*STRICT, *LOOSE])]
    hit = marked.select("h", "n_sources", F.explode_outer(F.array_compact(F.array(*forms))).alias("f")).where("f is not null").select("h", "n_sources", "f.*")
    recurs = hit.groupBy("form").agg(F.sum("n_sources").alias("_s")).where(F.col("_s") >= SOURCES).select("form")
    return hit.where("strict").select("h").unionByName(hit.where("not strict").join(F.broadcast(recurs), "form", "left_semi").select("h")).distinct()  # as many forms as there are rules


def dummy_text(g: DataFrame) -> DataFrame:
    """h of the groups of dummy Latin: words that stand nearly always beside words of the standard passage."""
    w = g.select("h", F.array_distinct(F.regexp_extract_all(F.lower("example"), F.lit(r"[\p{L}#]+"), F.lit(0))).alias("w"))
    seeded = F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in PASSAGE]))) > 0
    each = w.select("h", F.size("w").alias("n"), seeded.alias("seeded"), F.explode_outer("w").alias("x")).where("x is not null")
    known = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("seeded").cast("int")).alias("share")).where((F.col("n") >= LEARNED) & (F.col("share") >= BESIDE) | F.col("x").isin(PASSAGE)).select("x")
    hits = each.join(small(cut(known)), "x", "left_semi").groupBy("h", "n").agg(F.count(F.lit(1)).alias("k"))
    # a message of few different words repeats them
    return hits.where((F.col("k") >= DUMMY * F.col("n")) & (F.col("k") >= DUMMY_WORDS)).select("h")


def judged(g: DataFrame, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """h, kind, used of the groups that are residue: placeholder, filler, error, scripts, or recurring (``used``: only its
    use, or that of the message it breaks off into, tells)."""
    own = (F.col("n_sources") >= SOURCES) | F.col("edge") | (F.col("n_short") > 0)
    said = g.withColumn("phrase", F.when(own, phrase_kind(F.col("example"), rules)))
    whole = cut(said.withColumn("kind", F.coalesce("phrase", F.when(by_use(), "recurring"))).where("kind is not null").select("h", "kind", F.size(F.split("example", " ")).alias("words"), F.length("example").alias("length")))
    marks = placeholders(g).withColumn("kind", F.lit("placeholder"))
    latin = dummy_text(g).withColumn("kind", F.lit("filler"))
    # what breaks off into a known message; one word is too little to tell
    open_ = g.join(small(whole.select("h")), "h", "left_anti")
    ends = whole.where("words >= 2").select(F.col("h").alias("t"), "kind")
    lengths = [r[0] for r in whole.where("words >= 2").select("words").distinct().collect()]  # lengths, not messages
    w = open_.where("example like '% %'").select("h", F.split("example", " ").alias("w"))
    w = w.select("h", "w", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n < F.size("w"))).alias("n"))
    tails = w.select("h", F.xxhash64(F.array_join(F.slice("w", -F.col("n"), F.col("n")), " ")).alias("t"))
    broken = tails.join(small(ends), "t").select("h", "kind")
    own_use = whole.select("h", "kind", (F.col("kind") == "recurring").alias("used"))
    return own_use.unionByName(marks.unionByName(latin).unionByName(broken).withColumn("used", F.lit(False))).distinct()


def residue(docs: DataFrame, doc_id: str, text: str, source: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, kinds (sorted array), n_messages: documents with leftovers of templates, filler, error pages or demands for scripts.

    Null and blank texts, and rows without an id, are no residue. Rows of the same id are one document. The texts are
    read twice, once to form the groups and once to find their documents; only hashes travel the second time.
    """
    found = cut(judged(cut(groups(messages(docs, doc_id, text, source))), rules))
    hit = cut(messages(docs, doc_id, text, source).select("_doc", "_src", F.xxhash64("message").alias("h"), "k", "copy").join(small(found), "h"))
    # copies of one document are no use by several: judged again over different texts
    per = hit.where("used").groupBy("h", "copy", "_src").agg(F.max("k").alias("k")).groupBy("h", "copy").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("s"))
    per = per.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("k") <= SHORT).alias("n_short"), F.max("s").alias("s"))
    kept = per.withColumn("n_sources", F.greatest("n_docs", "s")).where(by_use()).select("h", F.lit(True).alias("kept"))
    real = hit.join(small(cut(kept)), "h", "left").where("kept or not used")
    return real.groupBy(F.col("_doc").alias(doc_id)).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.countDistinct("h").alias("n_messages"))


def recurring(docs: DataFrame, doc_id: str, text: str, source: str, sources: int = 5) -> DataFrame:
    """Masked messages that recur in at least ``sources`` sources: example, n_docs, n_sources, kinds (null: no residue)."""
    m = messages(docs, doc_id, text, source)
    kinds = judged(cut(groups(m))).groupBy("h").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    per = m.groupBy("message", "_src").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("message").alias("example")).agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"))
    wide = per.where(F.col("n_sources") >= sources).withColumn("h", F.xxhash64("example"))
    return wide.join(kinds, "h", "left").select("example", "n_docs", "n_sources", "kinds")
