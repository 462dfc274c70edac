"""Broken prompt and response pairs (problem 6).

Each answer gets at most one defect, by these checks in order: empty, copy of the question, other language than the
question, refusal, truncated.

Refusals: sentences that don't repeat their own prompt are masked and clustered: components of the links of Jaccard
at least 0.8 (character 5-grams), all of them found by prefix filtering. A cluster that recurs under several question
frames is free of the prompt; one whose answers hold nothing that depends on the prompt is a template that refuses. Its
word pairs teach how refusals are put together, so that an opening in a rare combination is known too. An answer
refuses if nothing in it depends on its prompt and it has a sentence of a template, or one made of their pairs. Where too
few answers recur to tell, phrases that decline stand in.

Truncation: how the corpus itself begins and ends its sentences. An unterminated answer breaks off only if finished
sentences begin as its last one does (a short answer in note form does not). For the last words of an unterminated answer it is counted how
often they end an answer or sentence and how often the text goes on after them, or after a longer word that they
begin; what usually goes on is broken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagraph.session import cut, small

#: Notes that stand for no answer, without marks and blanks.
NOTES = ["na", "null", "none", "nil", "nan", "noanswer", "noresponse", "noreply", "unanswered", "empty", "blank", "notavailable", "답변없음", "내용없음", "응답없음", "답없음", "해당없음", "없음", "무응답", "미응답", "미입력", "정답없음", "자료없음"]
#: Labels that may surround a question that is given back.
LABELS = ["q", "a", "question", "answer", "질문", "답변", "답", "문의", "질의", "응답"]
#: Common words of the languages in Latin letters.
WORDS = {
    "en": "the of and is are was were at for by to with on from before after which what how that this be it as has have an not must can will or when if there in a every always than".split(),
    "es": "el la los las del de un una en se con por para es y que al lo su sus cada luego tras son está hace más no".split(),
    "fr": "le la les des du de un une est et pour dans en au aux que qui sur par avec tous toutes puis doit être avant après il se on a ce cette".split(),
    "de": "der die das den dem des und ist sind mit für ein eine nach durch um wurden wird werden im in alle zu auf von danach gilt nicht spätestens am bei".split(),
}
#: Phrases that decline in general terms (case disregarded), in English and Korean.
DECLINES = [
    r"^(?:i'?m sorry|i am sorry|sorry|regrettably|unfortunately|as an (?:ai|assistant)\b)",
    r"\bi (?:can'?t|cannot|can not|am unable|am not able|must decline|have to decline|won'?t|don'?t have (?:enough|sufficient))\b",
    r"\bnothing in the (?:provided|given|supplied) (?:documents?|context|sources?)\b",
    r"^(?:죄송|안타깝게도|유감스럽게도|ai (?:도우미|모델|어시스턴트))",
    r"답변을? ?(?:을|를)? ?드릴 수 없",
    r"(?:찾지|확인하지|알지) 못(?:했|합)",
    r"(?:응답|답변)을 (?:보류|거절|사양)",
    r"(?:정보|근거|자료)가 (?:부족|없)",
    r"(?:드리기|하기) 어렵습니다",
]
#: Question frames under which a sentence recurs if it is independent of the prompt; occurrences, and the share of
#: answers that say nothing else, from which such a sentence refuses.
FRAMES, OFTEN, ALONE = 3, 5, 0.8
#: Share of a sentence's character 4-grams in its question from which it depends on the prompt, and share of a
#: sentence's word pairs from which it is made of templates.
ECHO, MADE = 0.25, 0.8
JACCARD, GRAM = 0.8, 5
#: Texts of a bucket, or of half a pair of blocks, that are compared in one go.
BUCKET = 1000


def bare(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def tidy(c: Column) -> Column:
    """Blanks collapsed, zero-width and control characters out."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0e-\x1f\x7f​‌‍⁠﻿]", ""), r"(?U)\s+", " "))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def long_form(pairs: DataFrame, id_: str, question: str, fields: list[str]) -> DataFrame:
    """id, field, q, a: one row per answer; repeated ids count once (the greatest texts), rows without an id don't."""
    texts = F.max(F.struct(question, *[f for f in fields if f != question])).alias("_t")
    p = pairs.where(F.col(id_).isNotNull()).groupBy(id_).agg(texts).select(id_, "_t.*")
    answers = F.explode_outer(F.array(*[F.struct(F.lit(f).alias("field"), tidy(F.col(f)).alias("a")) for f in fields])).alias("_x")
    return p.select(F.col(id_).alias("id"), tidy(F.col(question)).alias("q"), answers).select("id", "q", "_x.field", "_x.a")


def _foreign(q: Column, a: Column) -> Column:
    hangul, latin, other = r"[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]", r"[A-Za-z\x{C0}-\x{24F}]", r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{400}-\x{4FF}\x{600}-\x{6FF}\x{E00}-\x{E7F}]"
    letters = lambda c: (_count(c, hangul), _count(c, latin), _count(c, other))
    qh, ql, _ = letters(q)
    h, lat, o = letters(a)
    words = F.split(F.lower(F.regexp_replace(a, r"[^\p{L}' ]+", " ")), " +")
    of = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    hits = {k: of(v) for k, v in WORDS.items()}
    accents = _count(a, r"[\x{C0}-\x{24F}]")
    most = F.greatest(*[hits[k] for k in hits if k != "en"])
    korean = qh > ql
    long_latin = F.size(F.filter(words, lambda w: F.length(w) >= 2)) >= 3
    to_korean = (o > h) | ((h * 4 < lat) & long_latin)
    to_english = (o > lat) | ((h > lat) & (h >= 4)) | ((most >= 2) & (most + accents > hits["en"])) | ((accents >= 2) & (most > hits["en"]))
    return F.when(korean, to_korean).otherwise(to_english)


def simple_defects(rows: DataFrame) -> DataFrame:
    """``rows`` with ``defect``: empty, copy or language, null otherwise."""
    a, q = bare(F.col("a")), bare(F.col("q"))
    rest = F.regexp_replace(F.replace(a, q, F.lit(" ")), " +", " ")
    gives_back = (F.length(q) >= 4) & F.contains(a, q) & (F.forall(F.split(F.trim(rest), " "), lambda w: (w == "") | w.isin(LABELS)))
    part = (F.length(q) >= 8) & (F.length(a) >= 0.8 * F.length(q)) & F.contains(q, a)
    kind = F.when((a == "") | a.isin(NOTES), "empty").when(gives_back | part, "copy").when(_foreign(F.col("q"), F.col("a")), "language")
    return rows.withColumn("defect", kind)


def _grams4(c: Column) -> Column:
    """All runs of four characters; a shorter text is its own."""
    return F.when(F.length(c) > 4, F.regexp_extract_all(c, F.lit("(?=(.{4}))"), F.lit(1))).otherwise(F.array(c))


def sentences(rows: DataFrame) -> DataFrame:
    """id, field, frame, s (masked sentence), echo: one row per sentence of each answer.

    ``echo``: the sentence repeats its question, by the share of its character 4-grams (letters and digits) found there.
    """
    hangul = F.col("q").rlike(r"[\x{AC00}-\x{D7A3}]")
    w = F.split(F.regexp_replace(F.lower("q"), r"\d+", "#"), " ")
    frame = F.when(hangul, F.element_at(w, -1)).otherwise(F.concat_ws(" ", F.slice(w, 1, 2)))
    s = F.lower(F.regexp_replace(F.col("a"), r"\d+(?:[.,]\d+)*", "#"))
    parts = F.transform(F.split(s, r"(?<=[.!?。])\s+"), lambda x: F.rtrim(F.regexp_replace(x, r"[.!?。]+$", "")))
    asked = _grams4(bare(F.regexp_replace("q", r"\d+", "")))
    each = rows.select("id", "field", frame.alias("frame"), asked.alias("_q"), parts.alias("_s")).select("*", F.explode_outer("_s").alias("s")).where("s <> ''")
    own = _grams4(bare(F.col("s")))
    share = F.size(F.array_intersect(own, F.col("_q"))) / F.size(F.array_distinct(own))
    return each.select("id", "field", "frame", "s", ((F.length(bare(F.col("s"))) > 4) & (share >= ECHO)).alias("echo"))


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """i, j: links that join all alike members of a bucket. A text once linked is not compared with its like again."""
    for batch in batches:
        out = []
        for members in batch["m"]:
            ids, sizes = [m["i"] for m in members], np.array([len(m["g"]) for m in members])
            starts = np.r_[0, np.cumsum(sizes)]
            words, flat = np.unique(np.concatenate([np.asarray(m["g"]) for m in members]), return_inverse=True)
            seen, left = np.zeros(len(words), dtype=np.int32), np.ones(len(ids), dtype=bool)
            while left.any():
                todo = [int(np.argmax(left))]
                left[todo] = False
                while todo and left.any():
                    x = todo.pop()
                    own = flat[starts[x] : starts[x + 1]]
                    seen[own] = 1
                    both = np.add.reduceat(seen[flat], starts[:-1])
                    seen[own] = 0
                    hits = np.flatnonzero(left & (both >= JACCARD * (sizes[x] + sizes - both)))
                    out += [(ids[x], ids[y]) for y in hits]
                    left[hits] = False
                    todo += hits.tolist()
        if out:
            yield pd.DataFrame(out, columns=["i", "j"])


def components(links: DataFrame) -> DataFrame:
    """i, c: the smallest id that each id of ``links`` (i, j) is connected with."""
    e = cut(links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    lab = cut(e.groupBy("i").agg(F.least("i", F.min("j")).alias("c")))
    while True:
        near = e.join(lab.select(F.col("i").alias("j"), F.col("c").alias("n")), "j").groupBy("i").agg(F.min("n").alias("n"))
        low = cut(lab.join(near, "i").select("i", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        if low.where("moved").isEmpty():
            return low.select("i", "c")
        # the label's own label is at least as small
        lab = cut(low.select("i", "c").join(low.select(F.col("i").alias("c"), F.col("c").alias("n")), "c").select("i", F.col("n").alias("c")))


def clusters(texts: DataFrame) -> DataFrame:
    """s, c: the distinct ``s`` of ``texts`` with their cluster, a text of it; a text like no other is its own cluster.

    Exact: texts of Jaccard at least JACCARD share one of their rarest grams, as many as may differ and one more. These
    are the buckets; all pairs of a bucket count, big ones in pairs of blocks of about BUCKET texts.
    """
    n = F.length("s")
    grams = F.when(n > GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.xxhash64(F.col("s").substr(i, F.lit(GRAM)))))).otherwise(F.array(F.xxhash64("s")))
    t = cut(texts.select("s").distinct().withColumn("g", grams).withColumn("i", F.monotonically_increasing_id()))
    each = t.select("i", F.explode_outer("g").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    order = each.join(often, "x").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("o"))
    rare = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.size("o") * F.lit(JACCARD) - 1e-9).cast("int") + 1)
    keys = cut(order.select("i", F.explode(rare).alias("_o")).select("i", "_o.x", "_o.n").where("n > 1").drop("n"))
    sizes = keys.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", F.ceil(F.col("n") / BUCKET).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("i", "x"), F.col("k")).cast("int")
    at = keys.join(sizes, "x").withColumn("b", own)
    others = F.when(F.col("k") == 1, F.array("b")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("b")))
    at = at.withColumn("o", F.explode(others)).select("i", "x", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    buckets = at.join(t.select("i", "g"), "i").groupBy("x", "lo", "hi").agg(F.collect_list(F.struct("i", "g")).alias("m")).where("size(m) > 1").select("m")
    found = components(cut(buckets.mapInPandas(_links, "i bigint, j bigint")))
    root = t.select("i", "s").join(found, "i", "left").select("s", F.coalesce("c", "i").alias("i"))
    return root.join(t.select("i", F.col("s").alias("c")), "i").select("s", "c")


def word_pairs(s: Column) -> Column:
    """The pairs of successive words of a sentence, its start and end included."""
    w = F.split(s, " ")
    return F.array_distinct(F.zip_with(F.concat(F.array(F.lit("^")), w), F.concat(w, F.array(F.lit("$"))), lambda a, b: F.xxhash64(a, b)))


def refusals(rows: DataFrame, declines: list[str] | None = None) -> DataFrame:
    """id, field of the refusing answers among ``rows``; ``declines``: phrases beside the clusters (default DECLINES)."""
    phrases = DECLINES if declines is None else declines
    says = reduce(lambda a, b: a | b, [F.col("s").rlike(r) for r in phrases], F.lit(False))
    s = cut(sentences(rows).withColumn("declines", says & ~F.col("echo")))
    apart = s.where("not echo")
    member = cut(clusters(apart))
    sc = cut(apart.join(small(member), "s"))
    frames = sc.groupBy("c", "frame").agg(F.count(F.lit(1)).alias("n")).groupBy("c").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("n"))
    free = small(cut(frames.where(F.col("frames") >= FRAMES).select("c")))
    tagged = sc.join(free.withColumn("free", F.lit(True)), "c", "left").withColumn("free", F.coalesce("free", F.lit(False)))
    echoes = s.where("echo").select("id", "field").distinct().withColumn("bound", F.lit(True))
    # a cluster whose answers nearly always hold nothing that depends on the prompt refuses, whatever its words
    per = tagged.groupBy("id", "field").agg(F.max(~F.col("free") & ~F.col("declines")).alias("_b")).join(echoes, ["id", "field"], "left")
    per = per.select("id", "field", (F.col("_b") | F.coalesce("bound", F.lit(False))).alias("bound"))
    alone = tagged.where("free").join(per, ["id", "field"]).groupBy("c").agg(F.avg((~F.col("bound")).cast("int")).alias("alone"), F.count(F.lit(1)).alias("n"))
    templates = small(cut(alone.where((F.col("alone") >= ALONE) & (F.col("n") >= OFTEN)).select("c", F.lit(True).alias("template"))))
    # sentences in rare combinations, by the pairs of the templates
    known = member.join(templates, "c").select(F.explode(word_pairs(F.col("s"))).alias("x")).distinct()
    rare = tagged.where("not free").select("s").distinct().withColumn("_p", word_pairs(F.col("s")))
    rare = rare.select("s", F.size("_p").alias("n"), F.explode("_p").alias("x")).join(small(cut(known)), "x", "left_semi").groupBy("s", "n").agg(F.count(F.lit(1)).alias("k"))
    made = rare.where(F.col("k") >= MADE * F.col("n")).select("s", F.lit(True).alias("made"))
    judged = tagged.join(small(cut(made)), "s", "left").join(templates, "c", "left")
    refuses = F.coalesce("template", "made", F.lit(False)) | F.col("declines")
    verdict = judged.groupBy("id", "field").agg(F.max(refuses).alias("refuses"), F.max(~F.col("free") & ~refuses).alias("bound"))
    return verdict.where("refuses and not bound").select("id", "field").join(echoes, ["id", "field"], "left_anti")


#: Words of an unterminated sentence up to which it is compared as a whole with how finished ones begin.
SHORT = 4
#: Marks that end a sentence, with closing quotes and brackets after them.
_ENDED = r"[.!?。！？][\"'”’)\]]*$"
_OPEN = r"[,;:·、/(\[{~\-–—]$|…$|\.\.\.$"


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The lengths that the texts of a column have: as many numbers as the longest has characters, at most."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect())


def truncated(rows: DataFrame) -> DataFrame:
    """id, field of the answers among ``rows`` that break off inside a sentence."""
    masked = F.regexp_replace(F.col("a"), r"\d+(?:[.,]\d+)*", "#")
    r = cut(rows.select("id", "field", F.split(masked, " ").alias("w"), F.col("a").rlike(_ENDED).alias("ended"), F.col("a").rlike(_OPEN).alias("open")))
    # context of a word: the two words before it in its sentence
    plain = lambda x: F.regexp_replace(x, r"[.!?。！？,;:\"'”’)\]]+$", "")
    stop = lambda x: x.rlike(_ENDED)
    before = lambda i, k: F.when((i - k < 0) | F.exists(F.slice(F.col("w"), F.greatest(i - k + 1, F.lit(1)), F.least(F.lit(k), i)), stop), F.lit("^")).otherwise(F.get("w", i - k))
    at = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - 1)))
    words = at.select("id", "field", "ended", "open", plain(F.get("w", F.col("i"))).alias("x"), before(F.col("i"), 1).alias("p1"), before(F.col("i"), 2).alias("p2"), (F.col("i") == F.size("w") - 1).alias("last"), stop(F.get("w", F.col("i"))).alias("stop"), F.size("w").alias("n"))
    tails = cut(words.where("last and not ended"))
    stats = words.groupBy("p2", "p1", "x").agg(F.count_if("stop").alias("t"), F.count_if(F.col("last") & ~F.col("stop")).alias("u"), F.count_if(~F.col("last") & ~F.col("stop")).alias("c"))
    stats = cut(stats)
    wanted = tails.select("p2", "p1", "x").distinct()
    lengths = _lengths(wanted, "x")

    def evidence(context: list[str]) -> DataFrame:
        keys = [*context, "x"]
        own = stats.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("u").alias("u"), F.sum("c").alias("c"))
        grown = own.withColumn("l", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n < F.length("x")))).select(*context, F.col("x").substr(F.lit(1), F.col("l")).alias("x"), (F.col("t") + F.col("u") + F.col("c")).alias("g"))
        grown = grown.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.sum("g").alias("g"))
        return own.join(wanted.select(*keys).distinct(), keys, "left_semi").join(grown, keys, "left").withColumn("on", F.col("c") + F.coalesce("g", F.lit(0))).drop("c", "g")

    three, two = evidence(["p2", "p1"]), evidence(["p1"])
    e = wanted.join(three.withColumnsRenamed({"t": "t3", "u": "u3", "on": "on3"}), ["p2", "p1", "x"]).join(two.withColumnsRenamed({"t": "t2", "u": "u2", "on": "on2"}), ["p1", "x"])
    known3 = (F.col("t3") + F.col("on3") > 0) | (F.col("u3") > 1)
    t, u, on = (F.when(known3, F.col(f"{n}3")).otherwise(F.col(f"{n}2")) for n in ("t", "u", "on"))
    whole = ((t > 0) & (t * 5 >= on)) | ((u > 1) & (u > on))
    unknown = (t + on == 0) & (u <= 1)
    verdict = small(cut(e.select("p2", "p1", "x", whole.alias("whole"), unknown.alias("unknown"))))
    sentence_end = F.col("x").rlike(r"(?:다|요|까|죠|함|임|됨|음)$")
    begun = openings(masked_rows(rows))
    j = tails.join(begun, ["id", "field"]).join(verdict, ["p2", "p1", "x"])
    late = F.when(F.col("unknown"), ~sentence_end).otherwise(~F.col("whole"))
    bad = F.col("open") | F.when(F.col("short"), F.col("begins")).otherwise(F.col("begins") & late)
    return j.where(bad).select("id", "field").unionByName(r.where("ended and open").select("id", "field")).distinct()


def masked_rows(rows: DataFrame) -> DataFrame:
    """id, field, parts (masked sentences with their marks), ended."""
    m = F.regexp_replace(F.col("a"), r"\d+(?:[.,]\d+)*", "#")
    return rows.select("id", "field", F.split(m, r"(?<=[.!?。])\s+").alias("parts"), F.col("a").rlike(_ENDED).alias("ended"))


def openings(rows: DataFrame) -> DataFrame:
    """id, field, short, begins: of each unterminated answer, whether finished sentences begin as its last sentence does.

    A short last sentence must be a proper beginning of a finished one (a number at its end is whole); of a longer one
    the first word must begin one.
    """
    done = rows.select("ended", F.posexplode_outer("parts").alias("i", "s"), F.size("parts").alias("n")).where(F.col("ended") | (F.col("i") < F.col("n") - 1))
    last = rows.where("not ended").select("id", "field", F.element_at("parts", -1).alias("s"))
    last = last.withColumn("short", F.size(F.split("s", " ")) <= SHORT).withColumn("k", F.when(F.col("short"), F.regexp_replace("s", r"[,;:…]+$", "")).otherwise(F.substring_index("s", " ", 1)))
    keys = cut(last.select("k").distinct())
    # a short last sentence has at most SHORT words, so what follows them decides nothing
    head = done.select(F.substring_index(F.col("s"), " ", SHORT + 1).alias("o")).distinct()
    lengths = F.lit(_lengths(keys, "k")).cast("array<int>")
    grown = head.withColumn("l", F.explode(F.filter(lengths, lambda n: n < F.length("o")))).select(F.col("o").substr(F.lit(1), F.col("l")).alias("k"), F.col("o").substr(F.col("l") + 1, F.lit(1)).alias("next"))
    grown = grown.where(~F.endswith("k", F.lit("#")) | (F.col("next") == " ")).select("k").distinct().withColumn("grows", F.lit(True))
    words = done.select(F.substring_index("s", " ", 1).alias("k")).distinct().withColumn("starts", F.lit(True))
    known = keys.join(grown, "k", "left").join(words, "k", "left")
    return last.join(small(cut(known)), "k").select("id", "field", "short", F.coalesce(F.when(F.col("short"), F.col("grows")).otherwise(F.col("starts")), F.lit(False)).alias("begins"))


def defects(pairs: DataFrame, id_: str, question: str, fields: list[str]) -> DataFrame:
    """id_, field, defect: every defective answer, with one defect.

    Null and blank answers are 'empty'; a null or blank question cannot be copied and has no language of its own
    (it counts as Latin). Repeated ids count once.
    """
    rows = cut(simple_defects(long_form(pairs, id_, question, fields)))
    first = rows.where("defect is not null").select("id", "field", "defect")
    rest = rows.where("defect is null").drop("defect")
    no = cut(refusals(rest))
    left = rest.join(no, ["id", "field"], "left_anti")
    cut_off = truncated(left).withColumn("defect", F.lit("truncated"))
    out = first.unionByName(no.withColumn("defect", F.lit("refusal"))).unionByName(cut_off)
    return out.select(F.col("id").alias(id_), "field", "defect")
