"""The operators for language-model data against brute force and public libraries."""

import base64
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from vintagraph.llm import answers, leaks, neighbours, residue, splitting, tokens

DATA = "/root/testdata/sf0.001"


# splitting
def test_split_covers_and_fits():
    r = random.Random(4)
    texts = ["", None, " \t\r\n", "a" * 800, "a" * 801, "가" * 5000, "word " * 4000, "\n\n".join("Sentence here. And more! " * r.randrange(1, 60) for _ in range(40)), "é" * 2000, "\U0001f469‍\U0001f4bb" * 900]
    for t in texts:
        p = splitting.split(t)
        body = (t or "").strip(splitting.BLANKS)
        assert "".join(t[o:e] for _, o, e in p) == body
        assert all(e - s <= 800 for s, _, e in p) and (len(p) > 1) == (len(body) > 800)
        assert all(b[1] - b[0] > 0 for b in p[1:])  # each shares something with the one before


def test_split_prefers_strong_boundaries():
    t = "x " * 340 + "\n\n" + "y " * 340
    (_, _, end), (_, own, _) = splitting.split(t)
    assert end == own == t.index("y")
    words = splitting.split("abcdefghi " * 300)
    assert all(("abcdefghi " * 300)[o - 1] == " " and ("abcdefghi " * 300)[s - 1] == " " for s, o, _ in words[1:])


def test_pieces(spark):
    df = spark.createDataFrame([(1, "b " * 900, None, "z"), (2, None, 3, "z"), (3, "", 3, "z"), (4, "short", -1, "z"), (4, "short", -1, "z")], "id bigint, content string, page_number int, piece string")
    got = splitting.pieces(df, "id", "content", ["page_number"])
    n = {(r.id, r.n_pieces, r.page_number) for r in got.collect()}
    assert {x[0] for x in n} == {1, 4} and (4, 1, -1) in n
    assert splitting.pieces(df.limit(0), "id", "content", []).count() == 0


# tokens
@pytest.fixture(scope="module")
def ranks():
    return tokens.load()


def test_encoding_equals_the_library(ranks):
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    texts = [None, "", " ", "Hello world's  test 123", "정수장의 탁도 기준은 0.5 NTU입니다.", "<|endoftext|>", "a" * 3000, "\n\n\t x", "é́ \U0001f600‍ﾟ"]
    texts += ["".join(chr(r.choice([32, 10, 39, *range(48, 58), *range(97, 123), *range(0xAC00, 0xAC40), 0x1F600, 0x301])) for _ in range(r.randrange(200))) for _ in range(300)]
    enc = tokens.Encoder(ranks)
    for t in texts:
        ids = enc.encode(t).tolist()
        assert ids == (ref.encode_ordinary(t) if t else [])
        assert tokens.decode(ids, ranks) == (t or "")


def test_vocabulary_file_is_read_as_published():
    with open(tokens.VOCABULARY, "rb") as f:
        first = f.readline().split()
    assert tokens.load()[base64.b64decode(first[0])] == int(first[1])


def test_encode_column(spark, ranks):
    df = spark.createDataFrame([(1, "ab ab", "x"), (2, None, "x"), (3, "", "x"), (1, "ab ab", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_column(spark, df, "doc_id", "text").collect())
    ab = tokens.Encoder(ranks).encode("ab ab").tolist()
    assert got == [(1, ab), (1, ab), (2, []), (3, [])]
    assert tokens.encode_column(spark, df.limit(0), "doc_id", "text").count() == 0


# leaks
def brute_cover(doc, item):
    w, v = leaks.words(doc), leaks.words(item)
    grams = {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
    got = {p + j for p in range(len(v) - 5) if tuple(v[p : p + 6]) in grams for j in range(6)}
    return len(got) / len(v) if v else 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_WORDS", 200)
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 30)))) for i in range(30)]
    docs = []
    for i in range(120):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(40)))]
        if i % 3 == 0:
            t = r.choice(items)[1].split()
            a = r.randrange(max(1, len(t) - 5))
            parts.insert(r.randrange(2), ",  ".join(t[a : a + r.randrange(4, 30)]).upper())
        docs.append((i, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "w1 " * 50_000), (903, docs[0][1])]
    d = spark.createDataFrame([(*x, 0.5) for x in docs], "doc_id bigint, text string, covered double").repartition(3)
    t = spark.createDataFrame([*items, (77, None), (78, ""), items[0]], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.covered for x in leaks.leaked(spark, d, "doc_id", "text", t, "item_id", "text").collect()}
    want = {(i, j): c for i, a in docs for j, b in items if a and (c := brute_cover(a, b)) > 0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 40)  # many blocks of test texts give the same
    assert {(x.doc_id, x.item_id) for x in leaks.leaked(spark, d, "doc_id", "text", t, "item_id", "text").collect()} == want.keys()
    assert leaks.leaked(spark, d, "doc_id", "text", t.limit(0), "item_id", "text").count() == 0


def test_longest_stretch(spark):
    d = spark.createDataFrame([(1, "a b one two three four five six seven c")], "doc_id bigint, text string")
    t = spark.createDataFrame([(5, "zero one two three four five six seven eight")], "item_id bigint, text string")
    r = leaks.leaked(spark, d, "doc_id", "text", t, "item_id", "text").first()
    assert (r.longest, r.longest_at) == (7, 2) and r.covered == pytest.approx(7 / 9)


# neighbours
def exact(v, k):
    keys = [i for i, x in v if x is not None and len(x) == 8 and np.isfinite(x).all() and any(x)]
    m = np.array([x for i, x in v if i in set(keys)], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    return {i: [keys[j] for j in np.lexsort((keys, -s[n])) if j != n][:k] for n, i in enumerate(keys)}


def test_neighbours_are_exact_with_all_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEMBERS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    monkeypatch.setattr(neighbours, "COLUMNS", 4)
    rng = np.random.default_rng(0)
    v = [(int(i), [float(a) for a in x]) for i, x in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    v += [(1000 + i, v[0][1]) for i in range(100)]  # a third are copies
    v += [(5000, None), (5001, [0.0] * 8), (5002, [1.0]), (5003, [float("nan")] * 8), (5004, [])]
    df = spark.createDataFrame([(*x, "g") for x in v], "id bigint, embedding array<float>, ids string")
    got: dict = {}
    for r in neighbours.nearest(spark, df, "id", "embedding", k=5, dims=8).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got == exact(v, 5)
    assert neighbours.nearest(spark, df.limit(0), "id", "embedding", dims=8).count() == 0
    assert neighbours.nearest(spark, df.where("id in (1, 2)"), "id", "embedding", dims=8).count() == 2


def test_neighbours_recall_with_few_lists(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(40, 8)) * 2
    v = [(int(i), [float(a) for a in (c[i % 40] + rng.normal(size=8)).astype(np.float32)]) for i in range(3000)]
    df = spark.createDataFrame(v, "id bigint, embedding array<float>")
    want, hit = exact(v, 5), 0
    for r in neighbours.nearest(spark, df, "id", "embedding", k=5, dims=8, probes=12).collect():
        hit += r.other in want[r.id]
    assert hit / (5 * len(want)) >= 0.9


def test_two_levels_of_centres_and_a_query_set(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FLAT", 8)
    rng = np.random.default_rng(4)
    c = rng.normal(size=(30, 8)) * 2
    v = [(int(i), [float(a) for a in (c[i % 30] + rng.normal(size=8)).astype(np.float32)]) for i in range(2000)]
    df = spark.createDataFrame(v, "id bigint, embedding array<float>")
    want, hit, n = exact(v, 5), 0, 0
    for r in neighbours.nearest(spark, df, "id", "embedding", k=5, dims=8, probes=12, asked=F.col("id") % 10 == 0).collect():
        assert r.id % 10 == 0
        n, hit = n + 1, hit + (r.other in want[r.id])
    assert n == 5 * 200 and hit / n >= 0.9


# answers
def test_defects(spark):
    ko, en = "가온 정수장의 탁도 기준은 얼마인가요?", "What is the limit for turbidity at Pellam?"
    good = [(i, en, f"The limit for turbidity at Pellam is {i}.5 NTU.", "1.5 NTU") for i in range(10, 30)]
    good += [(i, ko, f"가온 정수장의 탁도 기준은 {i}.5 NTU 이하입니다.", "2.5 NTU") for i in range(30, 50)]
    bad = [(1, en, None, " "), (2, en, "N/A", "​"), (3, en, en, en.upper().replace(" ", "  ")), (4, ko, "The limit at Pellam is 3 NTU.", "基準値は5以下です。"), (5, en, "I'm sorry, but I can't help with that.", "죄송합니다. 답변을 드릴 수 없습니다."), (6, en, "The limit for turb", "The limit for turbidity at Pellam is 3.5 NTU"), (7, ko, "가온 정수장의 탁도 기", "12건"), (8, ko, "", "(답변 없음)")]
    df = spark.createDataFrame([(*x, None, "d") for x in good + bad + bad[:2]] + [(None, en, "x", "y", None, "d")], "qa_id bigint, question string, expected string, generated string, topic string, defect string")
    got = {(r.qa_id, r.field): r.defect for r in answers.defects(df, "qa_id", "question", ["expected", "generated"]).collect()}
    assert got == {(1, "expected"): "empty", (1, "generated"): "empty", (2, "expected"): "empty", (2, "generated"): "empty", (3, "expected"): "copy", (3, "generated"): "copy", (4, "expected"): "language", (4, "generated"): "language", (5, "expected"): "refusal", (5, "generated"): "language", (6, "expected"): "truncated", (7, "expected"): "truncated", (8, "expected"): "empty", (8, "generated"): "empty"}
    assert answers.defects(df.limit(0), "qa_id", "question", ["expected"]).count() == 0


def test_templates_refuse_without_phrases(spark, monkeypatch):
    r = random.Random(9)
    asked = [("What is the limit for {} at {}?", "The limit for {} at {} is {} NTU."), ("How often is {} checked at {}?", "At {1} the {0} is checked every {2} days."), ("Which section rules {} near {}?", "Section {2} rules the {0} near {1}."), ("Does {} matter at {}?", "Yes, {} at {} matters for {} sites.")]
    things, places = ["turbidity", "chlorine", "sludge volume", "inflow rate"], ["Pellam", "Dunnow Reach", "Fennick", "Wyncote"]
    heads, bodies = ["", "Well now, ", "Let me see, ", "By my lights "], ["this goes past what was handed over to me", "the papers hold no word about such matters"]
    rows, want = [], set()
    for i in range(400):
        q, a = r.choice(asked)
        x, y = r.choice(things), r.choice(places)
        odd = i % 5 == 0
        rows.append((i, q.format(x, y), r.choice(heads) + r.choice(bodies) + "." if odd else a.format(x, y, i) + (" Details are in the files." if i % 3 == 0 else "")))
        want |= {i} if odd else set()
    rows.append((900, "How often is inflow rate checked at Pellam?", "Let me see, the papers hold no word about such matters. Details are in the files."))
    df = spark.createDataFrame(rows, "id bigint, question string, a string")
    cut = answers.long_form(df, "id", "question", ["a"])
    found = lambda: {x.id for x in answers.refusals(cut, []).collect()}
    assert found() == {*want, 900}
    monkeypatch.setattr(answers, "FRAMES", 10**6)  # no cluster is ever free of its prompt
    assert found() == set()


def test_clusters_are_verified(spark):
    base = "this answer is not available in the given documents at the moment"
    t = spark.createDataFrame([(base,), (base + "!",), ("something else entirely about pumps and valves",), ("a",)], "s string")
    c = {r.s: r.c for r in answers.clusters(t).collect()}
    assert c[base] == c[base + "!"] and len(set(c.values())) == 3


def test_clusters_hold_among_unrelated_texts(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    other = sorted({" ".join(r.choice(words) for _ in range(8)) for _ in range(20_000)})
    base = "zzz we keep to what was agreed and leave this point for others to settle later on"
    chain = [base, base + " ok", base + " ok so", base + " ok so be it then", base + " ok so be it then my friend"]
    c = {x.s: x.c for x in answers.clusters(spark.createDataFrame([(x,) for x in [*other, *chain, base]], "s string")).collect()}
    assert len(c) == len(other) + len(chain) and None not in c.values()
    assert len({c[x] for x in chain}) == 1 and all(c[x] != c[base] for x in other)


def test_clusters_equal_brute_force(spark, monkeypatch):
    r = random.Random(7)
    texts = []
    for _ in range(12):
        t = "".join(r.choice("abcd ") for _ in range(60))
        texts += ["".join(r.choice("abcd ") if r.random() < 0.01 else x for x in t) for _ in range(12)]
    texts = sorted({*texts, "a", "ab", "abcde", "abcdef"})
    grams = {t: {t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts}
    root = {t: t for t in texts}
    for a in texts:
        for b in texts:
            if root[a] != root[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                old, new = root[a], root[b]
                root = {k: new if v == old else v for k, v in root.items()}
    for size in (1000, 5):  # in one go, and in pairs of blocks
        monkeypatch.setattr(answers, "BUCKET", size)
        c = {x.s: x.c for x in answers.clusters(spark.createDataFrame([(x,) for x in texts], "s string")).collect()}
        assert sorted(sorted(t for t in texts if c[t] == k) for k in set(c.values())) == sorted(sorted(t for t in texts if root[t] == k) for k in set(root.values()))
    assert answers.clusters(spark.createDataFrame([], "s string")).count() == 0


# residue
BAD = ["Dear {{name}}, hello.", "값은 ${기관명} 이다.", "As <<unit>> says.", "[INSERT date] was dry.", "Lorem ipsum dolor sit amet.", "Home | About\nError 404: Not Found.", "Traceback (most recent call last):\n  File x", "Please enable JavaScript to run this viewer.", "이 페이지를 보려면 자바스크립트를 사용하도록 설정해야 합니다.", "XXnameXX is here", "__author__ wrote it", "값 %(unit)s 이다", "20XX년 XX월"]
GOOD = ["SCADA 화면에 404 오류가 표시되면 담당자는 통신 단자를 점검한다.", "The dashboard is written in JavaScript and refreshes every 5 seconds.", '설정 예: {"pump": 3, "limit": 0.25} 형태로 저장한다.', "수식 a<b 와 b>c 를 함께 만족한다.", "[표 3] 및 [주 1]은 자료이다.", "A template for shift reports was approved.", "", None, "   ", "word " * 20_000]


def test_residue(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(BAD)] + [(100 + i, t, None) for i, t in enumerate(GOOD)] + [(0, BAD[0], "s1"), (None, BAD[0], "s1")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id bigint, text string, source string, kind string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", "source").collect()}
    assert got == set(range(len(BAD)))
    assert residue.residue(df.limit(0), "doc_id", "text", "source").count() == 0


def test_masking(spark):
    m = spark.createDataFrame([("See https://a.b/c on 2024-01-02, 3.5 or 7 to a@b.cd, @@unit@@",)], "t string")
    assert m.select(residue.masked(m.t)).first()[0] == "See # on #, # or # to #, @@unit@@"


def corpus():
    """Ordinary documents of many sentences, and some of few."""
    r = random.Random(3)
    words = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    said = [" ".join(r.choice(words) for _ in range(6)).capitalize() + "." for _ in range(80)]
    return [(i, " ".join(r.choice(said) for _ in range(3 if i % 12 == 0 else r.randrange(8, 20))), f"s{i % 7}") for i in range(300)]


def test_use_decides_without_phrases(spark, monkeypatch):
    docs = corpus()
    docs += [(1000 + i, f"Zarp node {i} does not stand by.", f"s{i % 4}") for i in range(12)]
    docs += [(1100, "Blim dorra kela suno pid Zarp node 9 does not stand by.", "s1")]  # broken off
    docs += [(1200 + i, "A short finished note. It came once. It was passed on.", f"s{i % 5}") for i in range(20)]  # copies of one text
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    found = lambda: {r.doc_id for r in residue.residue(df, "doc_id", "text", "source", rules={}).collect()}
    assert found() == {*range(1000, 1012), 1100}
    monkeypatch.setattr(residue, "DEVIATIONS", 1e6)  # no group is ever sure of its use
    assert found() == set()


def test_loose_forms_need_other_sources(spark):
    df = spark.createDataFrame([(1, "Take <amount> from it.", "a"), (2, "Take «amount» from it.", "a"), (3, "Give «unit» to me.", "b"), (4, "For {{unit}} now.", "a")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in residue.residue(df, "doc_id", "text", "source").collect()} == {2, 3, 4}


def test_dummy_words_are_learned(spark):
    r = random.Random(5)
    latin = ["Lorem", "ipsum", "vargo", "pendit", "sulla", "mortu", "ravo"]
    docs = corpus() + [(2000 + i, " ".join(r.choice(latin) for _ in range(12)) + ".", "s0") for i in range(40)] + [(2100, "Corba. Vargo pendit sulla mortu ravo.", "s3")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = {x.doc_id for x in residue.residue(df, "doc_id", "text", "source", rules={}).collect()}
    assert 2100 in got and {d[0] for d in docs if 2000 <= d[0] < 2100} <= got and min(got) >= 2000
