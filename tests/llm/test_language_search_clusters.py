"""Language identification, lexical search and clustering against plain loops over small and awkward tables."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import clustering, language_id, lexical_search

SCHEMA = "doc_id long, text string, lang string, source string, rank string, item string, code string, hash string, id string, v string, cluster string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA)


# ---- languages ----------------------------------------------------------------------------------


def language_rows():
    draw = random.Random(4)
    syllables = {"aa": ["ka", "lo", "mi", "tré"], "bb": ["sch", "ung", "ei", "lo"], "cc": ["ção", "nh", "lo", "ei"]}
    word = lambda x: "".join(draw.choices(syllables[x], k=draw.randint(1, 4)))
    rows = []
    for i in range(150):
        lang = "aa" if i % 2 else draw.choice(["bb", "cc"])  # half the rows are of one language
        rows.append((i, " ".join(word(lang).capitalize() for _ in range(draw.randint(1, 30))) + " 12, x!", lang))
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 34 \n ?!", None), (203, "ЖЖЖ", None), (None, "ungsch", "bb"), (5, "schungei ungloei", None), (5, "kalo", "cc"), (5, "kalo", "cc")]
    rows += [(210, "́ ́áb é", None), (211, "lo" * 5000, None), (212, "ungei schlo " * 3000, None), (213, "中文 中", "dd")]
    return rows


def held(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def told_apart(text):
    """Words as runs of letters and marks that hold a letter."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    out, now = [], ""
    for c in low + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c
        else:
            out, now = out + [now] * bool(now), ""
    return [w for w in out if any(unicodedata.category(c)[0] == "L" for c in w)]


def plain_languages(rows, longest=5, sure=12):
    grams = lambda w, n: [x for i in range(len(w) + 3 - n) if (x := f"\0{w}\0"[i : i + n]) != "\0"]
    train = [(t, x) for d, t, x in rows if x is not None and held(d, 3) != 1]
    docs = Counter(x for _, x in train)
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    counts = [{x: Counter() for x in langs} for _ in range(longest + 1)]
    for t, x in train:
        for w in told_apart(t):
            counts[0][x][w] += 1
            for n in range(1, longest + 1):
                counts[n][x].update(grams(w, n))
    totals = [{x: sum(c.values()) for x, c in own.items()} for own in counts]
    penalty = [math.log(0.5 / max(1, *own.values())) for own in totals]

    def value(n, x, key):
        c = counts[n][x][key]
        return np.float32(math.log(c / totals[n][x])) if c else np.float32(penalty[n])

    def word(w):
        if any(counts[0][x][w] for x in langs):
            return [float(value(0, x, w)) for x in langs]
        for n in range(longest, 0, -1):
            known = [g for g in grams(w, n) if any(counts[n][x][g] for x in langs)]
            if known:
                return [sum(float(value(n, x, g)) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    out = []
    for d, t, _ in rows:
        words = told_apart(t)
        if not words:
            out.append((d, "und", 0.0))
            continue
        mean = [round(sum(col) / len(words), 9) for col in zip(*map(word, words), strict=True)]
        best = max(mean)
        out.append((d, langs[mean.index(best)], round(1 / sum(math.exp((m - best) * min(len(words), sure)) for m in mean), 6)))
    return out


def test_languages_are_those_of_a_plain_loop(spark):
    rows = language_rows()
    got = language_id.identify_languages(documents(spark, [(*r, "s") for r in rows]).repartition(5)).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got) == Counter(plain_languages(rows))
    assert all(r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[202].lang_pred == "und" and by[200].score == 0
    assert by[203].lang_pred == "aa" and by[203].score == pytest.approx(1 / len({r[2] for r in rows if r[2] and held(r[0], 3) != 1}))  # nothing is known: the commonest


def test_a_model_of_bounded_size_still_tells_languages(spark):
    rows = language_rows()
    docs = documents(spark, [(*r, "s") for r in rows])
    s = language_id.Settings(words=8, grams=12, longest=3)
    model = language_id.learn_languages(docs, s)
    assert len(model.tables[0].hash) <= 8 and all(len(t.hash) <= 12 for t in model.tables[1:]) and len(model.tables[0].hash)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(docs, s=s).collect()}
    right = [(d, x) in got for d, t, x in rows[:150] if len(told_apart(t)) > 4]
    assert sum(right) > 0.95 * len(right)


def test_languages_of_empty_tables_and_without_labels(spark):
    docs = documents(spark, [(1, "abc", None, "s"), (2, None, None, "s")])
    assert [(r.lang_pred, r.score) for r in language_id.identify_languages(docs).collect()] == [("und", 0), ("und", 0)]
    assert language_id.identify_languages(docs.limit(0)).count() == 0


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = docs.select("doc_id", "lang")
    got = language_id.identify_languages(docs).where("held_out").join(lang, "doc_id").selectExpr("count(*) as n", "count_if(lang = lang_pred) as hits").first()
    assert got.n > 250 and got.hits >= 0.97 * got.n


# ---- search -------------------------------------------------------------------------------------


def search_rows():
    draw = random.Random(6)
    words = ["the", "Of", "délta", "中文", "x1", "K", "İst", "ſ", "alpha", "beta", "gamma-ray", "tau's", "\xa0pi", "rho", "sigma"]
    prose = lambda n: " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=n))
    rows = [(i, prose(draw.randint(1, 60))) for i in range(120)]
    rows += [(500 + i, "alpha beta the") for i in range(30)]  # ties
    rows += [(None, "alpha beta the"), (3, "alpha beta the"), (3, "alpha beta the"), (600, None), (601, ""), (602, " .,; "), (603, prose(20_000)), (604, "zeta " * 10_000)]
    items = [(1, "Alpha beta, alpha THE"), (2, "délta 中文 İst"), (3, None), (4, "..."), (5, "nowhere"), (6, " ".join(words)), (None, "rho"), (8, "sigma"), (8, "pi K"), (9, "zeta")]
    return rows, items


def plain_search(rows, items, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    find = lambda t: re.findall(lexical_search.TERM, (t or "").translate(low))
    docs = [(d, Counter(w)) for d, t in rows if (w := find(t))]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(find(t))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("s", [lexical_search.Settings(), lexical_search.Settings(wide=3, docs=7, items=2, entries=12)])
def test_search_ranks_as_a_plain_loop(spark, s):
    rows, items = search_rows()
    docs = documents(spark, [(*r, "en", "s") for r in rows]).repartition(6)
    asked = spark.createDataFrame([(*i, "x", "y", "z") for i in items], "item_id long, text string, doc_id string, rank string, term string")
    got = lexical_search.search(docs, asked, s)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_search(rows, items)


def test_search_of_empty_tables(spark):
    rows, items = search_rows()
    docs = documents(spark, [(*r, "en", "s") for r in rows])
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(docs.limit(0), asked).count() == 0
    assert lexical_search.search(docs, asked.limit(0)).count() == 0


def test_sums_of_products_stay_exact():
    weights = np.array([20_000] * 500_000)
    cuts = lexical_search.spans(weights, 1 << 30)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(weights) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert len(cuts) > 1 and all(int(weights[a:b].sum()) * lexical_search.IMPACT < lexical_search.EXACT for a, b in cuts)


# ---- clusters -----------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own: dict = {}
        for _, v in kept:
            own.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(c) // len(own[j]) for c in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found)


def vector_rows():
    draw = random.Random(9)
    rows = [(i, [draw.gauss(i % 5 - 2, 0.3) for _ in range(64)]) for i in range(200)]
    same = rows[7][1]
    rows += [(300 + i, same) for i in range(20)] + [(7, same), (7, same), (None, same), (None, [0.5] * 64)]
    rows += [(400, None), (401, []), (402, same[:63]), (403, [*same, 1.0]), (404, [None, *same[1:]]), (405, [math.nan, *same[1:]]), (406, [math.inf, *same[1:]]), (407, [-math.inf, *same[1:]]), (408, [-1e-9] * 64), (409, [90_000.0] * 64)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance string, id string, v string"


def test_clusters_are_those_of_a_plain_loop(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], VECTORS)
    got = clustering.clustered(df.repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == plain_clusters(rows)


def test_few_and_equal_vectors(spark):
    same = [0.25] * 64
    for rows in ([(1, same), (2, same), (3, [1.0] * 64)], [(i, same) for i in range(30)], []):
        df = spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], VECTORS)
        assert Counter(tuple(r) for r in clustering.clustered(df).collect()) == plain_clusters(rows)
    found = clustering.cluster_vectors(spark.createDataFrame([(i, same, 1, "a", "b", "c", "d") for i in range(30)], VECTORS))
    assert [r.cluster_inertia for r in found["clusters"].orderBy("cluster").collect()] == [0] * 8 and len(found["centroids"]) == 8


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 1, "a", "b", "c", "d")], VECTORS)
    with pytest.raises(Exception, match="don't fit"):
        clustering.clustered(df).collect()
