"""The ten operators against brute force on small and awkward tables."""

import base64
import gc
import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from curatrix.llm import bpe_codec, common, fingerprints, mixing, near_dedup, pretokens, quality_classifier, quality_rules, sharding, token_counts, toxicity, url_filter
from curatrix.llm.components import connected_components
from curatrix.llm.labelled import remainder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTS = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, class string, band string"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with the other columns and some whose names might clash."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or ""), "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    draw = random.Random(3)
    words = ["the", "of", "Alpha", "beta", "gam'ma", "délta", "中文", "😀", "12", "x!", "a|b", "<|endoftext|>", "don't", "we'll"]
    prose = [" ".join(draw.choices(words, k=draw.randint(1, 80))) + draw.choice(["", "\n", ".\nMore text. "]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "x" * 5000), (104, "a b c"), (105, "a b c"), (106, "a b c"), (106, "a b c"), (106, "other text here"), (None, "no id")]
    rows += [(200 + i, "same text for many rows, again and again. " * 3) for i in range(30)]
    rows += [(300, " ".join(draw.choices(words, k=4000)))]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).persist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pretokens_match_the_pattern():
    import regex

    draw = random.Random(1)
    alphabet = ["a", "s", "t", "re", "ve", "ll", "'", "'", " ", " ", "\n", "1", "é", "!", "中", "😀", "\x1c", "　", "\xa0"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 12))) for _ in range(5000)] + [None]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for row, data, offsets in pretokens.slices(pa.array(texts)):
        starts = pretokens.boundaries(data, offsets)
        words = [w.decode() for w in pretokens.words_of(data, starts).to_pylist()]
        at = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            assert words[at[i] : at[i + 1]] == pattern.findall(texts[row + i] or "")


def test_op1_edited_texts_and_likeness(spark, odd):
    rows = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in odd_rows()))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        then, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        want[(None if d == -(1 << 63) else d, len(t), sha(t[: len(t) - k] + then[:k]))] += 1
    got = fingerprints.fingerprint_documents(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = defaultdict(set)
    texts = defaultdict(set)
    for d, t in odd_rows():
        texts[d].add(t or "")
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            by_text[next(iter(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    one = [r for r in got if r.doc_id in (210, 211)]
    assert all(r.near_next == 1 for r in one)
    assert fingerprints.fingerprint_documents(documents(spark, [])).count() == 0
    alone = fingerprints.fingerprint_documents(documents(spark, [(7, "abcdefgh")])).first()
    assert alone.edited_sha256 == sha("abcdefab")


def test_op1_hot_doc_id(spark):
    """A doc_id of a third of all rows is split over buckets; every row still has its own next one."""
    rows = [(i, f"text number {i}. It has two sentences") for i in range(200)] + [(77, f"another text {i} of the hot id") for i in range(100)] + [(None, f"no id {i}") for i in range(60)]
    got = fingerprints.fingerprint_documents(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t)) for d, t in rows)
    made = Counter(r.edited_sha256 for r in got)
    whole = {d: [t for e, t in rows if e == d] for d in (None, 77, 78)}
    for d, t in rows:  # within one doc_id any order will do
        nexts = whole[d] + [rows[0][1], rows[78][1]] if d in (None, 77) else [rows[(d + 1) % 200][1]] if d != 76 else whole[77]
        k = len(t) // 4
        assert any(made[sha(t[: len(t) - k] + then[:k])] for then in nexts + ([x for x in whole[None]] if d == 199 else []))


def test_op1_likeness_is_near_the_truth():
    draw = np.random.default_rng(6)
    words = [f"word{i}" for i in range(5000)]
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        got = []
        for _ in range(30):
            a = [" ".join(draw.choice(words, 6)) + "." for _ in range(60)]
            b = a[: int(60 * share)] + [" ".join(draw.choice(words, 6)) + "." for _ in range(60 - int(60 * share))]
            x, y = "\n".join(a), "\n".join(b)
            count = [Counter(p for line in fingerprints.paragraphs(t) for p in fingerprints.pieces(line)) for t in (x, y)]
            keys = set(count[0]) | set(count[1])
            truth = 1 - sum((count[0][k] - count[1][k]) ** 2 for k in keys) / sum(count[0][k] ** 2 + count[1][k] ** 2 for k in keys)
            v = fingerprints.vectors([x, y])
            got.append(fingerprints.likeness(v[:1], v[1:])[0] - truth)
        assert abs(np.mean(got)) < 0.06 and np.abs(got).max() < 0.35


def test_op1_multiset_laws():
    v = fingerprints.vectors(["a b c.\nd e f.\ng", "g\nd e f.\na b c.", "a b c.\nd e f.", ""])
    assert (v[0] == v[1]).all() and not (v[0] == v[2]).all() and not v[3].any()
    assert (fingerprints.added(v[0], ["g"], -1) == v[2]).all() and (fingerprints.added(v[2], ["g"]) == v[0]).all()


def test_op2_as_tiktoken(spark, odd):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t in odd_rows():
        ids = enc.encode_ordinary(t or "")
        want[(d, len(ids), sha(",".join(map(str, ids))), sha(t or ""))] += 1
    for size in (4 << 20, 500):  # with 500, many chunks
        got = bpe_codec.encode_documents(odd, RANKS, digest=True, chunk=size).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(odd, RANKS), RANKS).collect()
    assert Counter((r.doc_id, bytes(r.bytes).decode()) for r in back) == Counter((d, t or "") for d, t in odd_rows())
    assert bpe_codec.encode_documents(documents(spark, []), RANKS, digest=True).count() == 0


def test_op2_rows_without_ids(spark):
    """Rows are told apart by place: 250,000 distinct texts without a doc_id keep their own ids."""
    texts = [f"text {i} of {i * 7919 % 1000} words" for i in range(250_000)]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    frame = spark.range(250_000).selectExpr("cast(null as long) as doc_id", "concat('text ', id, ' of ', id * 7919 % 1000, ' words') as text")
    got = bpe_codec.encode_documents(frame, RANKS, digest=True).toPandas()
    want = Counter(sha(",".join(map(str, ids))) for ids in enc.encode_ordinary_batch(texts))
    assert Counter(got["ids_sha256"]) == want and Counter(got["decoded_sha256"]) == Counter(map(sha, texts))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "bad.org/")]


def test_op3_rules_and_redirects(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://A.Example.COM/en/5?x#y", ""),
        (2, "https://example.com/en/77", None),
        (3, "http://com/en/", ""),
        (4, "nothing", ""),
        (5, None, None),
        (6, "https://mirror.io/a", link.format("https://bad.org/z")),  # alias of a blocked url that is no page
        (7, "https://other.io/b", '<meta http-equiv="refresh" content="0; url=https://mirror.io/a">'),
        (8, "https://good.io/c", link.format("https://example.com/en/78") + link.format("https://bad.org/q")),  # an allowed alias wins
        (9, "https://plain.io/d", link.format("/e")),
        (10, "https://mirror.io/a#frag", ""),
        (10, "https://mirror.io/a#frag", ""),
    ]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, component string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/5", "com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/7", "allow")
    assert got[3].verdict == "block" and got[4].host == got[4].path == got[5].host == ""
    assert got[4].rule is None and got[5].verdict == "allow"
    assert [got[i].verdict for i in (6, 7, 8, 9, 10)] == ["block", "block", "allow", "allow", "block"]
    assert url_filter.filter_urls(pages, RULES).count() == len(rows)
    more = spark.createDataFrame([("https://plain.io/d", "https://bad.org/x")], "src_url string, dst_url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, RULES, more).collect()}[9] == "block"
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_op3_many_rules(spark):
    """A table of rules says what the expression says, and 100,000 rules are no more than a join."""
    import time

    draw = random.Random(12)
    hosts = ["a.com", "b.a.com", "com", "x.org", "org", "a.co"]
    rules = [(draw.choice(["allow", "block"]), draw.choice(hosts) + draw.choice(["", "/", "/e", "/en/", "/en/7", "/de"])) for _ in range(40)]
    rules = list({r: (v, r) for v, r in rules}.values())
    urls = [(f"http://{draw.choice(['', 'www.', 'b.'])}{draw.choice(hosts)}{draw.choice(['', '/', '/en/5', '/en/77', '/e', '/de/x', '?q'])}",) for _ in range(300)] + [("none",), (None,)]
    pages = spark.createDataFrame([(i, u, "") for i, (u,) in enumerate(urls)], "page_id long, url string, html string")
    few = {tuple(r) for r in url_filter.filter_urls(pages, rules).collect()}
    table = spark.createDataFrame(rules, "verdict string, rule string")
    assert {tuple(r) for r in url_filter.filter_urls(pages, table).collect()} == few
    many = table.union(spark.range(100_000).selectExpr("'block'", "concat('site', id % 5000, '.net/p', id)"))
    start = time.time()
    assert {tuple(r) for r in url_filter.filter_urls(pages, many).collect()} == few
    assert time.time() - start < 60


def test_what_is_freed_leaves_the_driver(spark, monkeypatch):
    """Many small steps leave free native memory in the driver; every few tables it goes back to the machine."""
    import time

    jvm = spark.sparkContext._jvm
    held = Path(f"/proc/{jvm.ProcessHandle.current().pid()}/smaps_rollup")
    if not held.exists():
        pytest.skip("no /proc")
    resident = lambda: int(re.search(r"Anonymous:\s+(\d+)", held.read_text())[1]) / 1024
    frame = spark.range(10)
    monkeypatch.setattr(common, "TIDY", 10**9)
    common.materialize(frame, "warm")
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(1500)]
    kept, buffers = buffers[::50], None  # what is kept lies between what goes, so the C library doesn't give it back itself
    for _ in range(4):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.2)
    before = resident()
    monkeypatch.setattr(common, "TIDY", 1)
    common.materialize(frame, "tidy")
    assert resident() < before - 50 and len(kept) == 30


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[100 + i] == 100 for i in range(50)) and got[500] == 500
    assert len(got) == 72


def test_components_take_few_jobs(spark):
    """The driver keeps something of every job, so a round has few of them; labels are joined without a new search."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "a chain")
    try:
        labels = near_dedup._labels(edges.selectExpr("a as a", "b as b"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 54
    links = spark.createDataFrame([(20, 30), (30, 31), (40, 41)], "a long, b long")
    got = {r["class"]: r.component for r in near_dedup._relabelled(labels, links).collect()}
    assert got == dict.fromkeys([*range(21), 30, 31], 0) | {40: 40, 41: 40}


def brute_components(rows, n, percent=80):
    sets = []
    for d, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
        sets.append({tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("n", "pivots", "block"), [(4, 3, 256), (5, 1, 8)])
def test_op4_as_brute_force(spark, n, pivots, block):
    draw = random.Random(n)
    rows = [(d, t) for d, t in odd_rows() if d is not None]
    base = [f"w{draw.randint(0, 500)}" for _ in range(150)]
    for i in range(120):  # a large group of near copies, pairs of which often fall short of a link
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = f"v{draw.randint(0, 9999)}"
        rows.append((1000 + i, " ".join(own)))
    s = near_dedup.Settings(words=n, pivots=pivots, block=block)
    got = near_dedup.near_duplicates(documents(spark, rows), s).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, n))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(documents(spark, []), s).count() == 0


def chained(steps, shared):
    """A chain of texts, each a link from the next only, and texts that share most of their words but don't link."""
    draw = random.Random(4)
    now, rows = [f"w{i}" for i in range(120)], []
    for i in range(steps):
        now[i * 7 % 120] = f"n{i}"
        rows.append((2000 + i, " ".join(now)))
    same = " ".join(f"s{i}" for i in range(90))
    return rows + [(5000 + i, same + " " + " ".join(f"o{draw.randint(0, 99999)}" for _ in range(30))) for i in range(shared)]


@pytest.mark.parametrize(("pivots", "dealt"), [(1, 10), (2, 25), (1, 262_144)])
def test_op4_hot_bands_and_wide_clusters(spark, pivots, dealt, monkeypatch):
    rows = chained(150, 80)
    s = near_dedup.Settings(words=4, pivots=pivots, block=8, wide=20, dealt=dealt)
    told = {"anew": 0, "members": []}
    rare, settled = near_dedup._rare_bands, near_dedup._settled

    def counted(named, *rest):
        told["anew"] += named.count()
        return rare(named, *rest)

    def measured(clusters, *rest):
        told["members"] += [r["count"] for r in clusters.groupBy("component").count().collect()]
        return settled(clusters, *rest)

    monkeypatch.setattr(near_dedup, "_rare_bands", counted)
    monkeypatch.setattr(near_dedup, "_settled", measured)
    got = near_dedup.near_duplicates(documents(spark, rows), s).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 4))
    # What merely shares passages makes a wide cluster by bands of registers (but for who is the pivot of each of its bands
    # and so has met all of them), and none by rare shingles.
    assert told["anew"] >= 60
    assert max(told["members"], default=0) < 80


def test_op4_parts_of_a_hot_band(spark):
    """A band dealt to parts: each class beside its part's pivot, each pivot beside the band's; no task has many rows."""
    rows = spark.createDataFrame([(7, i.to_bytes(4, "big"), None) for i in range(1000)] + [(8, b"x", None), (8, b"y", None), (9, b"z", None)], "band long, class binary, label binary")
    got = near_dedup._stars(rows, near_dedup.Settings(dealt=50)).collect()
    hot = [(bytes(r.pivot), bytes(r["class"])) for r in got if r.band == 7]
    heads = {p for p, c in hot if p == c}
    assert 15 <= len(heads) <= 20
    assert {c for _, c in hot} == {i.to_bytes(4, "big") for i in range(1000)}
    first = (0).to_bytes(4, "big")
    assert {c for p, c in hot if p == first} >= heads
    assert max(Counter(p for p, _ in hot if p != first).values()) < 120
    assert [(bytes(r.pivot), bytes(r["class"])) for r in got if r.band in (8, 9)] == [(b"x", b"y")]


def test_op4_rare_bands_lose_no_link(spark):
    rows = chained(40, 30)
    s = near_dedup.Settings(words=4)
    sets = {str(d).encode(): near_dedup.shingle_set(t, 4) for d, t in rows}
    schema = "class binary, n long, sketch binary, shingles binary"
    details = spark.createDataFrame([(name, len(own), b"", own.tobytes()) for name, own in sets.items()], schema)
    bands = defaultdict(set)
    for r in near_dedup._rare_bands(details.select("class"), details, s).collect():
        bands[r.band].add(bytes(r["class"]))
    together = {(a, b) for own in bands.values() for a in own for b in own}
    names = list(sets)
    links = [(a, b) for i, a in enumerate(names) for b in names[:i] if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(links) >= 39 and all(pair in together for pair in links)
    assert not any((a, b) in together for a in names[40:] for b in names[40:] if a != b)


def test_op4_links_rows_without_ids(spark):
    draw, least = random.Random(8), -(1 << 63)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(100)]
    near = lambda k: " ".join([*base[k:], *(f"v{i}" for i in range(k))])  # noqa: E731  far ends link through the middle
    rows = [(1, near(0)), (None, near(8)), (2, near(16)), (3, "other words that stand alone here"), (None, "again some words that stand alone")]
    got = near_dedup.near_duplicates(documents(spark, rows), near_dedup.Settings(words=4)).collect()
    whole = lambda d: least if d is None else d
    want = brute_components([(whole(d), t) for d, t in rows], 4)
    assert {c for d, _, c in want if d in (1, 2)} == {least}
    assert Counter((whole(r.doc_id), r.n_shingles, whole(r.component_id)) for r in got) == Counter(want)


def test_op4_estimate_is_near_the_truth():
    s, draw = near_dedup.Settings(), np.random.default_rng(5)
    for share in (0.3, 0.8, 0.95):
        n = 4000
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        cut = int(2 * n * share / (1 + share))
        b = np.unique(np.concatenate([a[draw.permutation(len(a))[:cut]], draw.integers(0, 1 << 63, n - cut).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess, _ = near_dedup.estimate(near_dedup.sketch(a, s)[None], near_dedup.sketch(b, s)[None], np.array([len(a)]), np.array([len(b)]), s)
        assert abs(guess[0] - true) < 0.13


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op5_statistics_and_outliers(spark, odd):
    got = quality_rules.judge_quality(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == Counter((d, *brute_statistics(t)) for d, t in odd_rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    draw = random.Random(9)
    clean = [(i, " ".join(f"word{draw.randint(0, 3000)}" for _ in range(draw.randint(60, 400))), "en", None) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{draw.randint(0, 3000)}###" for _ in range(150)), "en", None) for i in range(5)]
    verdict = {r.doc_id: r.kept for r in quality_rules.judge_quality(documents(spark, clean + junk)).collect()}
    assert all(verdict[r[0]] for r in clean) and not any(verdict[r[0]] for r in junk)
    assert quality_rules.judge_quality(documents(spark, [])).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_op5_groups_of_much_junk(spark, share):
    draw = random.Random(int(100 * share))
    junk = set(draw.sample(range(400), int(400 * share)))
    word = lambda i: f"w{draw.randint(0, 3000)}###" if i in junk else f"word{draw.randint(0, 3000)}"
    rows = [(i, " ".join(word(i) for _ in range(draw.randint(60, 400))), "en", "s") for i in range(400)]
    got = quality_rules.judge_quality(documents(spark, rows)).collect()
    assert {r.doc_id for r in got if not r.kept} == junk


def test_op6_targets_and_permutation(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 300, 900])), "en", draw.choice(["a", "b", "c", "d", None])) for i in range(150)]
    rows += [(149, "twice here", "en", "a"), (None, "x y z", "en", "b"), (151, None, "en", "zz")]
    p = mixing.Mix(block=16, run=8)
    out = mixing.mix_sources(documents(spark, rows), p)
    got = out["digest"].collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    left = 1.5 * sum(sizes.values())
    while True:  # share by weight; what is above twice a size stops there
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    source = {(r.source): r.target for r in out["targets"].collect()}
    for s in names:
        assert source[s] == pytest.approx(target[s])
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    wanted = defaultdict(float)
    for s in names:
        wanted[sizes[s], round(target[s], 6)] += target[s]
    assert all(abs(taken[k] - wanted[k]) <= len(names) for k in wanted)
    drawn = out["drawn"].groupBy("sid", "pass").agg({"j": "count"}).collect()
    distinct = out["drawn"].select("sid", "pass", "block").distinct().groupBy("sid", "pass").count().collect()
    assert {(r.sid, r["pass"]): r["count(j)"] for r in drawn} == {(r.sid, r["pass"]): r["count"] for r in distinct}
    again = mixing.mix_sources(documents(spark, rows[::-1]).repartition(3), p)["digest"].collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sources(documents(spark, []))["digest"].count() == 0


def test_op6_shards_are_drawn_as_a_multinomial(spark):
    rows = [(i, "w " * 4000, "en", "ab"[i % 2]) for i in range(60)] + [(-(1 << 63), "least id of all", "en", "a")]
    p = mixing.Mix(block=16, shards=64)
    drawn = mixing.mix_sources(documents(spark, rows), p)["drawn"].groupBy("sid", "shard").count().collect()
    for sid in {r.sid for r in drawn}:
        n = np.zeros(64)
        for r in drawn:
            if r.sid == sid:
                n[r.shard] = r["count"]
        chi = ((n - n.mean()) ** 2 / n.mean()).sum()
        assert 30 < chi < 110  # 63 degrees of freedom: 99.8 % of draws lie within


@pytest.mark.parametrize(("weights", "share"), [((1, 20, 20), 0.9), ((5, 2, 1), 1.5)])
def test_repeating_meets_targets_at_every_length(spark, weights, share):
    draw = random.Random(11)
    rows, size = [], {}
    for i in range(900):  # source a has a third of the rows, and all lengths
        n = draw.choice([40, 100, 300, 1500, 3000])
        rows.append((i, " ".join(["w"] * n), "en", "abc"[i % 3]))
        size[i] = n
    p = mixing.Mix(weights=weights, share=share)
    docs = documents(spark, rows)
    target = {r.source: r.target / r.source_size for r in mixing.mix_sources(docs, p)["targets"].collect()}
    out = [(r.source, size[r.doc_id]) for r in mixing.repeat_by_mix(docs, p).select("doc_id", "source").collect()]
    assert out and len(out) == mixing.repeat_by_mix(docs.repartition(5), p).count()
    for s in "abc":
        of = lambda least: sum(n for i, n in size.items() if "abc"[i % 3] == s and n >= least)
        assert abs(sum(n for t, n in out if t == s) / of(0) - target[s]) < 0.02
        assert abs(sum(n for t, n in out if t == s and n > 1000) / of(1001) - target[s]) < 0.05


def test_op7_balance_and_slots(spark, odd):
    draw = random.Random(8)
    rows = [(i, f"text {i % 97} " + "x" * (i % 211) + " y" * draw.randint(0, 30)) for i in range(3000)]
    hot = [(None, "the hot text of a third of all rows " * 5)] * 1500  # without an id
    large = [(9000, "a group that a shard holds " * 3)] * 100
    for docs, even in ((documents(spark, rows + hot + large), True), (odd, False)):
        got = sharding.shard_documents(docs).collect()
        assert len(got) == docs.count() and all(0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if even:
            loads, texts = defaultdict(lambda: np.zeros(3)), defaultdict(set)
            for r in got:
                loads[r.shard] += [r.size, r.n_words, 1]
                texts[r.text_crc32].add(r.shard)
            loads = np.array(list(loads.values()))
            assert len(loads) == 24 and (loads.max(axis=0) < 1.06 * loads.min(axis=0)).all()
            assert sum(len(v) > 1 for v in texts.values()) == 1  # the hot text alone is torn
    import zlib

    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_op7_packs_by_the_dot_product():
    """Each item, the largest first, goes where a plain loop over shards finds the highest dot product."""
    items = np.random.default_rng(4).integers(0, 1000, (60, 3)).astype(float)
    share, left, want = items * 5 / items.sum(axis=0), [[1.0] * 3 for _ in range(5)], {}
    for i in sorted(range(60), key=lambda i: (-max(share[i]), i)):
        products = [round(sum(a * b for a, b in zip(left[k], share[i], strict=True)), 12) for k in range(5)]
        want[i] = products.index(max(products))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], share[i], strict=True)]
    got = sharding.pack(items, 5)
    assert got.tolist() == [want[i] for i in range(60)]
    spread = lambda out: max(np.ptp([share[out == k].sum(axis=0)[d] for k in range(5)]) for d in range(3))
    assert spread(sharding.even_out(items, got, 5)) <= spread(got)
    assert sharding.pack(np.zeros((3, 3)), 2).tolist() == [0, 0, 0]


def labelled_texts(n, seed):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for w in draw.sample(["vile", "rotten", "nasty", "awful"], 3):
                words.insert(draw.randrange(len(words)), w)
        junk = i % 4 == 1
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_op8_and_op9_on_held_out_rows(spark):
    rows, labels = labelled_texts(1200, 4)
    extra = [(5000, None), (5001, ""), (5002, rows[0][1]), (3, "second row of an id")]
    docs = documents(spark, rows + extra)
    table = spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    for f, column, args in ((toxicity.score_toxicity, 2, (5, 0)), (quality_classifier.score_quality, 1, (4, 2))):
        got = f(docs, table, *args).collect()
        assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
        truth = {r[0]: r[column] for r in labels}
        held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
        assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
        empty = {r.doc_id: r.score for r in got if r.doc_id in (5000, 5001)}
        assert empty[5000] == empty[5001]
        nothing = f(docs, table.limit(0), *args).collect()
        assert len(nothing) == len(got) and len({r.score for r in nothing}) == 1
        assert f(documents(spark, []), table, *args).count() == 0
    import zlib

    for r in docs.select("doc_id", remainder(docs["doc_id"], 5).alias("m")).limit(50).collect():
        assert r.m == zlib.crc32(str(r.doc_id).encode()) % 5


def test_op9_votes_as_brute_force():
    """Blocked votes equal a plain loop over all cosines, ties by the examples' order."""
    rows, labels = labelled_texts(150, 7)
    texts, s = [t for _, t in rows], quality_classifier.Settings(near=5)
    x = np.concatenate(list(quality_classifier.features(pa.array(texts + texts[:20]))))
    y = np.array([q for _, q, _ in labels] + [1 - q for _, q, _ in labels[:20]], np.float32)  # copies with the other label: ties
    space = quality_classifier.LatentSpace(x, s)
    z = space.place(x)
    alike = z @ z.T
    got = quality_classifier.votes(alike, y, s)
    for i in range(60):
        best = sorted(range(len(y)), key=lambda j: (-round(float(alike[i, j]) * 1e6), j))[:5]
        w = [max(round(float(alike[i, j]) * 1e6) / 1e6, 0) ** s.sharp for j in best]
        want = (sum(a * float(y[j]) for a, j in zip(w, best, strict=True)) + s.doubt * float(y.mean())) / (sum(w) + s.doubt)
        assert abs(got[i] - want) < 1e-9
    one, two = (next(quality_classifier.features(pa.array([t])))[0] for t in ("Plain WORDS here", "plain words HERE"))
    assert (one[-quality_classifier.WORDS :] == two[-quality_classifier.WORDS :]).all() and one[-quality_classifier.WORDS :].sum() > 0


def test_op8_index_is_exact():
    draw = np.random.default_rng(1)
    rows = []
    for _ in range(500):
        terms = np.sort(draw.choice(60, draw.integers(1, 8), replace=False))
        w = draw.random(len(terms)) + 0.1
        rows.append((terms, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex([r[0] for r in rows], [r[1] for r in rows], 60)
    for at, (terms, weights) in enumerate(rows[:60]):
        q = dict(zip(terms, weights, strict=True))
        brute = sorted(((round(sum(q.get(t, 0) * x for t, x in zip(*r, strict=True)), 9), i) for i, r in enumerate(rows)), key=lambda x: (-x[0], x[1]))
        assert index.nearest(terms, weights, 10) == [b for b in brute if b[0] > 0][:10]
        assert index.nearest(terms, weights, 10, at) == [b for b in brute if b[0] > 0 and b[1] != at][:10]


def test_op8_votes_as_brute_force(spark):
    """Scores equal those of dense TF-IDF vectors, a full sort and the same logistic map."""
    rows, labels = labelled_texts(300, 9)
    docs, s = documents(spark, rows), toxicity.Settings(near=7)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    voters = toxicity.learn(docs, table, 5, 0, s)
    texts, truth = dict(rows), {r[0]: r[2] for r in labels}
    own = {d: Counter(toxicity.words(texts[d])) for d in voters.ids}
    df = Counter(w for _, t in rows for w in set(toxicity.words(t)))
    spelt = sorted(voters.place)
    idf = np.array([np.log((1 + len(rows)) / df[w]) for w in spelt])
    n, p = (np.array([sum(w in own[d] for d in voters.ids if y is None or truth[d] == y) for w in spelt], float) for y in (None, 1))
    weight = idf * voters.tied(n, p)
    dense = lambda c: (lambda v: v / max(np.linalg.norm(v), 1e-12))(np.array([(1 + np.log(c[w])) if c[w] else 0 for w in spelt]) * weight)
    matrix = np.array([dense(own[d]) for d in voters.ids])
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, table, 5, 0, s).collect()}
    for d, t in rows[:80]:
        cosine = (matrix @ dense(Counter(toxicity.words(t)))).round(9)
        best = [i for i in np.lexsort((np.arange(len(cosine)), -cosine))[:7] if cosine[i] > 0]
        square = cosine[best] ** 2
        vote = (sum(square * voters.labels[best]) + s.doubt * voters.rate) / (sum(square) + s.doubt)
        assert abs(got[d].score - voters.probability(np.array([vote]))[0]) < 1e-6
        assert got[d].neighbours == [voters.ids[i] for i in best[:10]]


def test_op10_as_the_library(spark, odd):
    library = Tokenizer.from_file(COUNTS)
    want = Counter()
    for d, t in odd_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 1024)] += 1
    for chunk in (token_counts.CHUNK, 37, 7):  # small chunks compose by their state maps
        got = token_counts.count_tokens(odd, COUNTS, chunk=chunk).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(documents(spark, []), COUNTS).count() == 0


def test_op10_long_texts(spark):
    """Texts of many chunks with and without seams; time is linear in the length."""
    library, draw = Tokenizer.from_file(COUNTS), random.Random(5)
    made = ["".join(draw.choices("abc ,.'\n12é中😀<|endoftext|>", k=4000)), "x" * 9000, "ab1'll" * 2000, " " * 5000 + "end", "中文，" * 3000, "don't we'll " * 900]
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, list(enumerate(made))), COUNTS, chunk=512).collect()}
    for i, t in enumerate(made):
        assert (got[i].n_bytes, got[i].n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
    import time

    took = []
    for n in (1, 4):
        big = documents(spark, [(0, "some words, and 12 more. " * (n * 80_000))])
        start = time.time()
        assert token_counts.count_tokens(big, COUNTS).first().n_tokens > 0
        took.append(time.time() - start)
    assert took[1] < 8 * max(took[0], 1)


def test_op10_state_maps(spark):
    """Maps compose in any grouping to the library's count, long runs without any boundary included; what they miss is recounted."""
    library, machine, draw = Tokenizer.from_file(COUNTS), token_counts.transducer(COUNTS), random.Random(6)
    runs = ["".join(draw.choices(letters, k=6000)) for letters in ("ACGT", "etaoinshr", "aaaaab", "0123456789", "中文字词é")]
    runs += ["=" * 5000, "-" * 3000 + "=", "abab" * 1500, "'" * 2000 + "s", " " * 4000, "   \n\n " * 600, "plain words, and 12 more. " * 200]
    for text in runs:
        want = len(library.encode(text, add_special_tokens=False).ids)
        for chunk in (13, 700):
            maps = []
            for at in range(0, len(text), chunk):
                low, high = max(at - token_counts.WARM_UP, 0), min(at + chunk, len(text))
                maps.append(machine.state_map(text[low : high + token_counts.AHEAD], at - low, high - at, low > 0))
            whole = token_counts.composed(maps)
            assert whole[None][1] == want
            for _ in range(3):  # associative: any way of bracketing gives the same map
                parts = list(maps)
                while len(parts) > 1:
                    i = draw.randrange(len(parts) - 1)
                    j = min(len(parts), i + draw.randrange(2, 40))
                    parts[i:j] = [token_counts.composed(parts[i:j])]
                assert parts[0] == whole
    unknown = {b"a": (b"b", 1), None: (None, None)}
    assert token_counts.composed([unknown, unknown])[None] == (None, None) and token_counts.composed([unknown, unknown])[b"a"] == (None, None)
    rows = list(enumerate([*runs, runs[0]]))
    for warm_up in (token_counts.WARM_UP, 4):  # four characters give no entries inside a run
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, rows), COUNTS, chunk=64, warm_up=warm_up).collect()}
        assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_op10_one_word_of_many_chunks(spark):
    """A single word of 2 MB is dealt to the tasks in chunks."""
    word = "".join(random.Random(7).choices("etaoinshrdlu", k=5000)) * 400
    row = token_counts.count_tokens(documents(spark, [(1, word)]), COUNTS).first()
    assert row.n_tokens == token_counts.transducer(COUNTS).run(0, word.encode())[1] and row.n_bytes == 2_000_000


def plain_mix(rows, p):
    """``doc_id: (taken, spread)`` by walking every slot of every source, word by word."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [r for r in rows if r[1] == s and r[2]] for s in sources}
    total = {s: sum(n for *_, n in own[s]) for s in sources}
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(sources)}
    target, left, free = {}, p.share * sum(total.values()), set(sources)
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > p.cap * total[s]]:
        for s in over:
            target[s] = p.cap * total[s]
            free.discard(s)
            left -= target[s]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}

    def place(j, nb, sid, k_pass):
        for k in range(mixing.ROUNDS):
            key = (p.seed + sid * (48271 + 7919 * k) + k_pass * (69621 + 104729 * k)) % mixing.PRIME * 39373 % mixing.PRIME
            mirror = (key % nb + nb - j) % nb
            if ((max(j, mirror) % mixing.PRIME) * (40692 + 1299709 * k) + key) % mixing.PRIME % 65521 % 2:
                j = mirror
        return j

    out = {d: [0, 0] for d, *_ in rows}
    for sid, s in enumerate(sources):
        stream = [d for d, _, n in sorted(own[s], key=lambda r: (r[0] % 1000003 * 7919 % p.buckets, r[0])) for _ in range(n)]
        quota, nb = round(target[s]), -(-len(stream) // p.block)
        for k_pass in range(p.cap):
            for j in range(nb):
                block = place(j, nb, sid, k_pass)
                words = stream[block * p.block : (block + 1) * p.block][: max(quota, 0)]
                quota -= len(words)
                shard = int(hashlib.md5(f"{sid},{k_pass},{j},{p.seed}".encode()).hexdigest()[:15], 16) % p.shards
                for d in words:
                    out[d][0] += 1
                    out[d][1] += shard + 1
    return {d: tuple(x) for d, x in out.items()}


def test_op6_is_a_walk_through_the_drawn_slots(spark):
    draw = random.Random(11)
    rows = [(i, draw.choice(["a", "a", "b", "c", "d", None]), draw.choice([0, 1, 7, 40, 300])) for i in range(90)]
    docs = documents(spark, [(d, "w " * n, "en", s) for d, s, n in rows])
    seen = []
    for p in (mixing.Mix(block=16, run=8), mixing.Mix(block=16, run=8, seed=7), mixing.Mix(block=5, weights=(1, 4), share=1.2)):
        got = {r.doc_id: (r.taken, r.spread) for r in mixing.mix_sources(docs, p)["digest"].collect()}
        assert got == plain_mix(rows, p)
        seen.append(got)
    assert seen[0] != seen[1]  # another seed, another draw
