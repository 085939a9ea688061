"""Quality, sharding, URL and license operators against plain Python."""

import re
import zlib
from collections import Counter

import duckdb
import pytest

from sievework.llm import license_scan, quality, queries, sharding, url_filter

SF = "/root/testdata/sf0.001"
LISTED_URLS = ["https://ththhe.example.com/es/30669", "http://www.therth.example.org/fr/8515/", "http://spam.example.org/fr/offers", "https://blog.ththth.example.org/fr/35999/"]
DOCS = "doc_id long, text string, lang string, source string, words string, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hard_docs(spark):
    """Null, empty, blank, repeated and long texts, and columns with names that operators use."""
    long_text = "alpha beta gamma delta " * 5000 + "end"
    rows = [
        (1, None, None, "s", "w", 1), (2, "", "en", "s", "w", 2), (3, " \t\n ", "en", None, None, None), (4, long_text, "en", "s", "w", 3),
        (5, "one two three one two three", "en", "s", "w", 3), (5, "one two three one two three", "en", "s", "w", 3), (None, "é $$ ü\nline\nline\n \n \nline", "en", "s", "w", 3),
        (7, "a b c a b c a b", "en", "s", "w", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(inside)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("table", ["sf", "hard"])
def test_quality_counts(spark, table):
    docs = hard_docs(spark) if table == "hard" else spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter((r.doc_id, *by_hand(r.text)) for r in docs.collect())
    rows = quality.judged(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_rejects_junk(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.doc_id in labels]
    clean = [r for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    junk = [r for r in rows if labels[r.doc_id] == 0]
    assert sum(r.kept for r in junk) <= 0.5 * len(junk)


def test_quality_filter_keeps_columns(spark):
    docs = hard_docs(spark)
    out = quality.good_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {4}
    assert quality.judged(docs.limit(0)).count() == 0


def test_em_recovers_accuracies():
    import random

    random.seed(5)
    right_good, right_bad = [0.9, 0.8, 0.95], [0.7, 0.9, 0.8]
    seen = Counter()
    for _ in range(40000):
        y = random.random() < 0.7
        seen[tuple(int(y == (random.random() < (g if y else b))) for g, b in zip(right_good, right_bad))] += 1
    share, good, bad = quality.estimate(sorted(seen.items()), 3)
    assert abs(share - 0.7) < 0.05
    assert max(abs(a - b) for a, b in zip(good + bad, right_good + right_bad)) < 0.06


def test_sharding(spark):
    docs = hard_docs(spark).unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), allowMissingColumns=True)
    rows = sharding.assign(docs, 40).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots = {}
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "key"
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 40 for r in rows) and len(slots) == 40
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.assign(docs.limit(0)).count() == 0


def test_sharding_confines_movement(spark):
    from pyspark.sql import functions as F

    keys = spark.range(4000)
    less, more = [1.0] * 20, [1.0] * 20
    more[3] = 2.0  # region 0, rack 0
    for r in keys.select(sharding.shard_of(F.col("id"), less).alias("a"), sharding.shard_of(F.col("id"), more).alias("b")).where("a <> b").collect():
        assert r.b < 10  # rows move only into the region whose weight grew
    off = [1.0] * 20
    off[7] = 0.0
    moved = keys.select(sharding.shard_of(F.col("id"), less).alias("a"), sharding.shard_of(F.col("id"), off).alias("b")).collect()
    assert all(r.b != 7 for r in moved) and all(r.a < 10 for r in moved if r.a != r.b)
    share = Counter(r.b for r in moved)
    assert all(100 < n < 350 for n in share.values())


def url_by_hand(url, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        n, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if (host or path) and host + path.rstrip("/") in listed else "allow"


def test_url_filter(spark):
    odd = [
        (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.COM/en/7x?q"), (5, "http://com/en/"), (6, "x://sub.net/de/8"), (7, "x://b.example.net/de/81#f"),
        (8, "http://notcom/en/"), (9, "http://EXAMPLE.org"), (10, "http://example.org?x/es/"), (11, "http://spam.example.org/fr/offers/?a"), (12, "a://b://c/en/"), (12, "http://x.com\n/en/"), (13, "http://.com/en/"), (14, "http://" + "a." * 3000 + "com/en/" + "p" * 9000),
    ]
    pages = spark.createDataFrame(odd, "page_id long, url string").unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url"))
    pages = pages.selectExpr("*", "'x' key", "1 rid", "2 block", "'h' host")
    listed = {"ththhe.example.com/es/30669", "www.therth.example.org/fr/8515", "spam.example.org/fr/offers", "blog.ththth.example.org/fr/35999"}
    got = url_filter.judge(pages, queries.URL_RULES, spark.createDataFrame([(u,) for u in LISTED_URLS], "url string"))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((r.page_id, *url_by_hand(r.url, listed)) for r in pages.select("page_id", "url").collect())
    empty = url_filter.judge(pages, [], spark.createDataFrame([], "url string"))
    assert {r.verdict for r in empty.collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, spark.createDataFrame([], "url string")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    blocks = 3000 * url_filter.BITS_PER_KEY // 512
    made = url_filter.bloom(keys, blocks)
    assert url_filter.passing(keys, made, blocks).count() == 3000
    assert url_filter.passing(spark.range(20000).selectExpr("concat('other', id) AS key"), made, blocks).count() < 400


def license_by_hand(text, least=0.8):
    w, out = license_scan.words((text or "").encode()), []
    pairs = list(zip(w, w[1:]))
    for name, template in license_scan.TEMPLATES.items():
        t = license_scan.words(template.encode())
        own = set(zip(t, t[1:]))
        at = [i for i, p in enumerate(pairs) if p in own]
        while at:
            n = 1
            while n < len(at) and at[n] - at[n - 1] <= license_scan.GAP:
                n += 1
            a, z = at[0], at[n - 1]
            seg = set(pairs[a : z + 1])
            dice = 2 * len(seg & own) / (len(seg) + len(own))
            if dice >= least:
                out.append((name, a, z + 1, round(dice, 9)))
            at = at[n:]
    return out


def test_license_scan(spark):
    extra = [(f"xx {t} yy",) for t in license_scan.TEMPLATES.values()] + [("RELEASED   under\nthe MIT license!",), (None,), ("",), ("Licensed under the old Apache License Version 2.0",), ("licensed " * 50,)]
    docs = spark.createDataFrame([(10**6 + i, t) for i, (t,) in enumerate(extra)], "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    docs = docs.selectExpr("*", "1 AS t", "'x' AS license")
    want = Counter((r.doc_id, *m) for r in docs.collect() for m in license_by_hand(r.text))
    got = Counter((r.doc_id, r.license, r.first_word, r.last_word, round(r.dice, 9)) for r in license_scan.scan(docs).collect())
    assert got == want and len(got) > 40
    assert license_scan.scan(docs.limit(0)).count() == 0


def windows_by_hand(text, templates, least=0.8):
    """Every window that starts and ends at a bigram of the template; the best ones that share no word."""
    w, out = license_scan.words(text.encode()), []
    pairs = list(zip(w, w[1:]))
    for name, template in templates.items():
        t = license_scan.words(template.encode())
        own = set(zip(t, t[1:]))
        at = [i for i, p in enumerate(pairs) if p in own]
        sets = [(a, z, set(pairs[a : z + 1])) for a in at for z in at if a <= z]
        every = sorted((-2 * len(s & own) / (len(s) + len(own)), z - a, a, z) for a, z, s in sets)
        used: set = set()
        chosen = []
        for dice, _, a, z in every:
            if -dice >= least and used.isdisjoint(range(a, z + 2)):
                used |= set(range(a, z + 2))
                chosen.append((a, z, round(-dice, 9)))
        for a, z, dice in sorted(chosen):
            same = set(pairs[a : z + 1])
            used -= set(range(a, z + 2))
            free = lambda x, y: set(pairs[x : y + 1]) == same and used.isdisjoint(range(x, y + 2))  # noqa: B023, E731
            z = max(y for y in at if y >= z and free(a, y))
            a = min(x for x in at if x <= a and free(x, z))
            used |= set(range(a, z + 2))
            out.append((name, a, z + 1, dice))
    return out


def test_license_windows_against_brute_force(spark):
    import random

    mit, apache = "Released under the MIT License.", license_scan.TEMPLATES["Apache-2.0"]
    bsd = "Redistribution and use in source and binary forms of the software as well as documentation, with or without modification, are permitted provided that the following conditions are met:"
    texts = [bsd, f"{mit}\n{apache}\n{mit}", f"{mit} {mit}", f"{apache} {apache} {apache}", "under the " * 40 + mit]
    random.seed(10)
    for _ in range(150):
        w = [x for _ in range(random.choice([1, 2, 3])) for x in (*license_scan.words(random.choice(list(license_scan.TEMPLATES.values())).encode()), *[b"of"] * random.randint(0, 3))]
        for _ in range(random.choice([0, 1, 3, 8])):
            k = random.randrange(len(w))
            w[k : k + random.choice([0, 1])] = random.choice([[b"the"], [random.choice(w)], [b"old", b"new"], w[k : k + 4], [b"xx"] * 30])
        texts.append(b" ".join(w).decode())
    templates = license_scan.TEMPLATES | {"two": "a the", "own": "the the the license the"}
    for least in (0.8, 0.5):
        got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, least).collect()
        want = Counter((i, *m) for i, t in enumerate(texts) for m in windows_by_hand(t, templates, least))
        assert Counter((r.doc_id, r.license, r.first_word, r.last_word, round(r.dice, 9)) for r in got) == want
    kinds = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {(0, "BSD-3-Clause"), (1, "Apache-2.0"), (1, "MIT")} <= kinds


def test_license_lines_all_found(spark):
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    found = {(r.doc_id, r.license) for r in license_scan.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    for name, line in lines.items():
        for d, t in rows:
            if line in t.split("\n"):
                assert (d, name) in found


def test_the_registered_list_blocks_its_urls(spark):
    """Every page of the query against rules and list by hand; the filter has many keys."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        m = re.match(r"[^/?#]*", rest := url.split("://", 1)[1])
        return m[0].lower(), re.match(r"[^?#]*", rest[m.end() :])[0]

    plain = lambda h, p: (h, p.rstrip("/"))
    listed = {plain(*parts(r.url)) for r in rows if re.search(queries.SPAM_HOSTS, parts(r.url)[0])}
    want = {}
    for r in rows:
        h, p = parts(r.url)
        fits = [(len(rh + rp), len(rh), v == "block", rh + rp, v) for v, rh, rp in queries.URL_RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        rule = max(fits, default=None)
        want[r.page_id] = (h, p, rule and rule[3], rule[4] if rule else "block" if plain(h, p) in listed else "allow")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op3_url_filter(spark, sf).collect()}
    assert got == want and sum(r.listed for r in queries.op3_url_filter(spark, sf).collect()) >= 20
