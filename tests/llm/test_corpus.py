"""Language model, BPE, language, packing, copies and the pipeline, against plain Python on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import byte_bpe, common, context_mixing, exact_dedup, jaccard_join, language_id, packing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The small table, hard cases, repeated rows, and columns with names that operators use inside."""
    long_text = " ".join(f"word{i % 977} und" for i in range(6000))
    rows = [(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, " \t\n ", "en"), (10**6 + 3, long_text, "en"), (10**6 + 4, "One two", "en"), (10**6 + 4, "One two", "en"), (10**6 + 5, "one  TWO", "en"), (10**6 + 6, "12 34 + 56", "en"), (10**6 + 7, "x" * 3000 + " é́<|endoftext|>'s  \n\n ok", "de"), (None, "a null id here", None)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(extra)
    return out.selectExpr("*", "'x' AS t", "1 AS rid", "2 AS word", "'k' AS key", "3 AS norm", "4 AS digest", "5 AS n").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return text.encode().lower().split()


def fold(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


def test_context_mixing(docs, rows):
    got = context_mixing.scores(docs).collect()
    train = [x for i, x in rows if fold(i, 7) != 2]
    c = Counter(w for x in train for w in words(x))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for i, x in rows:
        w = words(x)
        base = math.log10((len(train) + 1) / (n + v + 1)) + sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w)
        want[i, fold(i, 7) == 2, len(w) + 1, sum(k in c for k in w) + 1, n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    sizes = Counter((i, len(x.encode())) for i, x in rows)
    assert Counter((r.doc_id, round(-r.score / math.log10(2) / r.bits_per_byte) if r.bits_per_byte is not None else 0) for r in got) == sizes
    assert all(len({round(r.score, 6) for r in got if r.doc_id == i}) == 1 for i in (10**6 + 4,))
    assert context_mixing.scores(docs.limit(0)).count() == 0


def test_words_that_are_not_broadcast_are_told_in_training_and_held_out_texts(docs, rows, monkeypatch):
    every = {r.doc_id: (r.n_known, r.base_score) for r in context_mixing.scores(docs).collect()}
    monkeypatch.setattr(context_mixing, "HOT", 4)
    got = context_mixing.scores(docs).collect()
    assert len(got) == len(rows) and all(-math.inf < r.score < 0 for r in got)
    assert all(r.n_known == every[r.doc_id][0] and abs(r.base_score - every[r.doc_id][1]) < 1e-6 for r in got if list(i for i, _ in rows).count(r.doc_id) == 1)


def test_context_mixing_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) < 1200")
    got = [r for r in context_mixing.scores(docs).collect() if r.held_out]
    assert len(got) > 400 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_mixing_code_is_a_distribution():
    ws = context_mixing.Words([b"a", b"b", b"c"], [5, 3, 2], 2, 20, 5, 1)
    tables = {"none": np.zeros(2 * ws.code.nodes, dtype=int), "last": np.zeros(2 * context_mixing.SLOTS, dtype=int), "before": np.zeros(2 * context_mixing.SLOTS, dtype=int)}
    tables |= {f"spell{k}": np.zeros(2 << context_mixing.SPELL_BITS, dtype=int) for k in range(3)}
    tables["none"][:4] = [3, 1, 7, 2]
    every = np.arange(5)
    m = context_mixing.Model(ws, tables)
    zero = np.zeros(5, dtype=int)
    p = 10 ** m.mixed(every, zero, zero, every, zero, 5)
    assert abs(p.sum() - 1) < 1e-9
    assert abs(sum(10 ** m.spelled([bytes([b])])[0] / 10 ** m.spelled([b""])[0] for b in range(256)) * 10 ** m.spelled([b""])[0] - 2**-8) < 1e-9


def test_mixing_sizes_grow_and_escapes_begin_alike():
    words = [b"a", b"b", b"xya", b"xyb", b"xz"]
    small = context_mixing.Words(words, [5, 3, 1, 1, 1], 2, 20, 5, 3, [(b"a", 5, 0), (b"b", 3, 0), (b"xy", 2, 2), (b"xz", 1, 1)])
    assert small.begins == [b"xy", b"xz"] and small.left[1:].tolist() == [2, 1]
    assert small.symbols(np.array([0, -1, 2, 3, 4]), small.kinds_of_words).tolist() == [0, 2, 4, 4, 5]
    large = context_mixing.Words(words, [5, 3, 1, 1, 1], 2, 6 * 10**9, 5, 3)
    assert large.before > 10_000 > small.before and large.last > small.last and large.slot_bits > small.slot_bits
    many = [n + 2 for n in range(100_000, 0, -1)]
    assert context_mixing.Words([b"%d" % n for n in many], many, 2, sum(many) + 2, 10**5, 0).coded > context_mixing.CODED
    tables = {"none": np.zeros(2 * small.code.nodes, dtype=int), "last": np.zeros(2 << small.slot_bits, dtype=int), "before": np.zeros(2 << small.slot_bits, dtype=int)}
    m = context_mixing.Model(small, tables | {f"spell{k}": np.zeros(2 << context_mixing.SPELL_BITS, dtype=int) for k in range(3)})
    assert abs(10 ** m.mass[1] - 2**-16) < 1e-12 and abs((10**m.mass).sum() - 1) < 1e-9


def test_weights_are_fitted_and_refined_in_short_texts():
    ws = context_mixing.Words([b"a", b"b"], [50, 50], 2, 102, 2, 0)
    tables = {"none": np.zeros(2 * ws.code.nodes, dtype=int), "last": np.zeros(2 << ws.slot_bits, dtype=int), "before": np.zeros(2 << ws.slot_bits, dtype=int)}
    tables |= {f"spell{k}": np.zeros(2 << context_mixing.SPELL_BITS, dtype=int) for k in range(3)}
    tables["none"][:4] = [30, 10, 7, 2]
    m = context_mixing.Model(ws, tables)
    n = 200
    zero = np.zeros(n, dtype=int)
    cost = m.mixed(zero + 1, zero, zero, zero, np.arange(n), 1)
    assert cost[-1] > cost[0] + 0.005  # weights move within the first 256 tokens
    random.seed(3)
    x, gate = np.array([random.choice([-2.0, 2.0]) for _ in range(20_000)]), np.array([i % 2 for i in range(20_000)])
    bit = np.array([random.random() < 1 / (1 + math.exp(-(0.3 + 0.9 * g) * v)) for v, g in zip(x, gate)]).astype(int)
    fitted = context_mixing.gated(np.full((2, 1), 0.5), gate, (x,), bit)
    assert abs(fitted[0, 0] - 0.3) < 0.05 and abs(fitted[1, 0] - 1.2) < 0.08
    spelled = [b"ab%d" % i for i in range(400)]
    _, slots, b = context_mixing.spelling(spelled)
    for k in range(3):
        np.add.at(tables[f"spell{k}"], 2 * slots[k] + b, 1)
    texts = [b"a b " * 20, b"b a a"]
    learned = context_mixing.Model(ws, tables, texts, spelled)
    assert not np.allclose(learned.weights, m.weights) and not np.allclose(learned.spell_weights, m.spell_weights)


def test_weights_are_fitted_on_all_training_texts(docs, rows, monkeypatch):
    stepped, seen = context_mixing.stepped, []
    monkeypatch.setattr(context_mixing, "stepped", lambda weights, start, sums: seen.append((weights, sums, stepped(weights, start, sums))) or seen[-1][2])
    monkeypatch.setattr(context_mixing, "FIT_TEXTS", 3)
    monkeypatch.setattr(context_mixing, "FIT_WORDS", 3)
    context_mixing.scores(docs).count()
    curved = [sums for _, sums, _ in seen]
    monkeypatch.setattr(context_mixing, "FIT_TEXTS", 10**6)
    monkeypatch.setattr(context_mixing, "FIT_BYTES", 10**9)
    monkeypatch.setattr(context_mixing, "FIT_WORDS", 10**6)
    context_mixing.scores(docs).count()
    assert len(seen) == 4 and all((s[:, :, 1:] != 0).any() for s in curved)
    for few, every in zip(seen[:2], seen[2:]):  # from few texts a step comes nearer to what all of them give
        busy = np.flatnonzero(every[1][:, 0, 1] > 200)
        assert len(busy) and np.abs(few[2] - every[2])[busy].max() < np.abs(few[0] - every[0])[busy].max()


def test_slopes_and_tables_that_are_given_out_in_time():
    random.seed(2)
    g = np.random.default_rng(0)
    w, gate, inputs, bit = g.normal(size=(16, 2)), g.integers(0, 3, 500), tuple(g.normal(size=(2, 500)).astype(np.float32)), g.integers(0, 2, 500)
    sums = context_mixing.slopes(w, gate.astype(np.int8), inputs, bit)
    x = np.stack(inputs, axis=1)
    for k in range(4):
        own = gate == k
        p = 1 / (1 + np.exp(-(x[own] @ w[k])))
        assert np.allclose(sums[k, :, 0], x[own].T @ (bit[own] - p), atol=1e-2) and np.allclose(sums[k, :, 1:], (x[own] * (p * (1 - p))[:, None]).T @ x[own], atol=1e-2)


def test_one_look_gives_odds_and_trust():
    g = np.random.default_rng(1)
    table = g.integers(0, 40, 2 << 19).astype(np.int32) * g.integers(0, 2, 2 << 19).astype(np.int32)
    slot, bit = g.integers(0, 1 << 19, 5000), g.integers(0, 2, 5000)
    odds, trust = context_mixing.left_out(table, slot, bit, 0.05)
    found = context_mixing.left_out_packed(table, 0.05)[2 * slot + bit]
    assert np.allclose(found, odds, atol=1e-5) and (context_mixing.trust_of(found) == trust).all()
    odds, trust = context_mixing.predictor(table, 0.05)
    found = context_mixing.packed(odds, trust)
    assert np.allclose(found, odds, atol=1e-5) and (context_mixing.trust_of(found) == trust).all()
    code = context_mixing.Code([5, 3, 2, 1])
    n, at = code.spread(np.array([3, 0, 2]))
    assert n.tolist() == [len(p) for p in (code.bits(np.array([k]))[0] for k in (3, 0, 2))] and at.tolist() == code.places(np.array([3, 0, 2]))[1].tolist()


def test_repeats_by_hand():
    random.seed(1)
    codes = np.array([random.randint(0, 3) for _ in range(60)])
    first = np.array([0] * 30 + [30] * 30)
    has, hit = context_mixing.repeats(codes, first)
    for i in range(60):
        j = next((j for j in range(i - 2, first[i] - 1, -1) if codes[j] == codes[i - 1]), None) if i - 1 >= first[i] else None
        assert has[i] == (j is not None) and hit[i] == (j is not None and codes[j + 1] == codes[i])


def test_byte_bpe_counts_words_of_a_task():
    texts = [b"a b  a\tc\x0bc\x0cd", b"", b" \n ", "\u00e9 \u00e9\u00a0x \u00e9\u00a0x \x1c".encode(), b"b"] * 700
    got = Counter()
    for out in byte_bpe.count_rows([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["t"])]):
        assert out.schema.types == [pa.binary(), pa.int64()]
        got.update(dict(zip(*(c.to_pylist() for c in out.columns))))
    assert got == Counter(w for t in texts for w in t.split())
    assert sum(out.num_rows for out in byte_bpe.count_rows([pa.RecordBatch.from_arrays([pa.array([b"one two"], pa.binary())], names=["t"])])) == 0
    assert list(byte_bpe.count_rows([])) == []  # a task without rows gives nothing


def test_byte_bpe_equals_library(docs, rows):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := library.encode_ordinary(x)), sha(",".join(map(str, ids)).encode()), sha(x.encode())) for i, x in rows)
    assert Counter(tuple(r) for r in byte_bpe.round_trip(docs, path, public.PATTERN).collect()) == want
    assert byte_bpe.round_trip(docs.limit(0), path, public.PATTERN).count() == 0


def test_a_plan_holds_the_ranks_once(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"qzq": 256}
    codec = byte_bpe.Codec(ranks)
    ids = spark.createDataFrame([("aqzq",)], ["w"]).select(codec.encode(F.col("w")).alias("ids"))
    assert ids._jdf.queryExecution().optimizedPlan().toString().count("qzq ->") <= 1
    assert ids._jdf.queryExecution().analyzed().toString().count("from_json") == 1


def test_segmentations_are_summed():
    pieces = ["", "▁", "a", "b", "ab", "▁a"]
    lattice = language_id.Lattices(["▁ab"], language_id.numbered(pieces))
    p = np.array([0.0, 0.1, 0.2, 0.3, 0.15, 0.25])
    assert abs(lattice.likelihood(p)[0] - (0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.25 * 0.3)) < 1e-12
    uses = lattice.expected(p, np.array([1.0]))
    total = 0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.25 * 0.3
    assert abs(uses[4] - 0.1 * 0.15 / total) < 1e-12 and abs(uses[3] - (0.1 * 0.2 * 0.3 + 0.25 * 0.3) / total) < 1e-12


def test_long_and_unlikely_words_are_scored_whole():
    pieces = ["", "\u2581", "a", "b", "ab", "ba", "\u2581a", "aab"]
    number = language_id.numbered(pieces)
    p = np.array([[1e-7, 0.1, 0.2, 0.3, 0.15, 0.05, 0.1, 0.1], [1e-9, 0.2, 0.1, 0.1, 0.1, 0.2, 0.2, 0.1]])
    words_ = ["ab", "aabba", "ab" * 30, "xyz" * 15, "é" * 400, "ba" * 23 + "q"]
    got = language_id.word_logs(words_, number, p)
    for w, row in zip(words_, got):
        t = "\u2581" + w
        for lang in range(2):  # logs of sums, by hand
            alpha = [0.0] + [-math.inf] * len(t)
            for e in range(1, len(t) + 1):
                ways = [alpha[a] + math.log(p[lang][number[t[a:e]]]) for a in range(max(0, e - 3), e) if number.get(t[a:e])]
                if not number.get(t[e - 1 : e]):
                    ways.append(alpha[e - 1] + math.log(p[lang][0]))
                top = max(ways)
                alpha[e] = top + math.log(sum(math.exp(x - top) for x in ways))
            assert abs(row[lang] - alpha[-1]) < 1e-6 * abs(alpha[-1])


def test_foreign_texts_go_and_unlearned_corpora_stay(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    rows_ = [(i, "the cat and the dog went out to the old house on the hill " * 3, "en") for i in range(12)] + [(100, "\u1401\u1403\u1405\u14c3\u1450" * 40, None), (101, "1 2 3", None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.in_known_language(docs, path).collect()} == set(range(12))
    assert {r.doc_id for r in language_id.in_known_language(docs.selectExpr("doc_id", "text", "cast(null as string) lang"), path).collect()} == {*range(12), 100}


def test_language_id(spark, docs):
    path = queries.tokenizer("piece_bpe_32k.model")
    model = language_id.learn(docs.where(language_id.fold_of("doc_id", 3) != 1), path)
    found = {r["row"]: r for r in language_id.predict(docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary)"), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 10**6}
    held = [i for i in truth if fold(i, 3) == 1]
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(found[10**6 + k].lang_pred == "und" and found[10**6 + k].score == 0 for k in (0, 1, 2, 6))
    assert all(0 <= r.score <= 1 for r in found.values())
    out = language_id.in_known_language(docs, path)
    assert out.columns == docs.columns and {10**6, 10**6 + 6}.isdisjoint({r.doc_id for r in out.collect()})
    unlearned = language_id.predict(docs.selectExpr("doc_id", "cast(text as binary)").where("text is not null"), language_id.learn(docs.limit(0), path))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    ids = [(i, np.array([*library.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")) for i, x in rows]
    want = Counter((i, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes()), len(x)) for i, x in ids for a in range(0, len(x), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows: dict = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def test_words_are_encoded_as_by_themselves(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library, habits = Tokenizer.from_file(path), packing.Habits(path)
    words_ = [x.encode() for x in ("one", "İstanbul", "naïve", "don't", "x1y2", "e\u0301te", "\uac00\u1112\u1161", "ﬁn", "a-b", "日本", "")] + [b"w%c" % (97 + i % 26) * (i % 7 + 1) for i in range(500)]
    got = packing.Encoder(path, habits).ids(words_)
    assert habits.words and all(got[w] == library.encode(w.decode(), add_special_tokens=False).ids for w in words_)
    told = json.load(open(path))
    told["normalizer"]["normalizers"].pop()  # upper case counts now: no short cuts
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told))
    assert not packing.Habits(str(other)).words and packing.Habits(str(other)).parts(b"A b") == [b"A b"]


def test_sum_of_squares_rule():
    random.seed(6)
    for _ in range(20):
        sizes, b = [random.randint(1, 12) for _ in range(60)], 12
        fills: list[int] = []
        for s, (w, o) in zip(sizes, packing.place(sizes, b)):
            cost = lambda f: sum(n * n for lv, n in Counter(f).items() if 0 < lv < b)
            options = {h: cost([*(x for x in fills), s] if h == 0 else fills[: (k := fills.index(h))] + [h + s] + fills[k + 1 :]) for h in {0, *fills} if h + s <= b}
            assert options[o] == min(options.values())
            if w == len(fills):
                fills.append(s)
            else:
                assert fills[w] == o
                fills[w] += s
    sizes = [random.randint(1, 2047) for _ in range(20000)]
    used = len({w for w, _ in packing.place(sizes)})
    assert sum(sizes) / (used * 2048) > 0.93


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, weak):
    from pyspark.sql import functions as F

    digest = (lambda c: F.length(c).cast("string")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_groups(docs, digest).collect()
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x)
    groups: dict = {}
    for i, x in rows:
        groups.setdefault(norm(x), []).append(i)
    low = lambda g: None if None in g else min(g)
    want = Counter((i, low(groups[norm(x)]), len(groups[norm(x)]), hashlib.sha256(norm(x).encode()).hexdigest()) for i, x in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_filter_and_empty(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", x) for _, x in rows})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_remembers(spark, tmp_path):
    first = spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string")
    later = spark.createDataFrame([(7, "a b"), (8, "d"), (4, "c")], "doc_id long, text string")
    exact_dedup.exact_groups(first, state=str(tmp_path))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(later, state=str(tmp_path)).collect()}
    assert got == {7: (5, 2, False), 8: (8, 1, True), 4: (4, 2, True)}


def test_dropping_keeps_columns_and_is_settled(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 2, "s", "t"), (1, "a b c d e f", "w", 1, "s", "t"), (2, "a b  c d e f", "v", 0, "s", "t")], "doc_id long, text string, __id string, __sha int, mark string, kept string")
    for drop in (exact_dedup.drop_copies, jaccard_join.drop_near_copies):
        assert [tuple(r) for r in drop(docs).collect()] == [(1, "a b c d e f", "w", 1, "s", "t")]


def near_by_hand(rows, n, t):
    sets = [frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []) for w in (words(x) for _, x in rows)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= t * len(a | sets[j]):
                up[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "t", "block"), [(3, Fraction(9, 10), 2048), (5, Fraction(4, 5), 3)])
def test_jaccard_join(spark, docs, rows, n, t, block):
    random.seed(7)
    base = [f"w{i}" for i in range(120)]
    copies = []
    for i in range(30):
        w = list(base)
        for _ in range(i % 6):
            w[random.randrange(120)] = f"v{random.random()}"
        copies.append((2 * 10**6 + i, " ".join(w)))
    every = rows + copies
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string")).selectExpr("*", "1 AS rid", "'k' AS first")
    got = jaccard_join.similar_groups(table, n, t, block=block).collect()
    sets, comp = near_by_hand(every, n, t)
    lows: dict = {}
    for (i, _), c in zip(every, comp):
        lows.setdefault(c, []).append(i)
    low = lambda g: min((x for x in g if x is not None), default=None)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), low(lows[c])) for (i, _), s, c in zip(every, sets, comp))
    kept = jaccard_join.drop_near_copies(table, n, t)
    assert kept.columns == table.columns and kept.count() == len({c if s else (i, x) for s, c, (i, x) in zip(sets, comp, every)})
    assert jaccard_join.similar_groups(table.limit(0), n, t).count() == 0


def test_signatures_of_many_sets_are_combined(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "MANY", 3)
    sigs = {node: np.array([1, 2 + node % 2, 100 + node], dtype=np.uint64).tobytes() for node in range(10, 20)}
    batch = pa.RecordBatch.from_arrays([pa.array(list(sigs)), pa.array(list(sigs.values()), pa.binary())], names=["node", "keys"])
    rows = [tuple(r.values()) for b in jaccard_join.key_rows([batch, batch]) for r in b.to_pylist()]
    groups: dict = {}
    for key, node in rows:
        groups.setdefault(key, []).append(node)
    assert set(groups[1]) == {10, None} == set(groups[2]) and set(groups[3]) == {11, None} and groups[110] == [10]
    pairs = {tuple(sorted(set(g) - {None})) for g in groups.values() if len(g) == 3}
    assert pairs == {(10, n) for n in range(11, 20)} | {(11, n) for n in (13, 15, 17, 19)}


def test_linked_against_brute_force():
    random.seed(8)
    for _ in range(40):
        t = random.choice([Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
        base = [[random.getrandbits(64) for _ in range(random.choice([5, 12, 30, 80, 600]))] for _ in range(3)]
        made = set()
        for _ in range(30):
            s = set(random.choice(base))
            for _ in range(random.choice([0, 1, 2, 4, 8])):
                s.discard(random.choice(sorted(s)))
                s.add(random.getrandbits(64))
            made.add(frozenset(s))
        sets = [np.array(sorted(s), dtype=np.uint64) for s in made]
        sizes = jaccard_join.Sizes(t)
        keys = [set(jaccard_join.signatures(s, sizes).tolist()) for s in sets]
        sketches = [jaccard_join.sketch_of(s, t) for s in sets]
        brute, fast = list(range(len(sets))), list(range(len(sets)))

        def find(up, i):
            while up[i] != i:
                i = up[i]
            return i

        raw = [set(s.tolist()) for s in sets]
        for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
            if len(raw[i] & raw[j]) >= t * len(raw[i] | raw[j]):
                assert keys[i] & keys[j]
                assert jaccard_join.may_link(jaccard_join.folded([sketches[i], sketches[j]]), [len(sets[i]), len(sets[j])], t)
                brute[find(brute, i)] = find(brute, j)
        for i, j in jaccard_join.linked(sets, t):
            assert len(raw[i] & raw[j]) >= t * len(raw[i] | raw[j])
            fast[find(fast, i)] = find(fast, j)
        pairs = {(find(brute, i), find(fast, i)) for i in range(len(sets))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage takes what the one before kept; nothing clean goes."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "exact_dedup", "ngram_jaccard", "packing"]
    now, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(now.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    kept = spark.read.parquet(str(tmp_path / "3"))
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in kept.collect()}
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_workers_give_memory_back(spark, docs, monkeypatch):
    given, used = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append("back"))
    assert list(common.frugal(lambda batches: (given.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert given == [1, 2, "back"]
    monkeypatch.undo()
    common.give_back()
    # every stage's Arrow functions do so
    kind, run = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *more, **named: used.append(f.__qualname__) or run(self, f, *more, **named))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "")
    assert len(used) >= 8 and all(x.startswith("frugal.") for x in used)
