import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.api import Extractor
from sievework.errors import WeightsError
from sievework.functions import constraints as k
from sievework.functions import heads
from sievework.functions import math as m
from sievework.functions import text as t
from sievework.operators import chunking, decode, spans
from sievework.operators.scorers import Lexical, Precomputed
from sievework.schema import AttributeGroup, Classification, SchemaBuilder
from sievework.sources import files
from sievework.streaming import extraction


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_tokens_and_offsets(spark):
    text = "See https://a.b/c?d or mail Bob@x.org, re-do_it @youé x_1"
    toks = one(spark, t.tokens(F.col("s")), s=text)
    assert toks == ["see", "https://a.b/c?d", "or", "mail", "bob@x.org", ",", "re-do_it", "@you", "é", "x_1"]
    both = one(spark, t.token_offsets(F.col("s")), s=text)
    assert [x.tok for x in both] == toks and all(text.lower()[x.start : x.end] == x.tok for x in both)
    assert one(spark, t.tokens(F.col("s"), max_len=2), s=text) == toks[:2]


def test_small_text_rules(spark):
    assert one(spark, F.array(*[t.punctuated(F.lit(x)) for x in ("", "a", "a!", "a.\n")]), s=1) == [".", "a.", "a!", "a.\n."]
    assert one(spark, t.byte_offset(F.col("s"), F.lit(2)), s="é😀b") == 6
    assert one(spark, t.span_text(F.col("s"), F.lit(1), F.lit(2)), s="é😀b") == "😀"
    toks = t.token_offsets(F.col("s"))
    assert one(spark, t.char_to_token(toks, F.lit(4)), s="ab cd") == 1 and one(spark, t.char_to_token(toks, F.lit(2)), s="ab cd") is None
    assert tuple(one(spark, t.token_to_char(toks, F.lit(0), F.lit(2)), s="ab cd")) == (0, 5)

    def by_hand(w):
        h = 0
        for b in w.encode():
            h = (h * 31 + b) % 2**64
        return h % 30522

    for w in ("hello", "x" * 34, "été"):
        assert one(spark, t.fallback_token_id(F.col("s")), s=w) == by_hand(w)


def test_array_math(spark):
    v = [0.5, -1.0, 2.0, 0.25]
    got = one(spark, m.layernorm(F.col("v")), v=v)
    assert np.allclose(got, heads.layernorm(np.array(v)))
    assert np.allclose(one(spark, m.softmax(F.col("v")), v=v), heads.softmax(np.array(v)))
    assert one(spark, m.argmax(F.col("v")), v=v) == 2
    assert abs(one(spark, m.gelu(F.col("a")), a=0.7) - heads.gelu(0.7)) < 1e-12


def test_span_rules_against_brute_force(spark):
    random.seed(2)
    rows = []
    for i in range(40):
        rows.append((i, [(a := random.randint(0, 9), a + random.randint(1, 4), random.random()) for _ in range(random.randint(0, 8))]))
    df = spark.createDataFrame(rows, f"id int, s array<{spans.SPAN}>")
    out = df.select("id", *[f(F.col("s")).alias(n) for n, f in (("g", spans.greedy), ("f", spans.resolve_flat), ("l", spans.longest), ("d", spans.dedupe))]).collect()
    meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
    for (_, given), r in zip(rows, sorted(out, key=lambda r: r.id)):
        kept = []
        for s in sorted(given, key=lambda s: -s[2]):
            if not any(meets(s, x) for x in kept):
                kept.append(s)
        assert [tuple(x) for x in r.g] == kept
        best = max(sum(s[2] for s in c) for n in range(len(given) + 1) for c in itertools.combinations(given, n) if not any(meets(x, y) for x, y in itertools.combinations(c, 2)))
        assert abs(sum(x.score for x in r.f) - best) < 1e-9
        inside = lambda s, o: o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2]
        assert [tuple(x) for x in r.l] == [s for s in given if not any(inside(s, o) for o in given)]
        assert len(r.d) == len({s[:2] for s in given})


def test_flat_prefers_more_spans_on_equal_totals():
    assert spans.flat([(0.6, 0, 4), (0.3, 0, 2), (0.3, 2, 4)]) == [(0.3, 0, 2), (0.3, 2, 4)]
    assert spans.flat([]) == []


def test_assignment_against_permutations():
    random.seed(3)
    for _ in range(100):
        rows = random.randint(1, 4)
        cost = [[random.random() for _ in range(random.Random(rows).randint(rows, 6))] for _ in range(rows)]
        got = spans.assignment(cost)
        best = min(sum(cost[i][p[i]] for i in range(rows)) for p in itertools.permutations(range(len(cost[0])), rows))
        assert len(set(got)) == rows and abs(sum(cost[i][j] for i, j in enumerate(got)) - best) < 1e-9


def test_kleene():
    assert k.k_and([None, False]) is False and k.k_and([None, True]) is None and k.k_or([None, True]) is True and k.k_or([]) is False
    assert k.k_implies(False, None) is True and k.k_iff(True, None) is None


def test_constraint_columns_agree_with_python(spark):
    labels = {"t": ["low", "mid", "high"]}
    cases = [k.label("t", "mid"), k.any_selected("t"), k.is_default("t"), k.at_least("t", 2), k.at_most("t", 1), k.exactly("t", 1), k.min_level("t", "mid"), k.max_level("t", "mid"), k.at_level("t", "low"), k.exactly_one_of([k.label("t", x) for x in labels["t"]]), k.implies(k.label("t", "low"), k.label("t", "mid")), k.iff(k.label("t", "low"), k.label("t", "high")), k.excludes(k.label("t", "low"), k.label("t", "high"))]
    rows = [(list(c), d) for n in range(3) for c in itertools.combinations(labels["t"], n) for d in (True, False)]
    df = spark.createDataFrame(rows, "sel array<string>, dec boolean")
    c = k.Columns(labels, {"t": F.col("sel")}, {"t": F.col("dec")}, {"t": F.array(*map(F.lit, labels["t"]))})
    for row, (sel, dec) in zip(df.select(*[x.column(c).alias(f"c{i}") for i, x in enumerate(cases)]).collect(), rows):
        state = k.State(labels, {"t": frozenset(sel)}, frozenset({"t"}) if dec else frozenset())
        assert list(row) == [x.evaluate(state) for x in cases], (sel, dec)
    assert k.all_of(cases).references() == {"t"}


def test_exact_decode():
    random.seed(4)
    labels = {"a": ["x", "y"], "b": ["p", "q"], "c": ["u", "v"]}
    for _ in range(50):
        options = {n: [(frozenset(s), random.random()) for s in ([], [v[0]], [v[1]], v)] for n, v in labels.items()}
        rules = [k.implies(k.label("a", "x"), k.label("b", "q")), k.excludes(k.label("b", "q"), k.label("c", "u")), k.exactly("c", 1)]
        best = None
        for combo in itertools.product(*options.values()):
            s = k.State(labels, {n: o for n, (o, _) in zip(options, combo)}, frozenset(labels))
            if all(r.satisfied(s) for r in rules):
                best = max(best or 0.0, sum(u for _, u in combo))
        got = k.decode(options, rules, labels)
        assert abs(got.score - best) < 1e-9 and got.exact
    assert k.decode({"a": [(frozenset({"x"}), 1.0)]}, [k.not_(k.label("a", "x"))], labels) is None


def test_classification_ties_and_fallback():
    c = Classification("t", ("a", "b"))
    assert decode.classification([1.0, 1.0], c, decode.Options())[0][0] == "b" and decode.classification([1.0, 1.0], c, decode.Options(path="span"))[0][0] == "a"
    many = Classification("t", ("a", "b"), True)
    assert [x for x, _ in decode.classification([-3.0, -2.0], many, decode.Options())] == ["b"] and decode.classification([-3.0, -2.0], many, decode.Options(path="span")) == []


def test_endpoints():
    found, scored = {"p": [], "q": [(0.9, 1, 2)]}, {"role": [(3.0, 4, 5)]}
    assert decode.endpoints("p", found, scored, 0.5) == [] and decode.endpoints("other", found, scored, 0.5) == [(1, 2)]
    assert decode.endpoints("role", {"p": []}, scored, 0.5) == [(4, 5)]


RULES = Lexical(entities=(("person", "[A-Z][a-z]+", 3.0), ("company", "[A-Z]{3,}", 4.0), ("price", r"\$[0-9]+", 2.0), ("item", "[a-z]+[0-9]", 2.0)), keywords=(("tone", "glad", "good", 3.0), ("tone", "sad", "bad", 3.0), ("mood", "up", "happy", 3.0), ("mood", "down", "sad", 3.0)), width=2)


def test_extract_all_tasks(spark):
    schema = (
        SchemaBuilder().entities(["person", "company"]).classification("tone", ["glad", "sad"])
        .structure("sale", "natural", "item").field("item", dtype="str").field("price", dtype="str", threshold=0.3).done()
        .relation("works_for", fields=("person", "company")).attributes({"mood": AttributeGroup(("up", "down"), applies_to=("person",))}).build()
    )
    texts = files.from_texts(spark, ["happy Ann works for ACME , good ; box1 costs $5 and box2 costs $7", None, ""])
    rows = [r.result for r in Extractor(RULES).extract(texts, schema).orderBy("doc_id").collect()]
    r = rows[0]
    assert [x.text for x in r.entities.person] == ["Ann"] and r.entities.person[0].mood.label == "up" and [x.text for x in r.entities.company] == ["ACME"]
    assert r.tone == "glad" and [tuple(p) for p in r.relation_extraction.works_for] == [("Ann", "ACME")]
    assert [(x["item"], x.price) for x in r.sale] == [(["box1"], ["$5"]), (["box2"], ["$7"])]
    assert rows[1].entities is None and rows[2].entities.person == []


def test_long_texts_are_windowed(spark):
    words = ["w"] * 1000
    for at in (5, 350, 700, 999):
        words[at] = "Ann"
    text = " ".join(words)
    df = files.from_texts(spark, [text])
    got = Extractor(RULES).extract_entities(df, ["person"], include_spans=True, include_confidence=True).first().result.entities.person
    assert [text[x.start : x.end] for x in got] == ["Ann"] * 4 and [x.start for x in got] == [2 * 5, 2 * 350 + 2, 2 * 700 + 4, 2 * 999 + 6]
    assert Extractor(RULES).extract_entities(df, ["person"]).first().result.entities.person == ["Ann"]


def test_windows_column_matches_texts(spark):
    assert [tuple(x) for x in one(spark, chunking.windows(F.col("n")), n=900)] == [(0, 0, 384), (1, 320, 704), (2, 640, 900)]
    assert [tuple(x)[:3] for x in one(spark, chunking.windows(F.col("n")), n=0)] == [(0, 0, 0)]
    text = " ".join(f"w{i}" for i in range(900))
    assert [tuple(x)[1:3] for x in one(spark, chunking.chunks()(F.col("s")), s=text)] == [(0, 384), (320, 704), (640, 900)]


def test_precomputed_scores():
    scorer = Precomputed((("p", ((2.0, 0, 1), (-1e4, 1, 2), (0.1, 0, 2))),))
    got = decode.document("aa bb", [("aa", 0, 2), ("bb", 3, 5)], SchemaBuilder().entity("p").build(), scorer, decode.Options())
    assert [(x["text"], x["start"]) for x in got["entities"]["p"]] == [("aa", 0)]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    schema = SchemaBuilder().entities(["person", "price"]).build()
    extraction.extract_to(extraction.texts(spark, str(tmp_path / "in")), Extractor(RULES), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    streamed = {r.doc_id: r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r.doc_id: r.result for r in Extractor(RULES).extract(docs, schema).collect()}


def test_weights(tmp_path):
    a = {"encoder.x": np.arange(6, dtype="f4").reshape(2, 3), "classifier.b": np.zeros(2, dtype="f8")}
    files.write_weights(tmp_path / "w.safetensors", a)
    got = files.read_weights(*files.weight_files(tmp_path))
    assert all(np.array_equal(a[n], got[n]) for n in a) and files.module_of("encoder.x") == "encoder"
    with pytest.raises(WeightsError):
        files.weight_header(tmp_path / "none")
    assert files.encoder_family("x-deberta-v3") == "deberta_v3" and files.encoder_family("bert") == "bert"


def test_config(tmp_path):
    c = files.ModelConfig("m", hidden_size=64, num_attention_heads=4)
    c.to_file(tmp_path / "c.json")
    assert files.ModelConfig.from_file(tmp_path / "c.json") == c


def test_heads_shapes():
    g = np.random.default_rng(0)
    x, q = g.normal(size=(5, 8)), g.normal(size=(3, 8))
    w = lambda *s: g.normal(size=s)
    assert heads.attention(x, x, x, 2, reach=1).shape == (5, 8) and heads.rotary(x).shape == (5, 8)
    assert np.allclose(np.linalg.norm(heads.rotary(x)), np.linalg.norm(x))
    two = lambda a, b, c: ((w(b, a), w(b)), (w(c, b), w(c)))
    spans_ = heads.span_states(x, 3, {"start": two(8, 8, 8), "end": two(8, 8, 8), "out": two(16, 8, 8)})
    assert heads.span_scores(spans_, q).shape == (3, 5, 3)
    s, e = np.array([0, 1]), np.array([2, 5])
    start = heads.marginals(np.vstack([x, x[:1]]), q)
    inside = heads.marginals(x, q)
    logits = heads.candidate_logits(heads.pooled(x, s, e), q, np.zeros((3, 2)), start, start, inside, s, e)
    assert np.allclose(logits[1, 1], q[1] @ heads.pooled(x, s, e)[1] / np.sqrt(8) + start[1, 1] + start[1, 5] + inside[1, 1:5].sum() / 2)
    assert heads.gather(x, [0, None, 9]).tolist()[1:] == [[0.0] * 8] * 2


def test_offsets_are_made_and_checked_a_few_texts_at_a_time():
    texts = pa.array([None, "", *["a b@c.de F"] * 250])
    made = list(t._token_offsets.func(iter([texts])))
    assert max(map(len, made)) == t.HELD and sum(map(len, made)) == len(texts)
    rows = [row for part in made for row in part.to_pylist()]
    assert rows[:2] == [None, []] and rows[2] == rows[-1] == [{"tok": "a", "start": 0, "end": 1}, {"tok": "b@c.de", "start": 2, "end": 8}, {"tok": "F", "start": 9, "end": 10}]
    reports = list(t.offset_rows(iter([pa.record_batch([pa.array(range(len(texts))), texts], names=["id", "low"])])))
    assert max(r.num_rows for r in reports) == t.HELD
    seen = [x for r in reports for x in r.to_pylist()]
    assert [x["id"] for x in seen] == list(range(len(texts))) and not any(x["wrong"] for x in seen)
    assert [(x["n_tokens"], x["covered"]) for x in seen[:3]] == [(None, None), (0, None), (3, 8)]


def test_misplaced_tokens_are_counted():
    some, rows = next(t.offsets_in(pa.array(["ab cd é", None, "x yz"])))
    assert t.misplaced(some.to_pylist(), rows) == [0, 0, 0]
    assert t.misplaced(["ab ce é", None, "x y "], rows) == [1, 0, 1]
    longer = pa.StructArray.from_arrays([rows.values.field(0), rows.values.field(1), pa.array([2, 5, 7, 1, 3], pa.int32())], names=["tok", "start", "end"])
    assert t.misplaced(some.to_pylist(), pa.ListArray.from_arrays(rows.offsets, longer)) == [0, 0, 1]
