"""Options of the public call, counted forms, scorers with weights, and rules that were once wrong."""

import numpy as np
import pytest

from sievework.api import Extractor, tokenise
from sievework.errors import ValidationError
from sievework.functions import heads
from sievework.functions.text import token_id, word_count, word_pattern
from sievework.operators import chunking, decode
from sievework.operators.scorers import Lexical, LinearHeads, Precomputed, Scorer
from sievework.schema import AttributeGroup, Classification, Field, Mode, Schema, SchemaBuilder, Structure

RULES = Lexical(entities=(("name", "[A-Z][a-z]+", 2.0), ("year", "[0-9]+", 1.0)), width=1)


def test_a_first_confidence_of_nought_counts():
    assert chunking.confidence_of([{"c": 1, "confidence": 0.0}, {"confidence": 0.7}]) == 0.0
    assert chunking.confidence_of([{"c": []}, {"confidence": 0.7}]) == 0.7 and chunking.confidence_of("x") == 0.0


def test_white_space_is_that_of_unicode(spark):
    df = spark.createDataFrame([("a\x1cb c d",)], "text string")
    cut = df.select(chunking.chunks()("text").alias("c"), word_count(df.text).alias("n")).first()
    assert cut.n == 3 == cut.c[0].end_word and len(word_pattern().findall("a\x1cb c d")) == 3


def test_offsets_in_bytes_and_bare_pairs(spark):
    df = spark.createDataFrame([("Zoé met Ann in 1999",), (None,)], "text string")
    schema = SchemaBuilder().entities(["name", "year"]).relation("met", fields=("name", "year")).build()
    names = Lexical(entities=(("name", "[A-Z]\\w+", 2.0), ("year", "[0-9]+", 1.0)), width=1)
    spans = lambda unit: [(x.text, x.start, x.end) for x in Extractor(names, offset_unit=unit).extract(df, schema, include_spans=True).first().result.entities.name]
    assert spans("character") == [("Zoé", 0, 3), ("Ann", 8, 11)] and spans("byte") == [("Zoé", 0, 4), ("Ann", 9, 12)]
    rows = Extractor(names, bare_pairs=True).extract(df, schema).collect()
    assert ["Ann", "1999"] in rows[0].result.relation_extraction.met and rows[1].result.entities is None
    with pytest.raises(ValidationError):
        Extractor(names, path="other")


def test_task_thresholds_are_an_option():
    c = Classification("k", ("a", "b"), multi_label=True, threshold=0.9)
    assert len(decode.classification([1.0, 1.0], c, decode.Options(0.5))) == 2
    assert len(decode.classification([1.0, 0.5], c, decode.Options(0.5, task_thresholds=True))) == 1
    assert decode.classification([1.0, 0.5], c, decode.Options(0.5, path="span", task_thresholds=True)) == []


def test_counted_instances():
    text = "Ann 1990 Bob Cid 1991 1992"
    toks = tokenise(text)
    schema = SchemaBuilder().relation("born", fields=("name", "year")).structure("person").field("name", dtype="str").field("year").done().build()
    found = decode.document(text, toks, schema, RULES, decode.Options(path="span"))
    assert [(p["head"]["text"], p["tail"]["text"]) for p in found["relation_extraction"]["born"]] == [("Ann", "1990"), ("Cid", "1991")]
    assert [([x["text"] for x in r["name"]], [x["text"] for x in r["year"]]) for r in found["person"]] == [(["Ann"], ["1990"]), (["Bob"], []), (["Cid"], ["1991", "1992"])]
    assert decode.document("", [], schema, RULES, decode.Options(path="span")) == {"person": [], "relation_extraction": {"born": []}}


def test_records_ask_the_scorer_for_nearness():
    class Far(Lexical):
        def near(self, structure, anchor, candidate):
            return abs(anchor[1] - candidate[1]) * 5.0

    s = Structure("p", (Field("name"), SchemaBuilder().structure("x").field("year", dtype="str").made.fields[0]), Mode.NATURAL, "name")
    scored = {"name": [(2.0, 0, 1), (2.0, 3, 4)], "year": [(2.0, 1, 2), (2.0, 4, 5)]}
    given = lambda scorer: [r["year"][0][1] for r in decode.anchored(scorer, s, scored, lambda h: "", decode.Options(0.1))]
    assert given(Lexical()) == [1, 4] and given(Far()) == [4, 1]


def test_heads_with_weights_answer_every_question():
    scorer = LinearHeads.seeded()
    text = "Ann Smith was born in Rome in 1990"
    schema = SchemaBuilder().entities(["person", "city"]).classification("topic", ["life", "sport"]).structure("person_card").field("name", dtype="str").done().relation("born_in").attributes({"mood": AttributeGroup(("glad", "sad"))}).build()
    for path in ("span", "boundary"):
        found = decode.document(text, tokenise(text), schema, scorer, decode.Options(0.3, path=path))
        assert set(found) == {"entities", "topic", "person_card", "relation_extraction"} and found == decode.document(text, tokenise(text), schema, scorer, decode.Options(0.3, path=path))
    logits = scorer.spans(text, tokenise(text), ["person"])["person"]
    assert len(logits) == sum(min(4, 8 - a) for a in range(8)) and isinstance(scorer, Scorer)
    words, w = scorer.states([x[0] for x in tokenise(text)]), scorer.weights["span"]
    states = heads.span_states(words, 4, w)
    by_hand = heads.linear(heads.relu(heads.linear(heads.relu(np.concatenate([heads.mlp(words[2], *w["start"]), heads.mlp(words[4], *w["end"])])), *w["out"][0])), *w["out"][1])
    assert np.allclose(states[2, 2], by_hand) and np.isclose(dict(((a, b), x) for x, a, b in logits)[2, 5], by_hand @ scorer.meaning("person"))
    assert decode.document("", [], schema, scorer, decode.Options(path="boundary"))["entities"] == {"person": [], "city": []}


def test_instances_of_queries_differ_and_an_explicit_span_is_scored_by_itself():
    scorer = LinearHeads.seeded(seed=3)
    toks = tokenise("one two three four")
    a, b = (scorer.instance("", toks, "t", ["f"], k, {})["f"] for k in (0, 1))
    assert [x[1:] for x in a] == [x[1:] for x in b] and a != b
    content = heads.layernorm(scorer.states(["two", "three"]).mean(axis=0))
    q = scorer.meaning("glad")
    film = heads.film_match(content[None], q[None], scorer.weights["film"])[0, 0]
    assert np.isclose(scorer.attribute(toks, (1, 3), "mood", "glad"), q @ content / np.sqrt(8) + film)


def test_given_logits_are_resolved_flat():
    """The best set of spans that do not overlap, not the best span first."""
    given = Precomputed((("kind", ((1.0, 0, 2), (1.2, 1, 3), (1.0, 2, 4), (-20000.0, 0, 1))),))
    schema = Schema(entities=SchemaBuilder().entities(["kind"]).build().entities)
    text = "a b c d"
    flat = decode.document(text, tokenise(text), schema, given, decode.Options(0.5))["entities"]["kind"]
    best = decode.document(text, tokenise(text), schema, given, decode.Options(0.5, path="span"))["entities"]["kind"]
    assert [x["text"] for x in flat] == ["a b", "c d"] and [x["text"] for x in best] == ["b c"]


def test_tokens_in_python_are_those_of_the_jvm(spark):
    from pyspark.sql import functions as F

    from sievework.functions.text import token_offsets, tokens

    odd = ["a_b-c x-  y", "mail me@ex.org, or @you", "see www.x.y/z?q http://a.b c", "naïve Straße ½ ² ٣ a\u0301 b\u200dc", "x\x1cy\x85z\u2028w\u3000v", "a@b", "é@x.org .@", "ⓐⓑ Ⅷ 𝟗 ‿", "", "a" * 50 + "@"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select(tokens(F.col("t")).alias("jvm"), token_offsets(F.col("t")).alias("py"))
    assert all(r.jvm == [x.tok for x in r.py] for r in rows.collect())


def test_token_ids_agree(spark):
    from sievework.functions.text import fallback_token_id

    words = ["a", "zebra", "é", "日本", "x" * 40]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in rows.select(fallback_token_id(rows.w)).collect()] == [token_id(w) for w in words]
