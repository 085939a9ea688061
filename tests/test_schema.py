import pytest

from sievework.errors import CapabilityError, ChunkingError, PatternError, SchemaError, ValidationError
from sievework.operators import chunking
from sievework.operators.scorers import Precomputed
from sievework.plans import prompts
from sievework.schema import AttributeGroup, Cardinality, Classification, RegexValidator, Schema, SchemaBuilder


def full():
    return (
        SchemaBuilder().entities({"person": "a human", "city": ""}).entity("code", threshold=0.7)
        .classification("tone", ["glad", "sad"], multi_label=True, label_descriptions={"glad": "in good heart"}, prompt="how", examples=[("hey", "glad")])
        .structure("job", "natural", "who").field("who", dtype="str", cardinality="required_one").field("where", choices=["here"], validators=[RegexValidator("[a-z]+")]).done()
        .relation("lives_in", fields=("person", "city"), threshold=0.4).attributes({"mood": AttributeGroup(("up", "down"), applies_to=("person",), qualify_labels=True)}).build()
    )


def test_round_trip_is_lossless():
    s = full()
    assert Schema.from_json(s.to_json()) == s
    assert [t.value for t in s.task_types()] == ["entities", "classifications", "json_structures", "relations"]


def test_short_forms():
    s = Schema.from_dict({"entities": {"a": "x"}, "classifications": {"t": ["p", "q"], "u": {"labels": ["r"], "prompt": 7, "examples": "no"}}, "json_structures": {"k": ["f"]}, "relations": ["r"]})
    assert s.entities[0].description == "x" and s.classifications[1] == Classification("u", ("r",)) and s.structures[0].fields[0].name == "f" and s.relations[0].fields == ("head", "tail")


@pytest.mark.parametrize(
    "make",
    [
        lambda: SchemaBuilder().build(),
        lambda: SchemaBuilder().entity("").build(),
        lambda: SchemaBuilder().entity("a", threshold=1.5).build(),
        lambda: SchemaBuilder().classification("t", []).build(),
        lambda: SchemaBuilder().structure("s").done().build(),
        lambda: SchemaBuilder().structure("s", "natural", "x").field("f").done().build(),
        lambda: SchemaBuilder().structure("s").field("f", dtype="list", cardinality="zero_or_one").done().build(),
        lambda: SchemaBuilder().attributes({"g": AttributeGroup(("a",))}),
        lambda: SchemaBuilder().entity("e").attributes({"text": AttributeGroup(("a",))}),
        lambda: SchemaBuilder().entity("e").attributes({"g": AttributeGroup(("a", "a"))}),
        lambda: SchemaBuilder().entity("e").attributes({"g": AttributeGroup(("e",))}),
        lambda: SchemaBuilder().entity("e").attributes({"g": AttributeGroup(("a",), applies_to=("x",))}),
    ],
)
def test_rejected(make):
    with pytest.raises(SchemaError):
        make()


def test_validators():
    assert RegexValidator("a|ab").accepts("a") and not RegexValidator("a|ab").accepts("ab")  # leftmost match must be the whole
    assert RegexValidator("b", "partial").accepts("abc") and not RegexValidator("b", "partial", exclude=True).accepts("abc")
    with pytest.raises(PatternError):
        RegexValidator("(")
    with pytest.raises(ValidationError):
        RegexValidator("a", "some")


def test_cardinality():
    assert Cardinality.REQUIRED_ONE.scalar and not Cardinality.REQUIRED_ONE.optional and Cardinality.ZERO_OR_MORE.optional


def test_prompts_and_query_rows():
    s = full().expanded()
    assert prompts.entity_prompt(s) == "entities [DESCRIPTION] person: a human"
    assert prompts.classification_prompt(s.classifications[0]) == "tone: how [DESCRIPTION] glad: in good heart [EXAMPLE] hey [OUTPUT] glad"
    rows = prompts.query_rows(s)
    assert [r[4] for r in rows if r[1] == "entities"] == ["person", "city", "code", "mood: down", "mood: up"]
    assert [r[6] for r in rows if r[1] == "entities"] == [False, False, False, True, True]
    assert prompts.structure_tokens(s.structures[0])[:5] == ["(", "[P]", "job", "(", "[C]"]
    assert prompts.sequence(s, ["w"])[-2:] == ["[SEP_TEXT]", "w"] and prompts.sequence(s, []).count("[SEP_STRUCT]") == 3
    assert prompts.task_of_prompt("tone: how", ["to", "tone"]) == "tone" and prompts.task_of_prompt("toned", ["tone"]) == "tone" and prompts.task_of_prompt("x", ["tone"]) is None


def test_missing_head_is_named():
    with pytest.raises(CapabilityError, match="precomputed.*relations"):
        Precomputed().require(["entities", "relations"])


def test_window_sizes():
    assert chunking.window_sizes() == (384, 64) and chunking.window_sizes(100) == (36, 18) and chunking.window_sizes(10) == (32, 16)
    with pytest.raises(ChunkingError):
        chunking.checked(5, 5)
    with pytest.raises(ChunkingError):
        chunking.checked(0, 0)


def test_merge_results():
    text = "aa bb cc dd"
    span = lambda a, b, c: {"text": text[a:b], "start": a, "end": b, "confidence": c}
    first = {"entities": {"x": [span(3, 5, 0.6)], "y": []}, "tone": {"label": "p", "confidence": 0.5}, "rel": {"r": []}}
    second = {"entities": {"x": [{"text": "bb", "start": 0, "end": 2, "confidence": 0.8}, {"text": "dd", "start": 6, "end": 8, "confidence": 0.7}], "y": []}, "tone": {"label": "q", "confidence": 0.5}, "rel": {"r": []}}
    got = chunking.merge_results(text, [0, 3], [first, second])
    assert got["entities"]["x"] == [span(3, 5, 0.8), span(9, 11, 0.7)] and got["entities"]["y"] == []
    assert got["tone"]["label"] == "q" and got["rel"] == {"r": []}
    assert chunking.merge_results(text, [0, 3], [first, second], confidence=False, spans=False)["entities"]["x"] == ["bb", "dd"]
    pairs = [{"head": {"text": "a", "confidence": 0.1}}, {"head": {"text": "a", "confidence": 0.9}}, {"head": {"text": "b", "confidence": 0.2}}]
    assert chunking.deduped(pairs) == [pairs[1], pairs[2]]
