"""From a schema to what a scorer is asked: prompts, query rows and the shape of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from sievework.schema import Classification, Mode, Relation, Schema, Structure

#: Marks of a prompt sequence.
PROMPT, ENTITY, LABEL, CHILD, ROLE = "[P]", "[E]", "[L]", "[C]", "[R]"
DESCRIPTION, EXAMPLE, OUTPUT, STRUCT_END, TEXT_START = "[DESCRIPTION]", "[EXAMPLE]", "[OUTPUT]", "[SEP_STRUCT]", "[SEP_TEXT]"
MARKS = (ENTITY, LABEL, CHILD, ROLE)


def entity_prompt(schema: Schema) -> str:
    told = "".join(f" {DESCRIPTION} {e.name}: {e.description}" for e in schema.entities if e.description)
    return f"entities{told}"


def entity_tokens(schema: Schema) -> list[str]:
    return ["(", PROMPT, entity_prompt(schema), "(", *[x for e in schema.entities for x in (ENTITY, e.name)], ")", ")"]


def classification_prompt(c: Classification) -> str:
    out = c.task if not c.prompt else f"{c.task}: {c.prompt}"
    out += "".join(f" {DESCRIPTION} {label}: {d}" for label, d in c.label_descriptions if label in c.labels)
    return out + "".join(f" {EXAMPLE} {a} {OUTPUT} {b}" for a, b in c.examples)


def classification_tokens(c: Classification) -> list[str]:
    return ["(", PROMPT, classification_prompt(c), "(", *[x for y in c.labels for x in (LABEL, y)], ")", ")"]


def structure_tokens(s: Structure) -> list[str]:
    parts = [x for f in s.fields for x in ((CHILD, f.name, DESCRIPTION, f"{f.name}: {f.description}") if f.description else (CHILD, f.name))]
    return ["(", PROMPT, s.name, "(", *parts, ")", ")"]


def relation_tokens(r: Relation) -> list[str]:
    return ["(", PROMPT, r.name, "(", *[x for f in r.fields for x in (ROLE, f)], ")", ")"]


@dataclass(frozen=True)
class Group:
    number: int
    kind: str
    task: str
    tokens: tuple[str, ...]

    def markers(self) -> list[tuple[str, int]]:
        """(name, ordinal among the marks) of each query; descriptions and brackets are no marks."""
        marked = [i for i, t in enumerate(self.tokens) if t in MARKS and i > 2]
        return [(self.tokens[i + 1], k) for k, i in enumerate(marked)]


def encode(schema: Schema) -> list[Group]:
    """Groups in fixed order: entities together, then each classification, structure and relation."""
    rows = [("entities", "entities", entity_tokens(schema))] if schema.entities else []
    rows += [("classifications", c.task, classification_tokens(c)) for c in schema.classifications]
    rows += [("json_structures", s.name, structure_tokens(s)) for s in schema.structures]
    rows += [("relations", r.name, relation_tokens(r)) for r in schema.relations]
    return [Group(i, kind, task, tuple(tokens)) for i, (kind, task, tokens) in enumerate(rows)]


def sequence(schema: Schema, words: list[str]) -> list[str]:
    """The token sequence that a model would read."""
    out: list[str] = []
    for i, g in enumerate(encode(schema)):
        out += [STRUCT_END] * (i > 0) + list(g.tokens)
    return [*out, TEXT_START, *words]


def query_rows(schema: Schema) -> list[tuple]:
    """(group_id, task_type, task, query_id, name, slot, hidden)."""
    out: list[tuple] = []
    for g in encode(schema):
        for name, slot in g.markers():
            out.append((g.number, g.kind, g.task, len(out), name, slot, g.kind == "entities" and name in schema.hidden))
    return out


QUERY_SCHEMA = "group_id int, task_type string, task string, query_id int, name string, slot int, hidden boolean"


def task_of_prompt(prompt: str, tasks: list[str]) -> str | None:
    """The longest task that the prompt begins with, followed by its end, a colon or a blank; else the first that it begins with."""
    whole = [t for t in tasks if prompt.startswith(t) and prompt[len(t) : len(t) + 1] in ("", ":", " ")]
    return max(whole, key=len) if whole else next((t for t in tasks if prompt.startswith(t)), None)


def span_type(confidence: bool, spans: bool, attributes: list[tuple[str, bool]] = ()) -> T.DataType:
    """Bare text, or a struct with what was asked for; spans with attributes are always structs."""
    if not (confidence or spans or attributes):
        return T.StringType()
    label = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])
    parts = [T.StructField("text", T.StringType())]
    parts += [T.StructField("confidence", T.DoubleType())] * confidence
    parts += [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())] if spans else []
    parts += [T.StructField(name, T.ArrayType(label) if multi else label) for name, multi in attributes]
    return T.StructType(parts)


def result_type(schema: Schema, confidence: bool, spans: bool, bare_pairs: bool = False) -> T.StructType:
    """The struct that extraction gives for a document; bare_pairs: relations as [head, tail]."""
    plain = span_type(confidence, spans)
    with_attributes = span_type(confidence, spans, [(n, g.multi_label) for n, g in schema.attributes])
    parts = []
    if schema.entities:
        parts.append(T.StructField("entities", T.StructType([T.StructField(e.name, T.ArrayType(with_attributes)) for e in schema.entities if e.name not in schema.hidden])))
    for c in schema.classifications:
        one = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]) if confidence else T.StringType()
        parts.append(T.StructField(c.task, T.ArrayType(one) if c.multi_label else one))
    for s in schema.structures:
        fields = [T.StructField(f.name, T.ArrayType(plain) if s.mode is Mode.NATURAL or not f.effective_cardinality.scalar else plain) for f in s.fields]
        parts.append(T.StructField(s.name, T.ArrayType(T.StructType(fields))))
    if schema.relations:
        pair = T.ArrayType(plain) if bare_pairs else T.StructType([T.StructField("head", plain), T.StructField("tail", plain)])
        parts.append(T.StructField("relation_extraction", T.StructType([T.StructField(r.name, T.ArrayType(pair)) for r in schema.relations])))
    return T.StructType(parts)
