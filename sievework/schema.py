"""The extraction schema: what to look for. Declared by the user, checked on the driver, never inferred.

Order of declaration is kept everywhere; it fixes the order of queries and of results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from sievework.errors import PatternError, SchemaError, ValidationError


class Dtype(str, Enum):
    STR = "str"
    LIST = "list"


class Cardinality(str, Enum):
    REQUIRED_ONE = "required_one"
    ZERO_OR_ONE = "zero_or_one"
    ONE_OR_MORE = "one_or_more"
    ZERO_OR_MORE = "zero_or_more"

    @property
    def scalar(self) -> bool:
        return self in (Cardinality.REQUIRED_ONE, Cardinality.ZERO_OR_ONE)

    @property
    def optional(self) -> bool:
        return self in (Cardinality.ZERO_OR_ONE, Cardinality.ZERO_OR_MORE)

    @classmethod
    def of(cls, dtype: Dtype) -> Cardinality:
        return cls.ZERO_OR_ONE if dtype is Dtype.STR else cls.ZERO_OR_MORE


class Mode(str, Enum):
    DEFAULT = "default"
    NATURAL = "natural"


class TaskType(str, Enum):
    ENTITIES = "entities"
    CLASSIFICATIONS = "classifications"
    STRUCTURES = "json_structures"
    RELATIONS = "relations"


#: Names that results use themselves.
RESERVED = ("text", "confidence", "start", "end")


def _unit(value: float | None, what: str) -> None:
    if value is not None and not 0.0 <= value <= 1.0:
        raise ValidationError(f"{what}: threshold {value} is not between 0 and 1")


def _named(name: str, what: str) -> None:
    if not name or not name.strip():
        raise ValidationError(f"{what} needs a name")


@dataclass(frozen=True)
class RegexValidator:
    """Keeps spans that match. full: the leftmost match must be the whole span; partial: match anywhere."""

    pattern: str
    mode: str = "full"
    exclude: bool = False

    def __post_init__(self):
        if self.mode not in ("full", "partial"):
            raise ValidationError(f"validator mode {self.mode!r} is neither full nor partial")
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise PatternError(f"{self.pattern!r}: {e}") from e

    def accepts(self, text: str) -> bool:
        found = re.search(self.pattern, text)
        ok = found is not None and (self.mode == "partial" or found.span() == (0, len(text)))
        return ok != self.exclude


@dataclass(frozen=True)
class Entity:
    name: str
    description: str | None = None
    dtype: Dtype = Dtype.LIST
    threshold: float | None = None


@dataclass(frozen=True)
class Classification:
    task: str
    labels: tuple[str, ...]
    multi_label: bool = False
    threshold: float = 0.5
    label_descriptions: tuple[tuple[str, str], ...] = ()
    prompt: str | None = None
    examples: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_json(cls, task: str, value: Any) -> Classification:
        """A bare list of labels, or a dict; optional keys of a wrong shape are passed over."""
        if isinstance(value, (list, tuple)):
            return cls(task, tuple(map(str, value)))
        pairs = value.get("label_descriptions")
        shown = value.get("examples")
        return cls(
            task,
            tuple(map(str, value.get("labels", ()))),
            bool(value.get("multi_label", False)) if isinstance(value.get("multi_label", False), bool) else False,
            value["cls_threshold"] if isinstance(value.get("cls_threshold"), (int, float)) else 0.5,
            tuple((k, v) for k, v in pairs.items() if isinstance(v, str)) if isinstance(pairs, Mapping) else (),
            value["prompt"] if isinstance(value.get("prompt"), str) else None,
            tuple((str(x[0]), str(x[1])) for x in shown if isinstance(x, (list, tuple)) and len(x) == 2) if isinstance(shown, (list, tuple)) else (),
        )


@dataclass(frozen=True)
class Field:
    name: str
    dtype: Dtype = Dtype.LIST
    cardinality: Cardinality | None = None
    choices: tuple[str, ...] = ()
    description: str | None = None
    threshold: float | None = None
    validators: tuple[RegexValidator, ...] = ()

    @property
    def effective_cardinality(self) -> Cardinality:
        return self.cardinality or Cardinality.of(self.dtype)


@dataclass(frozen=True)
class Structure:
    name: str
    fields: tuple[Field, ...] = ()
    mode: Mode = Mode.DEFAULT
    anchor: str | None = None
    max_instances: int = 1


@dataclass(frozen=True)
class Relation:
    name: str
    description: str | None = None
    threshold: float | None = None
    fields: tuple[str, ...] = ("head", "tail")


@dataclass(frozen=True)
class AttributeGroup:
    labels: tuple[str, ...]
    multi_label: bool = False
    threshold: float = 0.5
    applies_to: tuple[str, ...] | None = None
    qualify_labels: bool = False

    def prompts(self, group: str) -> list[str]:
        return [f"{group}: {x}" if self.qualify_labels else x for x in self.labels]


@dataclass(frozen=True)
class Schema:
    entities: tuple[Entity, ...] = ()
    classifications: tuple[Classification, ...] = ()
    structures: tuple[Structure, ...] = ()
    relations: tuple[Relation, ...] = ()
    attributes: tuple[tuple[str, AttributeGroup], ...] = ()
    hidden: tuple[str, ...] = ()

    @property
    def is_empty(self) -> bool:
        return not (self.entities or self.classifications or self.structures or self.relations)

    def task_types(self) -> list[TaskType]:
        parts = (self.entities, TaskType.ENTITIES), (self.classifications, TaskType.CLASSIFICATIONS), (self.structures, TaskType.STRUCTURES), (self.relations, TaskType.RELATIONS)
        return [t for given, t in parts if given]

    def validate(self) -> Schema:
        if self.is_empty:
            raise SchemaError("the schema asks for nothing")
        for e in self.entities:
            _named(e.name, "an entity")
            _unit(e.threshold, e.name)
        for c in self.classifications:
            _named(c.task, "a classification")
            _unit(c.threshold, c.task)
            if not c.labels:
                raise ValidationError(f"classification {c.task!r} has no labels")
        for s in self.structures:
            _named(s.name, "a structure")
            if not s.fields:
                raise ValidationError(f"structure {s.name!r} has no fields")
            names = [f.name for f in s.fields]
            if s.mode is Mode.NATURAL and s.anchor not in names:
                raise ValidationError(f"structure {s.name!r} is natural; its anchor must be one of {names}")
            for f in s.fields:
                _named(f.name, f"a field of {s.name!r}")
                _unit(f.threshold, f"{s.name}.{f.name}")
                if f.cardinality is not None and f.cardinality.scalar != (f.dtype is Dtype.STR):
                    raise ValidationError(f"{s.name}.{f.name}: {f.cardinality.value} does not go with {f.dtype.value}")
        for r in self.relations:
            _named(r.name, "a relation")
            _unit(r.threshold, r.name)
            if len(r.fields) < 2:
                raise ValidationError(f"relation {r.name!r} needs a head and a tail")
        return self

    def entity_attributes(self, groups: Mapping[str, AttributeGroup]) -> Schema:
        """This schema with attributes of entity spans."""
        if not self.entities:
            raise SchemaError("attributes need entities, declared before them")
        names, seen = {e.name for e in self.entities}, set()
        for group, g in groups.items():
            if not group.strip() or group in RESERVED:
                raise ValidationError(f"{group!r} cannot name an attribute group")
            if not g.labels:
                raise ValidationError(f"attribute group {group!r} has no labels")
            _unit(g.threshold, group)
            for t in g.applies_to or ():
                if t not in names:
                    raise ValidationError(f"attribute group {group!r} applies to {t!r}, which is no entity")
            for label in g.labels:
                if not label.strip() or label in seen:
                    raise ValidationError(f"attribute label {label!r} is blank or not unique")
                seen.add(label)
            for prompt in g.prompts(group):
                if prompt in names:
                    raise ValidationError(f"attribute label {prompt!r} is also an entity")
        return replace(self, attributes=tuple(groups.items()))

    def attribute_prompts(self) -> dict[str, tuple[str, str]]:
        """prompt -> (group, label)."""
        return {p: (name, label) for name, g in self.attributes for p, label in zip(g.prompts(name), g.labels)}

    def expanded(self) -> Schema:
        """With the attribute prompts, sorted, as entities that are asked for but not reported."""
        prompts = tuple(sorted(self.attribute_prompts()))
        return replace(self, entities=self.entities + tuple(Entity(p) for p in prompts), hidden=prompts)

    def to_dict(self) -> dict:
        """Plain data from which from_dict makes an equal schema."""
        return {
            "entities": [_plain(e) for e in self.entities],
            "classifications": [_plain(c) for c in self.classifications],
            "json_structures": [_plain(s) for s in self.structures],
            "relations": [_plain(r) for r in self.relations],
            "entity_attributes": {k: _plain(g) for k, g in self.attributes},
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_dict(cls, data: Mapping) -> Schema:
        """Also takes short forms: entities as names or name -> description, classifications as task -> labels."""
        given = data.get("entities", ())
        if isinstance(given, Mapping):
            entities = [Entity(k, v if isinstance(v, str) and v else None) for k, v in given.items()]
        else:
            entities = [Entity(e) if isinstance(e, str) else Entity(e["name"], e.get("description"), Dtype(e.get("dtype", "list")), e.get("threshold")) for e in given]
        tasks = data.get("classifications", ())
        if isinstance(tasks, Mapping):
            classifications = [Classification.from_json(k, v) for k, v in tasks.items()]
        else:
            classifications = [Classification.from_json(c["task"], c | {"cls_threshold": c.get("threshold", c.get("cls_threshold", 0.5)), "label_descriptions": dict(c.get("label_descriptions") or ())}) for c in tasks]
        groups = {k: AttributeGroup(tuple(g["labels"]), g.get("multi_label", False), g.get("threshold", 0.5), None if g.get("applies_to") is None else tuple(g["applies_to"]), g.get("qualify_labels", False)) for k, g in (data.get("entity_attributes") or {}).items()}
        out = cls(tuple(entities), tuple(classifications), tuple(map(_structure, _items(data.get("json_structures", ()), "fields"))), tuple(map(_relation, _items(data.get("relations", ()), None))))
        return out.entity_attributes(groups) if groups else out


def _items(given, inner: str | None) -> list:
    if isinstance(given, Mapping):
        return [{"name": k} | (dict(v) if isinstance(v, Mapping) else {inner: v} if inner else {}) for k, v in given.items()]
    return [{"name": x} if isinstance(x, str) else x for x in given]


def _structure(d: Mapping) -> Structure:
    fields = [
        Field(f) if isinstance(f, str)
        else Field(
            f["name"], Dtype(f.get("dtype", "list")), Cardinality(f["cardinality"]) if f.get("cardinality") else None, tuple(f.get("choices") or ()), f.get("description"), f.get("threshold"),
            tuple(RegexValidator(v["pattern"], v.get("mode", "full"), v.get("exclude", False)) for v in f.get("validators") or ()),
        )
        for f in d.get("fields", ())
    ]
    return Structure(d["name"], tuple(fields), Mode(d.get("mode", "default")), d.get("anchor"), d.get("max_instances", 1))


def _relation(d: Mapping) -> Relation:
    return Relation(d["name"], d.get("description"), d.get("threshold"), tuple(d.get("fields") or ("head", "tail")))


def _plain(x: Any) -> Any:
    if isinstance(x, Enum):
        return x.value
    if hasattr(x, "__dataclass_fields__"):
        return {k: _plain(getattr(x, k)) for k in x.__dataclass_fields__}
    return [_plain(v) for v in x] if isinstance(x, tuple) else x


@dataclass
class SchemaBuilder:
    """Fluent declaration; build() checks it."""

    _schema: Schema = field(default_factory=Schema)

    def entity(self, name: str, **more: Any) -> SchemaBuilder:
        return self._add("entities", Entity(name, **more))

    def entities(self, names: Iterable[str] | Mapping[str, str]) -> SchemaBuilder:
        for n in names:
            self.entity(n, description=names[n]) if isinstance(names, Mapping) else self.entity(n)
        return self

    entities_with_descriptions = entities

    def classification(self, task: str, labels: Iterable[str], **more: Any) -> SchemaBuilder:
        more = {k: tuple(v.items()) if isinstance(v, Mapping) else tuple(map(tuple, v)) if k == "examples" else v for k, v in more.items()}
        return self._add("classifications", Classification(task, tuple(labels), **more))

    def structure(self, name: str, mode: Mode | str = Mode.DEFAULT, anchor: str | None = None, max_instances: int = 1) -> StructureBuilder:
        return StructureBuilder(self, Structure(name, (), Mode(mode), anchor, max_instances))

    def relation(self, name: str, **more: Any) -> SchemaBuilder:
        return self._add("relations", Relation(name, **more))

    def relations(self, names: Iterable[str]) -> SchemaBuilder:
        for n in names:
            self.relation(n)
        return self

    def attributes(self, groups: Mapping[str, AttributeGroup]) -> SchemaBuilder:
        self._schema = self._schema.entity_attributes(groups)
        return self

    def build(self) -> Schema:
        return self._schema.validate()

    def build_unchecked(self) -> Schema:
        return self._schema

    @property
    def entity_order(self) -> list[str]:
        return [e.name for e in self._schema.entities]

    @property
    def relation_order(self) -> list[str]:
        return [r.name for r in self._schema.relations]

    @property
    def field_orders(self) -> dict[str, list[str]]:
        return {s.name: [f.name for f in s.fields] for s in self._schema.structures}

    def _add(self, part: str, item: Any) -> SchemaBuilder:
        self._schema = replace(self._schema, **{part: getattr(self._schema, part) + (item,)})
        return self


@dataclass
class StructureBuilder:
    parent: SchemaBuilder
    made: Structure

    def field(self, name: str, **more: Any) -> StructureBuilder:
        if "dtype" in more:
            more["dtype"] = Dtype(more["dtype"])
        if more.get("cardinality"):
            more["cardinality"] = Cardinality(more["cardinality"])
        for k in ("choices", "validators"):
            if k in more:
                more[k] = tuple(more[k])
        self.made = replace(self.made, fields=self.made.fields + (Field(name, **more),))
        return self

    def done(self) -> SchemaBuilder:
        return self.parent._add("structures", self.made)
