"""The extractor: a schema, a scorer and a table of texts in, typed columns out.

Each document is one row before and after; long texts are cut into windows and merged inside the row.
There is no shuffle and no state, so the same plan runs on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.errors import ValidationError
from sievework.functions.text import find_tokens, lowered, word_pattern
from sievework.operators import chunking, decode
from sievework.operators.scorers import Lexical, Scorer
from sievework.plans.prompts import result_type
from sievework.schema import Classification, Mode, Schema, SchemaBuilder


def tokenise(text: str) -> list[tuple[str, int, int]]:
    """Lower-case tokens with offsets that hold in the text itself."""
    return [(m[0], m.start(), m.end()) for m in find_tokens(lowered(text))]


class Extractor:
    def __init__(self, scorer: Scorer | None = None, threshold: float = 0.5, path: str = "boundary", merge_policy: str = "allow", use_task_thresholds: bool = False, offset_unit: str = "character", bare_pairs: bool = False, windows: bool = True):
        """path: boundary or span. windows: whether long texts are cut on the boundary path. offset_unit: character or byte (of UTF-8). bare_pairs: relations as [head, tail] where no flag is set."""
        if path not in ("boundary", "span") or offset_unit not in ("character", "byte"):
            raise ValidationError(f"path {path!r} or offset_unit {offset_unit!r} is not known")
        self.scorer, self.threshold, self.path, self.merge_policy = scorer or Lexical(), threshold, path, merge_policy
        self.use_task_thresholds, self.offset_unit, self.bare_pairs, self.windows = use_task_thresholds, offset_unit, bare_pairs, windows

    default_threshold = property(lambda self: self.threshold)

    def set_default_threshold(self, value: float) -> None:
        self.threshold = value

    @staticmethod
    def create_schema() -> SchemaBuilder:
        return SchemaBuilder()

    def extract(self, texts: DataFrame, schema: Schema, text: str = "text", threshold: float | None = None, include_confidence: bool = False, include_spans: bool = False, max_len: int | None = None, output: str = "result") -> DataFrame:
        """texts with one more column: a struct with what the schema asks for; all its fields are null for a null text."""
        schema.validate()
        needed = [t.value for t in schema.task_types()] + (["attributes"] if schema.attributes else [])
        self.scorer.require(needed)
        bare = self.bare_pairs and not (include_confidence or include_spans)
        out_type = result_type(schema, include_confidence, include_spans, bare)
        o = decode.Options(self.threshold if threshold is None else threshold, include_confidence, include_spans, self.path, task_thresholds=self.use_task_thresholds)
        return texts.withColumn(output, _extracting(schema, self.scorer, o, self.merge_policy, max_len, out_type, self.offset_unit == "byte", bare, self.windows)(F.col(text)))

    def extract_entities(self, texts: DataFrame, types: Iterable[str] | Mapping[str, str], **more) -> DataFrame:
        return self.extract(texts, SchemaBuilder().entities(types).build(), **more)

    def classify(self, texts: DataFrame, tasks: Mapping, **more) -> DataFrame:
        return self.extract(texts, Schema(classifications=tuple(Classification.from_json(k, v) for k, v in tasks.items())), **more)

    def extract_relations(self, texts: DataFrame, types: Iterable[str], **more) -> DataFrame:
        return self.extract(texts, SchemaBuilder().relations(types).build(), **more)

    batch_extract, batch_extract_entities, batch_classify_text, batch_extract_relations, classify_text = extract, extract_entities, classify, extract_relations, classify


def _extracting(schema: Schema, scorer: Scorer, o: decode.Options, policy: str, max_len: int | None, out_type: T.StructType, in_bytes: bool = False, bare: bool = False, cut: bool = True):
    size, overlap = chunking.window_sizes(max_len)
    step = chunking.checked(size, overlap)

    def one(text: str | None):
        if text is None:
            return None
        words = [m.span() for m in word_pattern().finditer(text)]
        parts = [(0, text)]
        if cut and o.path == "boundary" and len(words) > size:
            parts = [(words[a][0], text[words[a][0] : words[min(a + size, len(words)) - 1][1]]) for a in range(0, -(-(len(words) - size) // step) * step + 1, step)]
        results = [decode.document(t, tokenise(t)[:max_len], schema, scorer, o) for _, t in parts]
        found = results[0] if len(parts) == 1 else chunking.merge_results(text, [a for a, _ in parts], results, policy)
        if in_bytes:
            found = in_byte_offsets(found, text)
        out = shaped(found, schema, o)
        if bare and "relation_extraction" in out:
            out["relation_extraction"] = {k: [[x["head"], x["tail"]] for x in v] for k, v in out["relation_extraction"].items()}
        return out

    @F.pandas_udf(out_type)
    def extracted(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in texts]
        return pd.DataFrame({f.name: pd.Series([None if r is None else r.get(f.name) for r in rows], dtype=object) for f in out_type.fields})

    return extracted


def in_byte_offsets(value, text: str):
    """value with the offsets of every span counted in bytes of UTF-8."""
    if isinstance(value, list):
        return [in_byte_offsets(v, text) for v in value]
    if not isinstance(value, dict):
        return value
    out = {k: in_byte_offsets(v, text) for k, v in value.items()}
    if chunking.is_span(value) and isinstance(value["start"], int):
        out |= {k: len(text[: value[k]].encode()) for k in ("start", "end")}
    return out


def shaped(found: dict, schema: Schema, o: decode.Options) -> dict:
    """The result in the form that the flags ask for."""
    strip = lambda v: chunking.stripped(v, o.confidence, o.spans)
    out: dict = {}
    for name, value in found.items():
        if name == "entities" and schema.attributes:
            drop = (() if o.confidence else ("confidence",)) + (() if o.spans else ("start", "end"))
            value = {k: [{a: b for a, b in s.items() if a not in drop} for s in v] for k, v in value.items()}
        elif any(c.task == name for c in schema.classifications):
            bare = lambda v: v if o.confidence else v["label"]
            value = [bare(v) for v in value] if isinstance(value, list) else bare(value)
        elif (s := next((s for s in schema.structures if s.name == name), None)) is not None:
            single = {f.name for f in s.fields if s.mode is not Mode.NATURAL and f.effective_cardinality.scalar}
            value = [{k: ((strip(v[0]) if v else None) if k in single else strip(v)) for k, v in r.items()} for r in value]
        else:
            value = strip(value)
        out[name] = value
    if not (o.confidence or o.spans):  # equal strings in different places are one
        if "entities" in out and not schema.attributes:
            out["entities"] = {k: list(dict.fromkeys(v)) for k, v in out["entities"].items()}
    return out
