"""Texts in, results out, and the files that a model comes in."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.errors import ConfigError, WeightsError


def from_texts(spark: SparkSession, texts: Iterable[str | None]) -> DataFrame:
    """(doc_id, text) of texts in memory; none gives an empty table."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def read_texts(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table with a text column: parquet, orc, json or csv, or text files (one row a line, or a file with wholetext)."""
    reader = spark.read.options(**options)
    if kind == "text":
        return reader.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    return reader.format(kind).load(path)


def write_results(results: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Typed columns as parquet or orc; as json each row is one object."""
    results.write.mode(mode).format(kind).save(path)


def as_json(results: DataFrame, column: str = "result") -> DataFrame:
    return results.withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


#: Numpy kinds of the weight format's types.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def weight_header(path: str | Path) -> dict:
    """Names, kinds, shapes and places of the arrays of a weight file: a length, then JSON, then the data."""
    try:
        with open(path, "rb") as f:
            (n,) = struct.unpack("<Q", f.read(8))
            head = json.loads(f.read(n))
    except (OSError, struct.error, ValueError) as e:
        raise WeightsError(f"{path}: {e}") from e
    return {k: v | {"base": 8 + n} for k, v in head.items() if k != "__metadata__"}


def read_weights(*paths: str | Path) -> dict:
    """Arrays by name, mapped from one file or several parts; half precision of the other kind is widened."""
    import numpy as np

    out: dict = {}
    for path in paths:
        for name, at in weight_header(path).items():
            a, b = at["data_offsets"]
            if at["dtype"] == "BF16":
                raw = np.memmap(path, "<u2", "r", at["base"] + a, ((b - a) // 2,))
                out[name] = (raw.astype("<u4") << 16).view("<f4").reshape(at["shape"])
            elif at["dtype"] in KINDS:
                kind = np.dtype(KINDS[at["dtype"]])
                if (b - a) != kind.itemsize * int(np.prod(at["shape"], dtype=int)):
                    raise WeightsError(f"{path}: {name} has {b - a} bytes for shape {at['shape']}")
                out[name] = np.memmap(path, kind, "r", at["base"] + a, tuple(at["shape"])) if b > a else np.zeros(at["shape"], kind)
            else:
                raise WeightsError(f"{path}: {name} is of unknown kind {at['dtype']}")
    return out


def write_weights(path: str | Path, arrays: dict) -> None:
    import numpy as np

    kinds = {np.dtype(v): k for k, v in KINDS.items()}
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = {"dtype": kinds[np.asarray(a).dtype], "shape": list(np.shape(a)), "data_offsets": [at, at + np.asarray(a).nbytes]}
        at += np.asarray(a).nbytes
    raw = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))


def weight_files(folder: str | Path) -> list[Path]:
    """Weight files of a folder, whole ones before numbered parts."""
    found = sorted(Path(folder).glob("*.safetensors"))
    if not found:
        raise WeightsError(f"{folder} has no weight files")
    return found


def find_tokenizer(*places: str | Path | None) -> Path | None:
    """The first tokenizer file: an explicit path, a model's folder, the working folder."""
    for p in (*places, Path.cwd()):
        if p is None:
            continue
        p = Path(p)
        for q in (p, p / "tokenizer.json"):
            if q.is_file():
                return q
    return None


#: Parts of weight names, by module.
MODULES = {"encoder": ("encoder.", "token_rep_layer."), "span_rep": ("span_rep.",), "classifier": ("classifier.",), "count_pred": ("count_pred.",), "count_embed": ("count_embed.",), "boundary": ("boundary",)}


def module_of(name: str) -> str | None:
    return next((m for m, starts in MODULES.items() if name.startswith(starts)), None)


def encoder_family(name: str, header: dict | None = None) -> str:
    """deberta_v3, deberta or bert, from a name or the arrays of a file."""
    low = name.lower()
    if "deberta" in low:
        return "deberta_v3" if "v3" in low else "deberta"
    return "deberta_v3" if header and any("rel_embeddings" in k for k in header) else "bert"


@dataclass
class ModelConfig:
    """What a model backend needs to know; sizes are those of a small encoder."""

    model_name: str = ""
    architecture: str = "boundary"
    hidden_size: int = 768
    num_hidden_layers: int = 12
    num_attention_heads: int = 12
    intermediate_size: int = 3072
    vocab_size: int = 128_011
    max_width: int = 8
    max_len: int | None = None
    counting_layer: str = "count_lstm"
    token_pooling: str = "first"
    boundary_dim: int = 128
    content_dim: int = 64
    pool_size: int = 192

    def validate(self) -> ModelConfig:
        for f in ("hidden_size", "num_hidden_layers", "num_attention_heads", "vocab_size", "max_width", "pool_size"):
            if getattr(self, f) <= 0:
                raise ConfigError(f"{f} must be positive")
        if self.hidden_size % self.num_attention_heads:
            raise ConfigError("hidden_size must divide by num_attention_heads")
        if self.architecture not in ("span", "boundary"):
            raise ConfigError(f"unknown architecture {self.architecture!r}")
        return self

    @classmethod
    def from_file(cls, path: str | Path) -> ModelConfig:
        """Names that are not known here are passed over."""
        try:
            data = json.loads(Path(path).read_text())
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e
        return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data}).validate()

    def to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))
