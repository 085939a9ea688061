"""Byte-level BPE: ranked merges folded over byte strings by Spark's higher-order functions.

Words are the matches of the split pattern. The most frequent ones of the whole table are encoded once
and broadcast, as far as their bytes fit a bound. A task then gathers its documents into chunks and
lists each chunk's other distinct words, which Spark folds too. The fold's state is an array with an
element for each piece: the rank of what it makes with the next piece, above the place where it begins.
Its least element is the pair of lowest rank, the leftmost of equal ones; every step joins that pair.
Ranks are a literal: an array of small maps, found by the hash of the piece. Ids of a document are put
together from those of its words; decoding concatenates the binary pieces of the ids. Only counts of
words are shuffled.

Defined cases: null and empty text give no ids (hashes of nothing); repeated rows are encoded each;
strings of special tokens are ordinary text; a single word of n bytes takes time in n squared; an empty
table gives no rows; other columns are ignored. What is broadcast changes no result.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import cut, most_frequent, settings, slices, text_bytes

BUCKETS = 1 << 14
#: Bytes of text that one chunk holds, about; a longer document is a chunk of its own.
CHUNK = 2 << 20
#: Bytes of frequent words (each counted as COST more) that are encoded once and broadcast, and words a task counts at once.
FREQUENT, COST, COUNTED = 16 << 20, 48, 1_000_000
NONE = 2**31 - 1
CHUNKS = "docs array<long>, codes array<binary>, words array<binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bucket(piece: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(piece.encode(), 42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % BUCKETS


def let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def start(element: Column) -> Column:
    return element.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


class Codec:
    """Column expressions for one rank table. Bytes are handled as strings of one character each."""

    def __init__(self, ranks: dict[bytes, int]):
        buckets: list[dict] = [{} for _ in range(BUCKETS)]
        for piece, rank in ranks.items():
            s = piece.decode("latin-1")
            buckets[bucket(s)][s] = rank
        self.ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex()
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    @staticmethod
    def rank(piece: Column, ranks: Column) -> Column:
        found = F.try_element_at(ranks[F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")], piece)
        return F.coalesce(found, F.lit(NONE))

    def encode(self, word: Column) -> Column:
        """Ids of one word (a string of byte characters)."""
        # a name for the table: each mention of a literal would be a copy of it, on the driver and in every task
        return let(self.ranks, lambda ranks: let(word, lambda w: self._ids(w, ranks)))

    def _ids(self, word: Column, ranks: Column) -> Column:
        n = F.length(word)

        def spot(at: Column, end: Column) -> Column:
            """The element of a piece that makes word[at:end] with the next."""
            return F.shiftleft(self.rank(F.substr(word, at + 1, end - at), ranks).cast("long"), 32).bitwiseOR(at.cast("long"))

        def last(at: Column) -> Column:
            """The element of the last piece, and of the end of the word."""
            return F.lit(NONE << 32).bitwiseOR(at.cast("long"))

        def merge(pieces: Column, _: Column) -> Column:
            def joined(low: Column, i: Column) -> Column:
                """The pieces after the one at i (whose element is ``low``) has taken in the next."""
                after = start(F.get(pieces, i + 2))
                grown = let(start(low), lambda at: F.when(i + 3 < F.size(pieces), spot(at, start(F.get(pieces, i + 3)))).otherwise(last(at)))
                return F.array_compact(F.transform(pieces, lambda x, k: F.when((k < i - 1) | (k > i + 1), x).when(k == i, grown).when(k == i - 1, spot(start(x), after))))

            def step(low: Column) -> Column:
                at = (F.array_position(pieces, low) - 1).cast("int")
                return F.when(low >= NONE << 32, pieces).otherwise(let(at, lambda i: joined(low, i)))

            return let(F.array_min(pieces), step)

        first = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i < n - 1, spot(i, i + 2)).otherwise(last(i)))
        folded = F.aggregate(F.sequence(F.lit(1), n - 1), first, merge)
        ids = let(folded, lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x, k: self.rank(F.substr(word, start(x) + 1, start(F.get(s, k + 1)) - start(x)), ranks)))
        return let(self.rank(word, ranks), lambda whole: F.when((whole < NONE) | (n < 2), F.array(whole)).otherwise(ids))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids."""
        return F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.unhex(self.pieces[i])))


def count_rows(batches):
    """(word, n) of words between white space that a task sees twice or more."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts: list = []

    def some():
        found = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        found = found.filter(pc.greater(found["n_sum"], 1)).rename_columns(["word", "n"])
        parts.clear()
        return found.to_batches()

    for batch in slices(batches):
        words = pc.value_counts(pc.list_flatten(pc.ascii_split_whitespace(batch.column(0).view(pa.string()))))
        parts.append(pa.table({"word": words.field("values").view(pa.binary()), "n": words.field("counts")}).filter(pc.greater(pc.binary_length(words.field("values")), 0)))
        if sum(map(len, parts)) > COUNTED:
            yield from some()
    if parts:
        yield from some()


def match_rows(pattern: str):
    """The matches of the pattern in each word after a blank."""

    def run(batches):
        import pyarrow as pa
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            found = {m.encode() for w in batch.column(0) for m in find(" " + w.as_buffer().to_pybytes().decode())}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    return run


def chunk_rows(pattern: str, shared):
    """Chunks: ids of documents, numbers of their words, and the words that are not among the frequent (numbered from there)."""

    def run(batches):
        import pyarrow as pa
        import regex

        find = regex.compile(pattern).findall
        frequent = {w.decode(): i for i, w in enumerate(pa.ipc.open_stream(shared.value).read_all().column(0).to_pylist())}

        def fresh() -> dict:
            return defaultdict(count(len(frequent)).__next__)

        def row():
            words = [w.encode() for w in index]
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), pa.array([words], pa.list_(pa.binary()))], names=["docs", "codes", "words"])

        docs, codes, index, size = [], [], fresh(), 0
        number = frequent.get
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                at = [index[w] if (i := number(w)) is None else i for w in find(raw.decode())]
                docs.append(doc)
                codes.append(np.array(at, dtype=np.int32).tobytes())
                size += len(raw)
                if size >= CHUNK:
                    yield row()
                    docs, codes, index, size = [], [], fresh(), 0
        if docs:
            yield row()

    return run


def document_rows(shared):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of a chunk."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        frequent = pa.ipc.open_stream(shared.value).read_all()
        n, written = len(frequent), [",".join(map(str, ids)) for chunk in frequent.column(1).chunks for ids in chunk.to_pylist()]
        sizes = np.array([x.count(",") + 1 for x in written], dtype=np.int64)
        pieces = frequent.column(2).to_pylist()
        del frequent
        for batch in batches:
            for docs, codes, ids, decoded in zip(*(batch.column(k) for k in range(4))):
                flat = ids.values
                lens = np.concatenate([sizes, np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, dtype=np.int64)])
                del written[n:], pieces[n:]
                written += [",".join(map(str, x)) for x in flat.to_pylist()]
                pieces += decoded.values.to_pylist()
                out: list[list] = [[], [], []]
                for c in codes.values:
                    w = np.frombuffer(c.as_buffer().to_pybytes(), dtype=np.int32)
                    at = w.tolist()
                    out[0].append(int(lens[w].sum()))
                    out[1].append(hashlib.sha256(",".join(map(written.__getitem__, at)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(b"".join(map(pieces.__getitem__, at))).hexdigest())
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def frequent_words(texts: DataFrame, codec: Codec, pattern: str, most: int = FREQUENT) -> bytes:
    """An Arrow stream of (word, ids, decoded bytes) of the most frequent words, of at most ``most`` bytes in all (each counted as COST more)."""
    counted = cut(texts.mapInArrow(count_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    import pyarrow as pa

    parts = texts.sparkSession.sparkContext.defaultParallelism
    words = most_frequent(counted, most, F.length("word") + COST).repartition(parts).mapInArrow(match_rows(pattern), "word binary").distinct().repartition(parts)
    ids = words.withColumn("ids", codec.encode(F.decode("word", "ISO-8859-1")))
    found = ids.withColumn("decoded", codec.decode(F.col("ids"))).toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


def encoded_words(docs: DataFrame, codec: Codec, pattern: str, shared) -> DataFrame:
    """Chunks of documents: docs, codes (numbers of words, in order), words, ids and decoded of each distinct word."""
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(chunk_rows(pattern, shared), CHUNKS)
    with_ids = chunks.withColumn("ids", F.transform("words", lambda w: codec.encode(F.decode(w, "ISO-8859-1"))))
    return with_ids.withColumn("decoded", F.transform("ids", codec.decode))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark, codec = docs.sparkSession, Codec(read_ranks(ranks_path))
    shared = spark.sparkContext.broadcast(frequent_words(docs.select(text_bytes().alias("t")), codec, pattern, frequent))
    made = encoded_words(docs, codec, pattern, shared).select("docs", "codes", "ids", "decoded")
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(16 << 20)):  # a row is a chunk
        return cut(made.mapInArrow(document_rows(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
