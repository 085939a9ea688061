"""Tokens, offsets and small text rules as Spark columns. Offsets count code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Alternatives of the word pattern, first match wins: URL, lower-case e-mail, mention, word with inner - or _, any other mark.
URL = r"(?:https?://[^\s]+|www\.[^\s]+)"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
MENTION = r"@[a-z0-9_]+"
WORD = r"\w+(?:[-_]\w+)*"
TOKEN = f"(?U){URL}|{EMAIL}|{MENTION}|{WORD}|\\S"


def lower_case(text: Column) -> Column:
    """The text in lower case with one character for each, as ``lowered`` gives it."""
    return F.lower(F.translate(text, "\u0130", "i"))


def tokens(text: Column, lower: bool = True, max_len: int | None = None) -> Column:
    """array<string> of the tokens of a text; lower-cased before it is split."""
    out = F.regexp_extract_all(lower_case(text) if lower else text, F.lit(TOKEN), F.lit(0))
    return out if max_len is None else F.slice(out, 1, max_len)


def whitespace_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(whitespace_tokens(text))


def token_offsets(text: Column, lower: bool = True) -> Column:
    """array<struct<tok,start,end>>: tokens with half-open offsets. Linear in the text, in one Arrow batch call."""
    return _token_offsets(lower_case(text) if lower else text)


@lru_cache
def word_pattern():
    """Runs without Unicode white space, for Python."""
    import regex

    return regex.compile(r"\P{White_Space}+")


def token_id(token: str, size: int = 30522) -> int:
    """fallback_token_id in Python."""
    out = 0
    for b in token.encode():
        out = (out * 31 + b) % (1 << 64)
    return out % size


#: What the JVM's Unicode \\w takes: letters, marks, digits, connectors and joiners.
WORD_CHAR = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]"


@lru_cache(maxsize=1 << 17)
def _known(c: str) -> bool:
    """Whether Python's own \\w and \\s class a character as the JVM's do."""
    import re

    import regex

    same = lambda ours, own: bool(regex.match(ours, c)) == bool(re.match(own, c))
    return same(WORD_CHAR, r"\w") and same(r"\S", r"\S")


@lru_cache
def token_pattern(link: bool = True, at: bool = True, known: bool = False):
    """The token pattern for Python. link, at: whether the text has what a URL, or an address or mention, needs;
    known: whether Python's own classes do for its characters."""
    import re

    import regex

    # an address has no @ before its @: giving back what was taken cannot help
    parts = [URL] * link + [EMAIL.replace("]+@", "]++@", 1), MENTION] * at + [WORD, r"\S"]
    return re.compile("|".join(parts)) if known else regex.compile("|".join(parts).replace(r"\w", WORD_CHAR))


def lowered(text: str) -> str:
    """The text in lower case, of the same length: a character with a longer lower-case form becomes the first of it."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def find_tokens(text: str):
    """Matches of the token pattern."""
    return token_pattern("http" in text or "www." in text, "@" in text, all(map(_known, set(text)))).finditer(text)


#: Rows of which tokens are held at once, whatever Spark's batch size.
HELD = 100


def offsets_in(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, their tokens with offsets) of a few texts at a time."""
    for a in range(0, len(texts), HELD):
        some, toks, starts, ends, first = texts[a : a + HELD], [], [], [], []
        for text in some.to_pylist():
            first.append(None if text is None else len(toks))
            for m in find_tokens(text or ""):
                toks.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
        rows = pa.StructArray.from_arrays([pa.array(toks, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["tok", "start", "end"])
        yield some, pa.ListArray.from_arrays(pa.array([*first, len(toks)], pa.int32()), rows)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _token_offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for _, rows in offsets_in(batch):
            yield rows


def misplaced(texts: list, rows: pa.Array) -> list[int]:
    """How many tokens of each text are not where their offsets say."""
    at, flat, out = rows.offsets.to_pylist(), rows.values, []
    toks, starts, ends = (flat.field(k) for k in range(3))
    short = (pc.utf8_length(toks).to_numpy() != ends.to_numpy() - starts.to_numpy()).cumsum()
    short, starts, ends = [0, *short.tolist()], starts.to_pylist(), ends.to_pylist()
    edges, data = toks.buffers()[1], toks.buffers()[2]
    edges = memoryview(edges).cast("i") if len(toks) else [0]
    data = memoryview(data or b"")
    for text, a, b in zip(texts, at, at[1:]):
        places = list(map(slice, starts[a:b], ends[a:b]))
        # lengths that agree, and equal texts laid end to end: every token is equal
        right = short[a] == short[b] and (a == b or "".join(map(text.__getitem__, places)).encode() == data[edges[a] : edges[b]])
        out.append(0 if right else sum(text[p] != x for p, x in zip(places, toks[a:b].to_pylist())))
    return out


def offset_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first column, n_tokens, covered, wrong) from (any, lower-case text): tokens, their characters by the offsets, and how many are misplaced."""
    for batch in batches:
        done = 0
        for some, rows in offsets_in(batch.column(1)):
            lengths = pc.list_value_length(rows)
            chars = [0, *pc.subtract(rows.values.field(2), rows.values.field(1)).to_numpy().cumsum(dtype="int64").tolist()]
            at = rows.offsets.to_pylist()
            covered = [chars[b] - chars[a] if b > a else None for a, b in zip(at, at[1:])]
            own = batch.column(0)[done : done + len(some)]
            done += len(some)
            yield pa.RecordBatch.from_arrays([own, lengths, pa.array(covered, pa.int64()), pa.array(misplaced(some.to_pylist(), rows), pa.int64())], names=[batch.schema.names[0], "n_tokens", "covered", "wrong"])


def char_to_token(toks: Column, at: Column) -> Column:
    """Number of the first token that covers a place, or null."""
    found = F.array_position(F.transform(toks, lambda t: (t["start"] <= at) & (at < t["end"])), True)
    return F.when(found > 0, (found - 1).cast("int"))


def token_to_char(toks: Column, start: Column, end: Column) -> Column:
    """struct<start,end> of a half-open token range, or null if it is empty or out of range."""
    ok = (start >= 0) & (start < end) & (end <= F.size(toks))
    return F.when(ok, F.struct(F.get(toks, start)["start"].alias("start"), F.get(toks, end - 1)["end"].alias("end")))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The slice [start, end) of the original text; clamped, empty if reversed."""
    a = F.greatest(start, F.lit(0))
    return F.substr(text, a + 1, F.greatest(end - a, F.lit(0)))


def word_offset(offsets: Column, at: Column) -> Column:
    """The offset of a word, 0 where there is none."""
    return F.coalesce(F.get(offsets, at), F.lit(0))


def byte_offset(text: Column, at: Column) -> Column:
    """A code-point offset as an offset in UTF-8 bytes."""
    return F.octet_length(F.substr(text, F.lit(1), at))


def punctuated(text: Column) -> Column:
    """Ends every text with . ! or ?; an empty one becomes a full stop."""
    return F.when(text == "", F.lit(".")).when(F.right(text, F.lit(1)).isin(".", "!", "?"), text).otherwise(F.concat(text, F.lit(".")))


def fallback_token_id(token: Column, vocabulary: int = 30522) -> Column:
    """h = h * 31 + byte in 64 unsigned bits, modulo the vocabulary."""
    hexed = F.hex(token.cast("binary"))
    code = lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("decimal(38,0)")
    wrap = F.lit("18446744073709551616").cast("decimal(38,0)")
    n = F.octet_length(token)
    folded = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("decimal(38,0)"), lambda h, i: ((h * 31 + code(i)) % wrap).cast("decimal(38,0)"))
    return (folded % vocabulary).cast("int")


def regex_valid(text: Column, pattern: str, full: bool = True, exclude: bool = False) -> Column:
    """Whether a span passes a validator: full wants the leftmost match to be the whole span."""
    ok = F.coalesce(F.regexp_substr(text, F.lit(pattern)) == text, F.lit(False)) if full else text.rlike(pattern)
    return ~ok if exclude else ok


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
