"""Sum-of-squares packing of documents into fixed-length training windows.

A document's token ids (and one end id) are cut into whole windows and one rest. Rests are
placed on line: each goes to the fill level that makes the sum of squared counts of partially
filled windows smallest; the counts are a level array. Windows are packed in independent groups
of a bounded number of pieces, so no task sees more than one group.

Defined cases: null and empty text give the end id alone; an empty table gives no rows; repeated
rows are packed as often as they occur; of equally good levels the fullest is taken; a text of any
length is cut into as many whole windows as it fills; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from itertools import chain, count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import cut, frugal, slices, text_bytes

WINDOW = 2048
#: Pieces a packing group holds, about; a group is one task's work.
GROUP_PIECES = 32768
#: Distinct words remembered by one task before its table starts anew.
REMEMBERED = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def place(sizes, window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each size, in order of arrival, by the sum-of-squares rule.

    Putting a piece of s into a window at level h changes the sum of squared counts by
    2*(N[h+s] - N[h]) + 2, by 1 - 2*N[h] if it becomes full, and by 2*N[s] + 1 if it opens one.
    """
    import numpy as np

    level = np.zeros(window + 1, dtype=np.int64)  # open windows by fill; 0 and window stay 0
    at: list[list[int]] = [[] for _ in range(window + 1)]
    out, windows = [], 0
    for s in sizes:
        s = int(s)
        if s >= window:
            out.append((windows, 0))
            windows += 1
            continue
        top = window - s  # the fullest level that still takes s
        change = 2 * (level[s : window + 1] - level[: top + 1]) + 2
        change[top] -= 1
        change[0] = 2 * level[s] + 1
        change[1:][level[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(change[::-1]))
        if h:
            level[h] -= 1
            w = at[h].pop()
        else:
            w = windows
            windows += 1
        out.append((w, h))
        if h + s < window:
            level[h + s] += 1
            at[h + s].append(w)
    return out


#: ASCII punctuation but the apostrophe, which begins contractions.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: The normalizer and pre_tokenizer of a description whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Habits:
    """What a tokenizer's description lets one rely on.

    words: white space separates tokens and is dropped, A-Z count as a-z, and closing punctuation never
    joins the letter or digit before it. Otherwise whole texts are encoded. special: strings that are
    tokens of their own, in their own case.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"].encode() for x in told.get("added_tokens") or []]
        self.words = (told.get("normalizer"), told.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER) and not any(len(x.split()) != 1 or x.startswith(b"'") for x in self.special)
        #: what the last token of a word ends with, if so
        self.end = self.words and (told.get("model") or {}).get("end_of_word_suffix")
        self.opens = os.path.commonprefix(self.special) or b""

    def parts(self, text: bytes) -> list[bytes]:
        """What is encoded by itself: words, or the whole text."""
        if not self.words:
            return [text] if text else []
        return (text if self.special and self.opens in text else text.lower()).split()

    def halved(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each word before and from its closing marks; the second half is empty where that can't be told."""
        if not self.words:
            return [(w, b"") for w in words]
        whole = self.opens if self.special else None
        return [
            (w, b"") if w[-1:].isalnum() or (whole is not None and whole in w) or not (core := w.rstrip(MARKS))[-1:].isalnum() else (core, w[len(core) :])
            for w in words
        ]


class Encoder:
    """Ids of many words; words of letters only are encoded in lines of LINE, which takes less time."""

    LINE = 200

    def __init__(self, path: str, habits: Habits):
        import numpy as np
        from tokenizers import Tokenizer

        self.tok, self.ends = Tokenizer.from_file(path), None
        if habits.end:
            vocabulary = self.tok.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(habits.end)]] = True

    def ids(self, words: list[bytes]) -> dict[bytes, list[int]]:
        import numpy as np

        out, alone, plain = {}, [], []
        for w in words:
            t = w.decode()
            (plain if self.ends is not None and t.isalpha() else alone).append((w, t))
        for a in range(0, len(plain), 50 * self.LINE):
            lines = [plain[b : b + self.LINE] for b in range(a, min(a + 50 * self.LINE, len(plain)), self.LINE)]
            for line, e in zip(lines, self.tok.encode_batch_fast([" ".join([t for _, t in line]) for line in lines], add_special_tokens=False)):
                ids = e.ids
                ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(ends) != len(line):  # some word has several ends, as lower case may add marks
                    alone += line
                    continue
                out.update((w, ids[b:c]) for (w, _), b, c in zip(line, [0, *ends], ends))
        for a in range(0, len(alone), 10_000):
            part = alone[a : a + 10_000]
            out.update((w, e.ids) for (w, _), e in zip(part, self.tok.encode_batch_fast([t for _, t in part], add_special_tokens=False)))
        return out


def piece_rows(path: str, window: int, end_id: int):
    """The mapInArrow function that makes the pieces of each document.

    If the tokenizer's habits allow it, each distinct word is encoded once, and so are words that differ
    only in case or closing marks.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        habits = Habits(path)
        encoder = Encoder(path, habits)
        index: dict = {}
        row = 0
        for batch in slices(batches):
            if len(index) > REMEMBERED or not index:
                index, ids_of = defaultdict(count().__next__), {b"": []}
                index[None]  # stands for the end id
                pool, size, begin = [np.array([end_id], dtype="<u4")], [np.array([1])], 1
                known = 1
            codes = []
            for t in batch.column(1):
                w = habits.parts(t.as_buffer().to_pybytes())
                codes.append(np.fromiter(map(index.__getitem__, w), dtype=np.int64, count=len(w)))
            if len(index) > known:
                halves = habits.halved(list(islice(index, known, None)))
                asked = [x for x in dict.fromkeys(chain.from_iterable(halves)) if x not in ids_of]
                ids_of.update(encoder.ids(asked))
                got = [ids_of[x] + ids_of[y] if y else ids_of[x] for x, y in halves]
                size.append(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
                pool.append(np.fromiter(chain.from_iterable(got), dtype="<u4"))
                known = len(index)
                pool, size = [np.concatenate(pool)], [np.concatenate(size)]
            all_ids, lens = pool[0], size[0]
            starts = np.cumsum(lens) - lens
            cols: list[list[int]] = [[] for _ in range(6)]
            for doc, c in zip(batch.column(0).to_pylist(), codes):
                c = np.append(c, 0)
                n = lens[c]
                ends = np.cumsum(n)
                ids = all_ids[np.repeat(starts[c] - ends + n, n) + np.arange(ends[-1])]
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    row += 1
                    for col, v in zip(cols, (doc, a, len(part), zlib.crc32(part.tobytes()), len(ids), (row * 0x9E3779B97F4A7C15 + (doc or 0) * 0xC2B2AE3D27D4EB4F) % (1 << 63))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    pieces = cut(narrow.mapInArrow(frugal(piece_rows(tokenizer_path, window, end_id)), PIECES))
    groups = max(1, -(-pieces.count() // group_pieces))

    def packed(key, pdf):
        pdf = pdf.sort_values(["salt", "doc_id", "start"], kind="stable")
        spots = place(pdf["length"].tolist(), window)
        pdf["sequence_id"] = [(int(key[0]) << 32) + w for w, _ in spots]
        pdf["offset"] = [o for _, o in spots]
        return pdf.drop(columns=["g", "salt"])

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
