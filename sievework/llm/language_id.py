"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, found by the forward algorithm; a text's is the product
over its words. Piece probabilities come from expectation-maximisation over all segmentations of the
words of a bounded sample of labelled documents (SAMPLE per language, chosen by a hash of the id).

Defined cases: null text and text without a letter are ``und`` with score 0, as is everything if no
labelled document was there to learn from; repeated rows are judged each; equal probabilities go to the
first language in alphabetical order; texts are scored whole, and a run of any length without white space
over all its segmentations; an empty table gives no rows; other columns are ignored or passed through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import fold_of, frugal, give_back, received, send, slices, text_bytes

#: Bounds of the labelled sample that the model is fitted on: documents of a language, words of it (the most frequent), languages (those with most documents).
SAMPLE, WORDS, LANGUAGES = 200, 40_000, 10_000
ROUNDS = 4
#: Characters of a word, with its mark, that lattices of many words hold. Fitting cuts longer words; scoring takes them one by one, whole.
STRETCH = 48
#: Likelihoods below this are computed again with scaling.
FAINT = 1e-250
#: Of a text in no learned language: the likelihood of a character, as log10, is less than this.
FOREIGN = -4.0
UNKNOWN = 0
REMEMBERED = 400_000


def vocabulary(path: str) -> list[str]:
    """Pieces by number; 0 stands for any character that is no piece."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return ["", *sorted({p for i in range(m.vocab_size()) if not skip(i) and (p := m.id_to_piece(i))})]


def stretches(word: str) -> list[str]:
    marked = "▁" + word
    return [marked[i : i + STRETCH] for i in range(0, len(marked), STRETCH)]


def numbered(pieces: list[str]) -> dict[str, int]:
    """The number of each piece, and 0 for what only begins one: where neither is found, no longer piece can be."""
    out = {p[:k]: 0 for p in pieces for k in range(1, len(p))}
    out.update((p, i) for i, p in enumerate(pieces) if i)
    return out


class Lattices:
    """All pieces that occur in each of many stretches, as edges sorted by where they end.

    ``number`` is that of numbered().
    """

    def __init__(self, texts: list[str], number: dict[str, int]):
        edges: list[int] = []  # stretch, end, begin and piece in one number
        add, find = edges.append, number.get
        for i, t in enumerate(texts):
            n, at = len(t), i << 28
            for a in range(n):
                p = find(t[a])
                add(at | (a + 1) << 22 | a << 16 | (p or UNKNOWN))
                b = a + 2
                while p is not None and b <= n:
                    p = find(t[a:b])
                    if p:
                        add(at | b << 22 | a << 16 | p)
                    b += 1
        packed = np.array(edges, dtype=np.int64)
        end = packed >> 22 & 63
        order = np.argsort(end, kind="stable")
        packed, self.end = packed[order], end[order]
        self.who, self.begin, self.piece = packed >> 28, packed >> 16 & 63, packed & 0xFFFF
        self.n, self.sizes = len(texts), np.array([len(t) for t in texts], dtype=np.int64)
        self.deep = int(self.sizes.max()) if len(texts) else 0
        self.cuts = np.searchsorted(self.end, np.arange(1, self.deep + 2))

    def forward(self, p):
        """alpha[t, i]: probability of the first t characters of stretch i, over all segmentations."""
        alpha = np.zeros((self.deep + 1, self.n))
        alpha[0] = 1
        for t in range(1, self.deep + 1):
            e = slice(self.cuts[t - 1], self.cuts[t])
            alpha[t] = np.bincount(self.who[e], alpha[self.begin[e], self.who[e]] * p[self.piece[e]], self.n)
        return alpha

    def likelihood(self, p):
        return self.forward(p)[self.sizes, np.arange(self.n)]

    def expected(self, p, weights):
        """Expected uses of each piece, words weighing as given."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.sizes, np.arange(self.n)] = weights / np.maximum(alpha[self.sizes, np.arange(self.n)], 1e-300)
        uses = np.zeros(len(p))
        for t in range(self.deep, 0, -1):
            e = slice(self.cuts[t - 1], self.cuts[t])
            flow = p[self.piece[e]] * beta[t, self.who[e]]
            np.add.at(beta, (self.begin[e], self.who[e]), flow)
            uses += np.bincount(self.piece[e], alpha[self.begin[e], self.who[e]] * flow, len(p))
        return uses


def log_likelihood(word: str, number: dict[str, int], p):
    """The natural log of a marked word's probability in each language (rows of p), by a scaled forward pass."""
    longest = max(map(len, number), default=1)
    ahead = [np.zeros(len(p)) for _ in range(longest)]  # of the places after this one, in units of the scale
    now, log = np.ones(len(p)), np.zeros(len(p))
    for a in range(len(word)):
        piece = number.get(word[a])
        ahead[0] = ahead[0] + now * p[:, piece or UNKNOWN]
        for b in range(a + 2, min(len(word), a + longest) + 1):
            if piece is None:
                break
            piece = number.get(word[a:b])
            if piece:
                ahead[b - a - 1] = ahead[b - a - 1] + now * p[:, piece]
        now = ahead.pop(0)
        ahead.append(np.zeros(len(p)))
        scale = np.maximum(now, 1e-300)
        log, now, ahead = log + np.log(scale), now / scale, [x / scale for x in ahead]
    return log


def fit_pieces(counts: dict[str, dict[str, int]], pieces: list[str]):
    """(languages, matrix of piece probabilities) from word counts of each language."""
    number = numbered(pieces)
    languages = sorted(counts)
    out = np.zeros((len(languages), len(pieces)))
    for k, lang in enumerate(languages):
        parts: Counter = Counter()
        for w, n in counts[lang].items():
            for s in stretches(w):
                parts[s] += n
        lattice = Lattices(list(parts), number)
        weights = np.array(list(parts.values()), dtype=float)
        p = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(ROUNDS):
            uses = lattice.expected(p, weights) + 0.02
            p = uses / uses.sum()
        out[k] = p
    return languages, out


def sample(docs: DataFrame, size: int) -> DataFrame:
    """About the ``size`` documents of each language with the smallest hashes of their ids."""
    counts = docs.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(4.0 * size) / F.col("count")))
    near = docs.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(counts.where("count > 0").orderBy(F.desc("count"), "lang").limit(LANGUAGES)), "lang")
    near = near.where(F.shiftrightunsigned("h", 11) / float(1 << 53) <= F.col("share"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return near.withColumn("at", at).where(F.col("at") <= size).select("lang", "text")


def word_counts(batches):
    import pyarrow as pa

    for batch in batches:
        found: dict = defaultdict(Counter)
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[lang].update(t.split())
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def learn(labelled: DataFrame, vocabulary_path: str, size: int = SAMPLE, words: int = WORDS):
    """The model, from doc_id, text and lang (rows without lang are left out)."""
    rows = sample(labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id"), "text", F.col("lang").cast("string").alias("lang")), size)
    found = rows.select("lang", text_bytes().alias("t")).mapInArrow(frugal(word_counts), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = found.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("at") <= words)
    counts: dict = defaultdict(dict)
    for r in most.select("lang", "word", "n").collect():
        counts[r.lang][bytes(r.word).decode()] = r.n
    model = (*fit_pieces({k: dict(sorted(v.items())) for k, v in counts.items()}, pieces := vocabulary(vocabulary_path)), pieces)
    give_back()
    return model


def word_logs(words: list[str], number: dict[str, int], probabilities):
    """Natural logs of the probabilities of words, (words, languages)."""
    marked = ["\u2581" + w for w in words]
    out = np.full((len(words), len(probabilities)), -np.inf)
    short = [i for i, w in enumerate(marked) if len(w) <= STRETCH]
    if short:
        lattice = Lattices([marked[i] for i in short], number)
        with np.errstate(divide="ignore"):
            out[short] = np.log(np.stack([np.where((x := lattice.likelihood(p)) < FAINT, 0, x) for p in probabilities], axis=1))
    for i in np.flatnonzero(~np.isfinite(out).all(axis=1)):
        out[i] = log_likelihood(marked[i], number, probabilities)
    return out


def predict_rows(model):
    def run(batches):
        import pyarrow as pa
        import regex

        languages, probabilities, pieces = received(model)
        number = numbered(pieces)
        letter = regex.compile(r"\p{L}")
        index: dict = {}
        for batch in slices(batches):
            if not index or len(index) > REMEMBERED:
                index, known, logs, sizes = defaultdict(count().__next__), 0, np.zeros((0, len(languages))), np.zeros(0)
            codes, lettered = [], []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                w = raw.split()
                codes.append(np.fromiter(map(index.__getitem__, w), dtype=np.int64, count=len(w)))
                lettered.append(letter.search(raw.decode()) is not None)
            if len(index) > known and languages:
                new = [w.decode() for w in islice(index, known, None)]
                got = [word_logs(new[a : a + 20_000], number, probabilities) for a in range(0, len(new), 20_000)]
                logs = np.concatenate([logs, *got])
                sizes = np.concatenate([sizes, np.fromiter(map(len, new), dtype=float, count=len(new))])
                known = len(index)
            names, scores, likely = [], [], []
            for c, ok in zip(codes, lettered):
                if not ok or not languages:
                    names.append("und"), scores.append(0.0), likely.append(None)
                    continue
                total = logs[c].sum(axis=0)
                best = int(np.argmax(total))
                names.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
                likely.append(float(total[best] / (sizes[c].sum() + len(c)) / np.log(10)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(likely, pa.float64())], names=["row", "lang_pred", "score", "likelihood"])

    return run


def predict(rows: DataFrame, model) -> DataFrame:
    """(row, lang_pred, score, likelihood) for a table of (row, text as bytes); ``row`` is any column carried along.

    likelihood: log10 of the probability of a character (or word end) in that language, on the mean; null for ``und``.
    """
    shared = send(rows.sparkSession, model)
    out = T.StructType([T.StructField("row", rows.schema[0].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("likelihood", T.DoubleType())])
    return rows.toDF("row", "t").mapInArrow(frugal(predict_rows(shared)), out)


def in_known_language(docs: DataFrame, vocabulary_path: str, fold: int = 3, held: int = 1, least: float = FOREIGN) -> DataFrame:
    """docs without those that have no letter or are in no learned language; the columns stay as they are.

    A text is in none if its likelihood in the likeliest is below ``least``. Held-out documents are not learned
    from. If there is nothing to learn from, all documents with a letter stay.
    """
    model = learn(docs.where(fold_of("doc_id", fold) != held), vocabulary_path)
    if not model[0]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_bytes()), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("likelihood") >= least)).select("row.*")
