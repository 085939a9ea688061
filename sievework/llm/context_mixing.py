"""Language-model scores by on-line logistic mixing of hashed-context bit predictors.

A text is its words (A-Z lower-cased) and one end. Each token is coded as bits:

* one bit says whether it is what followed the last time its predecessor occurred in this text; its
  probability is counted adaptively within the text;
* otherwise the bits of a Huffman code over the most frequent training tokens, the end and escapes, one
  for each pair of first bytes that other training tokens have, so these are told from context too. Three predictors give each bit a probability: no context, the last of the most frequent
  words, and the token before, the latter two in hashed tables. Their log odds are added
  with weights from a set gated by how much the predictors have seen. The weights start
  from values fitted on all training texts (each bit left out of the counts that predict it): a few texts tell
  where Newton's method begins, one step of it takes sums over all of them. They
  are refined within each text, after every few tokens, by gradient descent on the coding cost;
* after an escape, a known token has its share of the remaining training tokens that begin alike; a new one
  is spelled (given how it begins), its bytes' bits predicted from one to three bytes of context in hashed tables, mixed with gated weights that are fitted likewise on
  all words seen once in training and not refined.

How many words are coded, how many are contexts and how many slots the tables have grows with the square
root of the number of training tokens, without an end (class Words); the constants are the least sizes.

All counts are taken over all training texts and added up, so results do not depend on how the rows are
dealt out. Counts of the HOT most frequent words are broadcast (a bounded table); those of rarer words
are joined to the few places that need them. ``score`` is the log10 probability of the text, ``base_score``
that of add-one unigrams.

Defined cases: null and empty text are the end alone; without training texts the model knows no word and
spells all of them; repeated rows are scored each; words and texts may have any length; ties in frequency
are broken by the word's bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from itertools import count, islice
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import cut, fold_of, most_frequent, received, scratch, send, slices, text_bytes

#: Least sizes: words that are broadcast, and that are coded.
HOT, CODED = 1 << 17, 1 << 14
#: Least numbers of frequent tokens that are contexts as the last seen, and as the one before.
LAST, BEFORE = 63, 255
SLOT_BITS, SPELL_BITS = 20, 18
SLOTS = 1 << SLOT_BITS
#: Tokens after which a text's weights are refined: in its first FRESH tokens, and later; and the rate.
BLOCK, FRESH, LATER, RATE = 16, 256, 64, 0.3
#: Training texts, their first bytes, and training words from which fitting begins, before its step over all of them.
FIT_TEXTS, FIT_BYTES, FIT_WORDS = 200, 4096, 4000
#: What a context predictor's weight is drawn to in fitting, by how often it was used: never, under 4, under 32, more.
TRUST = np.array([0.0, 0.2, 0.4, 0.55])
SLICES = 64
#: Different pairs of context and symbol that a task gathers, and of which it counts the bits at once; bytes of texts and of words that are fitted at once.
GATHERED, COUNTED, FITTED, FITTED_WORDS = 1_000_000, 50_000, 300_000, 60_000
#: Tokens whose bits are fitted at once, so few that they stay in a cache.
SPREAD = 1 << 13
#: Tokens and texts worked on at once.
TOKENS, TEXTS = 400_000, 256
PARTS = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, word binary, n long, coded long, share double, spelled double"


def halves(a, b) -> tuple:
    """What each side of pairs of integers adds to the hash of the pair."""
    with np.errstate(over="ignore"):
        return np.asarray(a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.asarray(b, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def slots_of(x, bits: int):
    """Slots for sums of two halves (changed in place)."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - bits)
    return x.view(np.int64)


def hashed(a, b, bits: int):
    """Slots for pairs of integers."""
    left, right = halves(a, b)
    return slots_of(left + right, bits)


class Code:
    """A Huffman code over symbols 0..n-1: for each, the inner nodes on its path and the bits taken."""

    def __init__(self, weights: list[int]):
        heap = [(max(w, 1), i, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, n = {}, len(weights)
        for node in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[2]], up[b[2]] = (node, 0), (node, 1)
            heapq.heappush(heap, (a[0] + b[0], node, node))
        paths = []
        for s in range(n):
            path, at = [], s
            while at in up:
                at, bit = up[at]
                path.append((at - n, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], dtype=np.int64)
        self.bit = np.array([x for p in paths for _, x in p], dtype=np.int64)
        self.nodes = max(n - 1, 1)

    def spread(self, symbols):
        """(how many bits each of a sequence of symbols has, place in the table of all paths of every bit)."""
        n = self.length[symbols]
        ends = np.cumsum(n)
        return n, np.arange(ends[-1] if len(n) else 0) + np.repeat(self.start[symbols] - ends + n, n)

    def places(self, symbols):
        """(place of the symbol, place in the table of all paths) of every bit of a sequence of symbols."""
        n, at = self.spread(symbols)
        return np.repeat(np.arange(len(n)), n), at

    def bits(self, symbols):
        """(place of the symbol, node, bit) of every bit of a sequence of symbols."""
        who, at = self.places(symbols)
        return who, self.node[at], self.bit[at]


class Words:
    """Frequent words by rank, with their counts; the alphabet of the code."""

    def __init__(self, words: list[bytes], counts: list[int], texts: int, total: int, kinds: int, single: int, begins: list[tuple[bytes, int, int]] = ()):
        """begins: (first two bytes, tokens, words seen once) of all training words."""
        self.words, self.counts = words, np.array([*counts, 0], dtype=np.int64)
        self.texts, self.total, self.kinds, self.single = texts, total, kinds, single
        root = isqrt(total)
        # words seen once stay out of the code: they stand for the new words that are to come
        self.coded = min(max(CODED, 3 * root // 2), sum(n > 1 for n in counts))
        self.last, self.before = max(LAST, root // 40), max(BEFORE, root // 4)
        self.slot_bits = max(SLOT_BITS, (200 * root).bit_length())
        self.end, self.escape = self.coded, self.coded + 1
        self.rest = total - texts - int(self.counts[: self.coded].sum())
        left, once = Counter({w: n for w, n, _ in begins}), {w: k for w, _, k in begins}
        for w, n in zip(words[: self.coded], counts):
            left[w[:2]] -= n
        self.begins = sorted(w for w, n in left.items() if n > 0)
        #: the escape of each pair of first bytes; 0 is that of all others
        self.kind = {w: k for k, w in enumerate(self.begins, 1)}
        known = np.array([left[w] for w in self.begins], dtype=np.int64)
        self.left = np.concatenate([[self.rest - known.sum()], known])
        self.new = (np.array([single - sum(once[w] for w in self.begins), *(once[w] for w in self.begins)]) + 1) / (self.left + 2)
        self.kinds_of_words = np.array([self.kind.get(w[:2], 0) for w in words], dtype=np.int64)
        self.code = Code([*counts[: self.coded], texts, *self.left.tolist()])

    def numbering(self) -> dict:
        number = defaultdict(count(len(self.words)).__next__)
        number.update((w, i) for i, w in enumerate(self.words))
        return number

    def symbols(self, codes, kinds):
        """kinds: the escape of each code from 0."""
        if not len(kinds):
            return np.full(len(codes), self.end, dtype=np.int64)
        return np.where(codes < 0, self.end, np.where(codes < self.coded, codes, self.escape + kinds[np.maximum(codes, 0)]))


def by_begin(words: Words) -> dict:
    """Numbers of words where all that are not frequent have one for each escape."""

    class Known(dict):
        def __missing__(self, w):
            return len(words.words) + words.kind.get(w[:2], 0)

    return Known(words.numbering())


def contexts(codes, first, words):
    """(last frequent token seen, token before) of each token; codes: rank or -1 for the end; first: start of its text."""
    at = np.arange(len(codes))
    frequent = np.where((codes >= 0) & (codes < words.last), at, -1)
    seen = np.maximum.accumulate(np.concatenate([[-1], frequent[:-1]])) if len(codes) else at
    last = np.where(seen >= first, codes[np.maximum(seen, 0)] + 1, 0)
    before = np.where(at > first, np.minimum(codes[np.maximum(at - 1, 0)], words.before) + 2, 0)
    return last, before


def tokenised(texts: list[bytes], number) -> tuple:
    """(codes with -1 after each text, start of its text for each token, lengths with the end)."""
    rows = [np.fromiter(map(number.__getitem__, t.lower().split()), dtype=np.int64) for t in texts]
    lens = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    codes = np.full(int(lens.sum()), -1, dtype=np.int64)
    ends = np.cumsum(lens)
    for r, e in zip(rows, ends):
        codes[e - 1 - len(r) : e - 1] = r
    return codes, np.repeat(ends - lens, lens), lens


def in_parts(texts: list, most_bytes: int = TOKENS * 6):
    """Runs of texts of a bounded size together (a longer one is a run of its own)."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t)
        if size >= most_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_rows(batches):
    """Counts of the words of training texts; the empty word counts the texts."""
    import pyarrow as pa

    for batch in batches:
        found: Counter = Counter()
        for t in batch.column(0):
            found.update(t.as_buffer().to_pybytes().lower().split())
            found[b""] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def sliced(name: str, table):
    """(table, slice, bytes) of a table of counts, for adding up."""
    for k, part in enumerate(np.array_split(table, SLICES)):
        if part.any():
            yield name, k, zlib.compress(part.astype("<i8").tobytes(), 1)


def sliced_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["name", "slice", "counts"])


def bit_rows(shared):
    """How often each bit came after each context, over training texts; one table a task and context."""

    def run(batches):
        words = received(shared)
        size, some, slots = words.escape + len(words.begins) + 1, False, 1 << words.slot_bits
        kinds = np.concatenate([words.kinds_of_words, np.arange(len(words.begins) + 1)])
        # no count of a task passes 2^31: a token adds at most the bits of its code, and tables are given out in time
        tables = {"none": np.zeros(2 * words.code.nodes, dtype=np.int32), "last": np.zeros(2 * slots, dtype=np.int32), "before": np.zeros(2 * slots, dtype=np.int32)}
        held, most = 0, (2**31 - 1) // max(int(words.code.length.max(initial=1)), 1)

        number = by_begin(words)
        seen: dict = {"last": [], "before": []}

        def add(name):
            """Takes the gathered pairs of context and symbol into the table."""
            if not seen[name]:
                return
            pairs, which = np.unique(np.concatenate([k for k, _ in seen[name]]), return_inverse=True)
            times = np.bincount(which, np.concatenate([n for _, n in seen[name]])).astype(np.int32)
            seen[name].clear()
            for a in range(0, len(pairs), COUNTED):
                at, n = pairs[a : a + COUNTED], times[a : a + COUNTED]
                who, node, bit = words.code.bits(at % size)
                slot = hashed((at // size + 1000 * (name == "before"))[who], node, words.slot_bits)
                np.add.at(tables[name], 2 * slot + bit, n[who])
                if name == "last":
                    np.add.at(tables["none"], 2 * node + bit, n[who])

        def given_out():
            for name in seen:
                add(name)
            return sliced_batch([r for name, t in tables.items() for r in sliced(name, t)])

        for batch in slices(batches):
            texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
            for run_ in in_parts(texts):
                codes, first, _ = tokenised([texts[i] for i in run_], number)
                if some and held + len(codes) > most:
                    yield given_out()
                    held = 0
                    for t in tables.values():
                        t[:] = 0
                some, held = True, held + len(codes)
                last, before = contexts(codes, first, words)
                symbols = words.symbols(codes, kinds)
                for name, context in (("last", last), ("before", before)):
                    seen[name].append(np.unique(context * size + symbols, return_counts=True))
                    if sum(len(k) for k, _ in seen[name]) > GATHERED:
                        add(name)
        if some:
            yield given_out()

    return run


def spelling(words: list[bytes]):
    """(word, slots of the three contexts, bit) of every bit of words spelled with a closing blank."""
    joined = np.frombuffer(b"".join(w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    lens = np.array([len(w) + 1 for w in words], dtype=np.int64)
    who = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(lens) - lens, lens)
    back = [np.where(place >= k, np.concatenate([np.zeros(k, dtype=np.int64), joined])[: len(joined)], 0) for k in (1, 2, 3)]
    context = [back[0], back[0] << 8 | back[1], (back[0] << 16 | back[1] << 8 | back[2]) * 2 + (place == 3)]
    out_slot: list[list] = [[], [], []]
    out_bit, node = [], np.ones(len(joined), dtype=np.int64)
    for k in range(7, -1, -1):
        bit = joined >> k & 1
        for order in range(3):
            out_slot[order].append(hashed(context[order] * 4 + order + 1, node, SPELL_BITS))
        out_bit.append(bit)
        node = node * 2 + bit
    return np.tile(who, 8), [np.concatenate(s) for s in out_slot], np.concatenate(out_bit)


def spell_rows(batches):
    """Bit counts of the spelling of distinct training words."""
    tables, some = [np.zeros(2 << SPELL_BITS, dtype=np.int64) for _ in range(3)], False
    for batch in batches:
        words = [w.as_buffer().to_pybytes() for w in batch.column(0)]
        for run_ in in_parts(words, 200_000):
            some = True
            _, slots, bit = spelling([words[i] for i in run_])
            for t, s in zip(tables, slots):
                t += np.bincount(2 * s + bit, minlength=len(t))
    if some:
        yield sliced_batch([r for k, t in enumerate(tables) for r in sliced(f"spell{k}", t)])


def added(key, table):
    import pyarrow as pa

    total = 0
    for raw in table.column("counts"):
        total = total + np.frombuffer(zlib.decompress(raw.as_buffer().to_pybytes()), dtype="<i8")
    return pa.table({"name": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def predictor(table, strength: float):
    """(log odds of a one, trust class) of each slot of a table of bit counts."""
    odds, trust = np.empty(len(table) // 2, dtype=np.float32), np.empty(len(table) // 2, dtype=np.int8)
    for a in range(0, len(odds), 1 << 18):
        zero, one = (table[2 * a + k : 2 * (a + (1 << 18)) : 2].astype(float) for k in (0, 1))
        odds[a : a + (1 << 18)] = np.log((one + strength) / (zero + strength))
        trust[a : a + (1 << 18)] = np.digitize(zero + one, [1, 4, 32])
    return odds, trust


def left_out(table, slot, bit, strength: float):
    """predictor() of each of many bits, by a table of bit counts without that bit itself."""
    zero, one = np.maximum(table[2 * slot] - (bit == 0), 0).astype(float), np.maximum(table[2 * slot + 1] - (bit == 1), 0).astype(float)
    return np.log((one + strength) / (zero + strength)), np.digitize(zero + one, [1, 4, 32])


def gated(start, gate, inputs, bit, pull: float = 20.0, rounds: int = 8):
    """Weights of each gate that predict the bits best, by Newton's method; few bits leave them near ``start``."""
    out = start.astype(float).copy()
    x, sign = np.stack(inputs, axis=1), 2.0 * bit - 1
    for g in np.unique(gate):
        mine, k = gate == g, x.shape[1]
        xs, ys = x[mine], sign[mine]
        cost = lambda w: np.logaddexp(0, -ys * (xs @ w)).sum() + pull / 2 * ((w - start[g]) ** 2).sum()  # noqa: B023, E731
        w, now = out[g, :k], cost(out[g, :k])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(np.clip(ys * (xs @ w), -60, 60)))
            step = np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + pull * np.eye(k), xs.T @ (ys * p) - pull * (w - start[g, :k]))
            while (then := cost(w + step)) > now and np.abs(step).max() > 1e-6:
                step = step / 2
            if then >= now:
                break
            w, now = w + step, then
        out[g, :k] = w
    return out


def packed(odds, trust):
    """Log odds in single precision that hold their trust class in the two lowest bits: one look gives both."""
    return (odds.astype(np.float32).view(np.int32) & ~np.int32(3) | trust.astype(np.int32)).view(np.float32)


def trust_of(odds):
    return odds.view(np.int32) & np.int32(3)


def left_out_packed(table, strength: float):
    """left_out() of each place 2 * slot + bit of a table of bit counts, packed."""
    out = np.empty(len(table), dtype=np.float32)
    for a in range(0, len(table), 1 << 18):
        pairs = table[a : a + (1 << 18)].reshape(-1, 2)
        for bit in (0, 1):
            zero, one = (np.maximum(pairs[:, k] - (k == bit), 0).astype(np.float32) for k in (0, 1))
            n = zero + one
            odds = np.log((one + np.float32(strength)) / (zero + np.float32(strength)))
            out[a + bit : a + (1 << 18) : 2] = packed(odds, (n >= 1).view(np.int8) + (n >= 4).view(np.int8) + (n >= 32).view(np.int8))
    return out


def slopes(weights, gate, inputs, bit):
    """For each gate the gradient of the log likelihood of the bits, and the curvature, in one array."""
    k = weights.shape[1]
    out = np.zeros((16, k, k + 1))
    order = np.argsort(gate, kind="stable")
    x, bit = np.stack(inputs, axis=1)[order], bit[order]
    ends = np.cumsum(np.bincount(gate, minlength=16))
    for g, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        if a < b:
            own = x[a:b]
            p = 1 / (1 + np.exp(-np.clip(own @ weights[g].astype(np.float32), -60, 60)))
            out[g, :, 0] = own.T @ (bit[a:b] - p)
            out[g, :, 1:] = (own * (p * (1 - p))[:, None]).T @ own
    return out


def stepped(weights, start, sums, pull: float = 20.0):
    """weights after one step of Newton's method on all bits, of which ``sums`` has the slopes; ``start`` as in gated()."""
    out = weights.astype(float).copy()
    for g in range(16):
        step = np.linalg.solve(sums[g, :, 1:] + pull * np.eye(out.shape[1]), sums[g, :, 0] - pull * (out[g] - start[g]))
        out[g] += step / max(1.0, np.abs(step).max())
    return out


def summed(rows, k: int):
    return sum((np.frombuffer(bytes(r.sums)).reshape(16, k, k + 1) for r in rows), np.zeros((16, k, k + 1)))


def sums_batch(total):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_rows(shared):
    """Slopes of the weights of tokens over the training texts of a task."""

    def run(batches):
        words, tables, weights = received(shared)
        code, bits = words.code, words.slot_bits
        kinds, number, total = np.concatenate([words.kinds_of_words, np.arange(len(words.begins) + 1)]), by_begin(words), 0
        # what depends only on the place in the table of all paths
        _, of_node = halves(0, code.node)
        none_at, bit_at = tables["none"][2 * code.node + code.bit], code.bit.astype(np.float32)
        for batch in slices(batches):
            texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
            for run_ in in_parts(texts, FITTED):
                codes, first, _ = tokenised([texts[i] for i in run_], number)
                every = np.flatnonzero(~repeats(codes, first)[1])
                (last, before), symbols = contexts(codes, first, words), words.symbols(codes, kinds)
                of_last, of_before = halves(last, 0)[0], halves(before + 1000, 0)[0]
                for a in range(0, len(every), SPREAD):
                    ask = every[a : a + SPREAD]
                    n, at = code.spread(symbols[ask])
                    half, bit = of_node[at], code.bit[at]
                    o1, o2 = (tables[k][2 * slots_of(np.repeat(x[ask], n) + half, bits) + bit] for k, x in (("last", of_last), ("before", of_before)))
                    gate = (4 * trust_of(o1) + trust_of(o2)).astype(np.int8)
                    total = total + slopes(weights, gate, (none_at[at], o1, o2, np.full(len(at), 0.3, dtype=np.float32)), bit_at[at])
        if isinstance(total, np.ndarray):
            yield sums_batch(total)

    return run


def fit_spelling_rows(shared):
    """Slopes of the weights of spelling over the words of a task."""

    def run(batches):
        tables, weights = received(shared)
        total = 0
        for batch in slices(batches):
            words = [w.as_buffer().to_pybytes() for w in batch.column(0)]
            for run_ in in_parts(words, FITTED_WORDS):
                _, slots, bit = spelling([words[i] for i in run_])
                o1, o2, o3 = (t[2 * slot + bit] for t, slot in zip(tables, slots))
                total = total + slopes(weights, (4 * trust_of(o2) + trust_of(o3)).astype(np.int8), (o1, o2, o3), bit)
        if isinstance(total, np.ndarray):
            yield sums_batch(total)

    return run


def starting():
    """Weights to which fitted ones are drawn."""
    w = np.zeros((16, 4))
    for a in range(4):
        for b in range(4):
            w[4 * a + b] = max(0.1, 1 - TRUST[a] - TRUST[b]), TRUST[a], TRUST[b], 0.0
    return w


class Model:
    def __init__(self, words: Words, tables: dict, texts: list[bytes] = (), spellings: list[bytes] = (), weights=None, spell_weights=None):
        """texts and spellings: training texts and words that the starting weights are fitted on, where these are not given."""
        self.words = words
        self.none = predictor(tables["none"], 0.4)
        self.last, self.before = packed(*predictor(tables["last"], 0.05)), packed(*predictor(tables["before"], 0.05))
        self.spell = [predictor(tables[f"spell{k}"], 0.2) for k in range(3)]
        w = starting()
        self.weights, self.spell_weights = w if weights is None else weights, w[:, :3] if spell_weights is None else spell_weights
        if texts:
            codes, first, _ = tokenised(texts, by_begin(words))
            ask = ~repeats(codes, first)[1]
            last, before = (c[ask] for c in contexts(codes, first, words))
            who, node, bit = words.code.bits(words.symbols(codes, np.concatenate([words.kinds_of_words, np.arange(len(words.begins) + 1)]))[ask])
            none, _ = left_out(tables["none"], node, bit, 0.4)
            of_last, seen1 = left_out(tables["last"], hashed(last[who], node, words.slot_bits), bit, 0.05)
            of_before, seen2 = left_out(tables["before"], hashed(before[who] + 1000, node, words.slot_bits), bit, 0.05)
            self.weights = gated(w, 4 * seen1 + seen2, (none, of_last, of_before, np.full(len(bit), 0.3)), bit)
        if spellings:
            _, slots, bit = spelling(spellings)
            (o1, _), (o2, seen2), (o3, seen3) = (left_out(tables[f"spell{k}"], slot, bit, 0.2) for k, slot in enumerate(slots))
            self.spell_weights = gated(self.spell_weights, 4 * seen2 + seen3, (o1, o2, o3), bit)
        # how much of all spellings begins with each pair of bytes (a single one: is that word)
        begin = [10 ** self.spelled([w], len(w) < 2)[0] for w in words.begins]
        self.mass = np.log10(np.maximum([1 - sum(begin), *begin], 1e-12))

    def spelled(self, words: list[bytes], closed: bool = True):
        """log10 probabilities of spellings, or of all that begin so."""
        out = np.zeros(len(words))
        for run_ in in_parts(words, 20_000):
            who, slots, bit = spelling([words[i] for i in run_])
            (o1, _), (o2, t2), (o3, t3) = ((odds[s], trust[s]) for (odds, trust), s in zip(self.spell, slots))
            w = self.spell_weights[4 * t2.astype(np.int64) + t3]
            z = o1 * w[:, 0] + o2 * w[:, 1] + o3 * w[:, 2]
            cost = np.logaddexp(0, np.where(bit == 1, -z, z)) / np.log(10)
            if not closed:
                cost *= np.tile(np.frombuffer(b"".join(words[i] + b" " for i in run_), dtype=np.uint8) != 32, 8)
            out[run_] = -np.bincount(who, cost, len(run_))
        return out

    def mixed(self, symbols, last, before, doc, place, docs: int):
        """log10 probability of each symbol; doc: its text (0..docs-1), place: its place there."""
        out = np.zeros(len(symbols))
        weights = np.tile(self.weights.astype(np.float32).T, docs)  # a row for each input
        rows, code, slot_bits = weights.shape[1], self.words.code, self.words.slot_bits
        of_last, of_node = halves(last, code.node)
        none_at, sign_at = self.none[0][code.node], (2 * code.bit - 1).astype(np.float32)
        of_before, _ = halves(before + 1000, 0)
        block = np.where(place < FRESH, place // BLOCK, FRESH // BLOCK + (place - FRESH) // LATER)
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
            for a in range(0, len(part), 1 << 16):
                p = part[a : a + (1 << 16)]
                n, at = code.spread(symbols[p])
                half = of_node[at]
                o1 = self.last[slots_of(np.repeat(of_last[p], n) + half, slot_bits)]
                o2 = self.before[slots_of(np.repeat(of_before[p], n) + half, slot_bits)]
                row = np.repeat(doc[p] * 16, n) + (4 * trust_of(o1) + trust_of(o2))
                inputs = (none_at[at], o1, o2)
                z = weights[3][row] * np.float32(0.3)
                for k, x in enumerate(inputs):
                    z += weights[k][row] * x
                sign = sign_at[at]
                against = np.exp(np.minimum(-sign * z.astype(np.float64), 60))  # odds of the bit that did not come
                out[p] = -np.add.reduceat(np.log(1 + against), np.cumsum(n) - n) / np.log(10)  # each symbol has a bit or more
                wrong = sign * (against / (1 + against))
                rate = RATE / (np.bincount(row, minlength=rows) + 32)
                for k, x in enumerate((*inputs, np.float32(0.3))):
                    weights[k] += rate * np.bincount(row, wrong * x, rows)
        return out


def repeats(codes, first):
    """(whether a token had a prediction, whether it came true): the follower of its predecessor's last occurrence."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    order = np.lexsort((codes, first))
    same = (codes[order[1:]] == codes[order[:-1]]) & (first[order[1:]] == first[order[:-1]])
    earlier = np.full(n, -1, dtype=np.int64)
    earlier[order[1:]] = np.where(same, order[:-1], -1)
    at = np.arange(n)
    prior = np.where(at > first, earlier[np.maximum(at - 1, 0)], -1)
    has = prior >= 0
    return has, has & (codes == codes[np.minimum(prior + 1, n - 1)])


def repeat_costs(has, hit, first):
    """log10 probability of each token's repeat bit, counted within its text after a hit and after a miss."""
    n = len(has)
    at = np.arange(n)
    shown = np.where(has, at, -1)
    prev = np.maximum.accumulate(np.concatenate([[-1], shown[:-1]])) if n else at
    after = (prev >= first) & hit[np.maximum(prev, 0)]
    out = np.zeros(n)
    for state, (a, b) in ((False, (0.15, 4.0)), (True, (1.0, 2.0))):
        mine = has & (after == state)
        tries, hits = np.concatenate([[0], np.cumsum(mine)]), np.concatenate([[0], np.cumsum(mine & hit)])
        t, h = (tries[at] - tries[first])[mine], (hits[at] - hits[first])[mine]
        p = (h + a) / (t + b)
        out[mine] = np.log10(np.where(hit[mine], p, 1 - p))
    return out


def score_rows(shared):
    """For each text one row of sums, and a row for each of its words that is not among the frequent ones."""

    def run(batches):
        import pyarrow as pa

        model = received(shared)
        words, number = model.words, None
        hot, v = len(words.words), words.total + words.kinds + 1
        log_known = np.log10((words.counts + 1) / v)
        log_share = np.log10(1 - words.new) - np.log10(np.maximum(words.left, 1))
        log_rest = np.log10(np.maximum(words.counts[:hot], 1)) + log_share[words.kinds_of_words]
        for batch in slices(batches, 4000):
            number, names, kinds = words.numbering(), list(words.words), words.kinds_of_words
            texts = [t.as_buffer().to_pybytes() for t in batch.column(3)]
            rids, ids, held = (batch.column(k).to_pylist() for k in range(3))
            by_size = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            runs = [r[a : a + TEXTS] for r in in_parts([texts[i] for i in by_size]) for a in range(0, len(r), TEXTS)]
            for run_ in runs:
                mine = [by_size[i] for i in run_]
                codes, first, lens = tokenised([texts[i] for i in mine], number)
                doc = np.repeat(np.arange(len(mine)), lens)
                ends = np.cumsum(lens)
                has, hit = repeats(codes, first)
                logp = repeat_costs(has, hit, first)
                last, before = contexts(np.minimum(codes, hot), first, words)
                if len(number) > len(names):
                    more = list(islice(number, len(names), None))
                    names += more
                    kinds = np.concatenate([kinds, np.fromiter((words.kind.get(w[:2], 0) for w in more), dtype=np.int64, count=len(more))])
                ask = np.flatnonzero(~hit)
                symbols = words.symbols(codes, kinds)
                logp[ask] += model.mixed(symbols[ask], last[ask], before[ask], doc[ask], (ask - first[ask]), len(mine))
                escaped = ask[symbols[ask] >= words.escape]
                warm = escaped[codes[escaped] < hot]
                logp[warm] += log_rest[codes[warm]]
                cap = np.minimum(codes, hot)
                known = np.where(codes < 0, words.texts > 0, cap < hot)
                base = np.where(codes < 0, np.log10((words.texts + 1) / v), np.where(cap < hot, log_known[cap], 0.0))
                sums = [np.bincount(doc, x, len(mine)) for x in (known, base, logp)]
                rows = [[rids[i] for i in mine], [ids[i] for i in mine], [held[i] for i in mine], (lens).tolist(), sums[0].astype(np.int64).tolist(), sums[1].tolist(), sums[2].tolist(), [len(texts[i]) for i in mine]]
                rare = np.flatnonzero(codes >= hot)
                if len(rare):
                    pair, at, n = np.unique(doc[rare] * (len(names) + 1) + codes[rare], return_inverse=True, return_counts=True)
                    coded = np.bincount(at, ~hit[rare], len(pair)).astype(np.int64)
                    distinct, which = np.unique(pair % (len(names) + 1), return_inverse=True)
                    named = [names[k] for k in distinct.tolist()]
                    kind = kinds[distinct]
                    who = pair // (len(names) + 1)
                    # all words of training texts are known: only those of held-out texts may have to be spelled
                    maybe = np.unique(which[np.array(rows[2], dtype=bool)[who]])
                    spelled = np.full(len(named), np.nan)
                    spelled[maybe] = model.spelled([named[k] for k in maybe.tolist()]) - model.mass[kind[maybe]] + np.log10(words.new)[kind[maybe]]
                    tail = [np.array(rows[0])[who].tolist(), [named[k] for k in which.tolist()], n.tolist(), coded.tolist(), log_share[kind][which].tolist(), spelled[which].tolist()]
                else:
                    tail = [[], [], [], [], [], []]
                a, b = len(mine), len(tail[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0] + tail[0], pa.int64()), pa.array(rows[1] + [None] * b, pa.int64()), pa.array(rows[2] + [None] * b, pa.bool_())]
                    + [pa.array(x + [None] * b, k) for x, k in zip(rows[3:], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
                    + [pa.array([None] * a + x, k) for x, k in zip(tail[1:], (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                    names=[x.split()[0] for x in PARTS.split(", ")],
                )

    return run


def frequent(vocab: DataFrame, most: int) -> list:
    """The words that are frequent enough for at most ``most`` of them to be so, most frequent first."""
    return sorted(most_frequent(vocab, most).collect(), key=lambda r: (-r.n, bytes(r.word)))


def fitted_model(words: Words, tables: dict, training: DataFrame, vocab: DataFrame) -> Model:
    """The model with weights that one Newton step over all training texts, and over all words seen once, has fitted."""
    spark, once = training.sparkSession, vocab.where("n = 1").select("word")
    some = [bytes(x.t) for x in training.select(F.substring("t", 1, FIT_BYTES).alias("t"), F.xxhash64("t").alias("h")).orderBy("h", "t").limit(FIT_TEXTS).collect()]
    few = [bytes(x.word) for x in once.where("length(word) < 100").orderBy(F.xxhash64("word"), "word").limit(FIT_WORDS).collect()]
    begun = Model(words, tables, some, few)
    weights, spell_weights = begun.weights, begun.spell_weights
    del begun
    shared = send(spark, (words, {k: left_out_packed(tables[k], 0.4 if k == "none" else 0.05) for k in ("none", "last", "before")}, weights))
    weights = stepped(weights, starting(), summed(training.mapInArrow(fit_rows(shared), "sums binary").collect(), 4))
    shared.destroy()
    shared = send(spark, ([left_out_packed(tables[f"spell{k}"], 0.2) for k in range(3)], spell_weights))
    spell_weights = stepped(spell_weights, starting()[:, :3], summed(once.mapInArrow(fit_spelling_rows(shared), "sums binary").collect(), 3))
    shared.destroy()
    return Model(words, tables, weights=weights, spell_weights=spell_weights)


def scores(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", fold) == held).alias("held_out"), text_bytes().alias("t"))
    training = rows.where("NOT held_out").select("t")
    with scratch(spark) as tmp:
        counted = training.mapInArrow(count_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        all_words = tmp.table(counted, "words")
        vocab = all_words.where("word <> X''")
        totals = vocab.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("single")).first()
        texts = all_words.where("word = X''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        top = frequent(vocab, max(HOT, 2 * isqrt(totals["n"] + texts)))
        begins = vocab.groupBy(F.substring("word", 1, 2).alias("w")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
        words = Words([bytes(r.word) for r in top], [r.n for r in top], texts, totals["n"] + texts, totals["kinds"] + (texts > 0), totals["single"], [(bytes(r.w), r.n, r.once) for r in begins])
        shared = send(spark, words)
        bits = training.mapInArrow(bit_rows(shared), "name string, slice int, counts binary").union(vocab.select("word").mapInArrow(spell_rows, "name string, slice int, counts binary"))
        sums = bits.groupBy("name", "slice").applyInArrow(added, "name string, slice int, counts binary")
        shapes = {"none": 2 * words.code.nodes, "last": 2 << words.slot_bits, "before": 2 << words.slot_bits} | {f"spell{k}": 2 << SPELL_BITS for k in range(3)}
        tables = {k: np.zeros(n, dtype=np.int32) for k, n in shapes.items()}
        for r in sums.collect():
            counts = np.frombuffer(zlib.decompress(bytes(r.counts)), dtype="<i8")
            if counts.max() >= 2**31 and tables[r.name].dtype == np.int32:
                tables[r.name] = tables[r.name].astype(np.int64)
            np.array_split(tables[r.name], SLICES)[r.slice][:] = counts
        model = send(spark, fitted_model(words, tables, training, vocab))
        parts = tmp.table(rows.mapInArrow(score_rows(model), PARTS), "parts")
        v = words.total + words.kinds + 1
        tail = parts.where("word IS NOT NULL").select("rid", "word", F.col("n").alias("times"), "coded", "share", "spelled").join(vocab, "word", "left")
        known = F.col("n").isNotNull()
        fitted = F.when(known, F.log10(F.coalesce("n", F.lit(1))) + F.col("share")).otherwise(F.col("spelled"))
        more = tail.groupBy("rid").agg(F.sum(F.when(known, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(v)))).alias("base2"), F.sum(F.col("coded") * fitted).alias("score2"))
        heads = parts.where("word IS NULL").select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes")
        out = heads.join(more, "rid", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(int(words.total)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
            # null for an empty text
            F.when(F.col("n_bytes") > 0, -(F.col("score") + F.coalesce("score2", F.lit(0.0))) / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
        )
        return cut(out)
