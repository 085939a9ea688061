"""Similarity join of documents by n-gram sets: a prefix-tree join inside partitions that lose no link.

1. Each document becomes the set of its distinct word n-grams (64-bit hashes). Documents with the same
   set are one node, named by a hash of the set's digest.
2. Partitions. Hash space is cut into k + 1 ranges, where k is the largest symmetric difference that
   two linked sets of this size can have. Linked sets agree on at least one whole range, so equal range
   signatures bring every link together (no loss). Of the sets with one signature those are tied whose
   sketches (parities of n-grams by hash) differ in no more places than linked sets can differ in
   n-grams, by as few edges as connect them, never in pairs: so texts that only share a passage part.
   Connected components are the partitions. A signature that many sets of one task have is combined
   before the one exchange, and ties all its sets.
3. In a partition, sets ordered by one global order (the most frequent n-grams of all partitions first,
   then by hash) form a trie. Links are found by walking it: overlap counted along a path is shared by
   all sets below it, and a subtree is left as soon as the n-grams still ahead cannot reach the needed
   overlap. Sets already in one component are not compared again.
   A partition larger than two blocks is first joined block by block, each with its smallest set (the
   pivot). Only sets not yet connected with the pivot then meet the other blocks.
4. Components of the links give the answer.

Defined cases: null text, empty text and text without words have an empty set and link with nothing
(component is their own id); with fewer words than n the whole word sequence is the one n-gram;
repeated rows and rows with the same id are members of one component like any copies; an empty table
gives no rows; other columns are ignored, whatever their names; texts of any length are taken whole.
Two n-grams count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from math import ceil, exp, floor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import bits_for, components, cut, frugal, keep_rows, looked_up, most_frequent, perhaps_in, scratch, slices, text_bytes

#: Sets, and n-grams, of a block; one task compares at most two blocks with each other.
BLOCK, BLOCK_GRAMS = 1024, 1_000_000
REMEMBERED = 400_000
#: Signatures that a task looks at together, digests that it remembers, and n-grams of the table that orders them.
COMBINED, DIGESTS, RANKED = 1_000_000, 500_000, 1 << 16
#: Sets with one signature: in one task, from which they are combined; in all, up to which sketches are compared.
MANY, GROUP = 512, 16384
#: Bits of a sketch: at least, and at most; between them it has about five for each n-gram that linked sets may lack.
SKETCH = 256, 1 << 16
SETS = "doc_id long, n_shingles long, text_hash long, digest binary, sketch binary, keys binary"


class Sizes:
    """Size classes for a threshold: sizes of linked sets lie in one class or in two neighbouring ones."""

    def __init__(self, threshold: Fraction):
        self.t, self.lows = threshold, [1, 2]

    def low(self, c: int) -> int:
        """Smallest size of class c; a set linked with one of class c is below class c + 2."""
        while len(self.lows) <= c:
            last = self.lows[-1]
            self.lows.append(max(last + 1, floor((last - 1) / self.t) + 1))
        return self.lows[c]

    def of(self, n: int) -> int:
        while self.low(len(self.lows) - 1) <= n:
            self.low(len(self.lows))
        return bisect_right(self.lows, n) - 1

    def ranges(self, c: int) -> tuple[int, int]:
        """(hash ranges, most ranges that may differ) for pairs whose smaller set is of class c.

        More ranges than must be, so that some equal range holds n-grams even if a few are empty.
        """
        smaller = self.low(c + 1) - 1
        differ = floor(smaller * (1 - self.t) / self.t)
        m = differ + 3
        return m + ceil(3 * m * exp(-smaller / m)), differ


def need(a: int, b: int, t: Fraction) -> int:
    """Smallest overlap of sets of sizes a and b with |intersection| >= t * |union|."""
    return -(-(t.numerator * (a + b)) // (t.numerator + t.denominator))


def mix(x):
    """A 64-bit finaliser over a numpy array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams_of(hashes, n: int):
    """Sorted distinct n-gram hashes of a sequence of word hashes."""
    if len(hashes) == 0:
        return hashes
    with np.errstate(over="ignore"):
        if len(hashes) < n:
            g = mix(np.array([len(hashes)], dtype=np.uint64) + np.uint64(77))
            for h in hashes:
                g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h)
            return g
        g = mix(hashes[: len(hashes) - n + 1])
        for i in range(1, n):
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i])
        return np.unique(g)


def signatures(grams, sizes: Sizes):
    """A hash for each hash range and size class in which this set may meet a linked one.

    Of at least (ranges - differ) equal ranges one has n-grams, unless so many are empty in both
    sets; only then signatures of empty ranges are needed. Sets that may not differ at all are linked
    only if equal, and those are collapsed before.
    """
    n, out = len(grams), [np.zeros(0, dtype=np.uint64)]
    own = sizes.of(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        for c in (own, own - 1):
            if c < 0:
                continue
            m, differ = sizes.ranges(c)
            if not differ:
                continue
            cuts = np.array([(i << 64) // m for i in range(1, m)], dtype=np.uint64)
            ends = np.concatenate([[0], np.searchsorted(grams, cuts), [n]])
            part, full = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
            key = mix(mix(part + np.uint64(c * 1_000_003)) + np.arange(m, dtype=np.uint64) + (full.astype(np.uint64) << np.uint64(32)))
            out.append(key if np.count_nonzero(full == 0) >= m - differ else key[full > 0])
    return np.concatenate(out)


def sketch_of(grams, t: Fraction) -> bytes:
    """For each of some places the parity of the n-grams there; sets differ in at least as many n-grams as their sketches in places."""
    bits = SKETCH[0]
    while bits < min(5 * len(grams) * (1 - t), SKETCH[1]):
        bits *= 2
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]):
    """Sketches of one length, that of the shortest: halves of a longer one are laid over each other."""
    out, least = [], min(map(len, sketches))
    for raw in sketches:
        x = np.frombuffer(raw, dtype=np.uint64)
        while len(x) * 8 > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


def may_link(sketches, sizes, t: Fraction) -> list[tuple[int, int]]:
    """Pairs that connect exactly the sets that all pairs do whose sketches are near enough to be linked."""
    sizes, groups, out = np.asarray(sizes), np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        others = np.flatnonzero(groups[i + 1 :] != groups[i]) + i + 1
        if not len(others):
            continue
        differ = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        near = others[(t.denominator + t.numerator) * differ <= (t.denominator - t.numerator) * (sizes[others] + sizes[i])]
        if len(near):
            found, first = np.unique(groups[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            groups[np.isin(groups, found)] = groups[i]
    return out


def tie_rows(t: Fraction):
    """(u, v) of the sets to be tied, from (key, node, size, sketch) sorted by key."""

    def run(batches):
        import pyarrow as pa

        def ties(keys, nodes, sizes, raw):
            us, vs = [], []
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            for a, b in zip(edges[:-1], edges[1:]):
                some = a + np.unique(nodes[a:b], return_index=True)[1]
                for i, j in may_link(folded([raw[k] for k in some]), sizes[some], t):
                    us.append(nodes[some[i]])
                    vs.append(nodes[some[j]])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        rest = None
        for batch in batches:
            keys, nodes, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            raw = batch.column(3).to_pylist()
            if rest is not None:
                keys, nodes, sizes, raw = np.concatenate([rest[0], keys]), np.concatenate([rest[1], nodes]), np.concatenate([rest[2], sizes]), rest[3] + raw
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield ties(keys[:last], nodes[:last], sizes[:last], raw[:last])
            rest = keys[last:], nodes[last:], sizes[last:], raw[last:]
        if rest is not None:
            yield ties(*rest)

    return run


def hashes_of_words():
    """Word hashes by word, remembered."""
    import xxhash

    class Hashes(dict):
        def __missing__(self, w):
            self[w] = h = xxhash.xxh64_intdigest(w)
            return h

    return Hashes()


def sets_of(texts, n: int, lower: bool):
    """The n-gram set of each text."""
    known = hashes_of_words()
    for t in texts:
        if len(known) > REMEMBERED:
            known = hashes_of_words()
        b = t.as_buffer().to_pybytes()
        w = (b.lower() if lower else b).split()
        yield grams_of(np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w)), n)


def digest_of(grams) -> bytes | None:
    import hashlib

    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def set_rows(n: int, threshold: Fraction, lower: bool):
    """(doc_id, size of the set, hash of the text, digest, sketch, signatures) of each document."""

    def run(batches):
        from itertools import chain

        import pyarrow as pa

        sizes = Sizes(threshold)
        parts, texts = [], slices(batches)

        def each():
            for batch in texts:
                parts.append(batch)
                yield batch.column(2)

        sets = sets_of(chain.from_iterable(each()), n, lower)
        ns, digests, sketches, keys = [], [], [], []
        for g in sets:
            ns.append(len(g))
            digests.append(digest_of(g))
            sketches.append(sketch_of(g, threshold) if len(g) else None)
            keys.append(signatures(g, sizes).tobytes() if len(g) else b"")
            if len(ns) == parts[-1].num_rows:
                yield pa.RecordBatch.from_arrays([parts[-1].column(0), pa.array(ns, pa.int64()), parts[-1].column(1), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.binary())], names=[x.split()[0] for x in SETS.split(", ")])
                ns, digests, sketches, keys = [], [], [], []
                parts.clear()

    return run


def gram_rows(n: int, lower: bool):
    """(digest, n-grams) of each different set that a task sees."""

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in slices(batches, 200):
            digests, grams = [], []
            for g in sets_of(batch.column(0), n, lower):
                d = digest_of(g)
                if d is not None and d not in seen:
                    if len(seen) > DIGESTS:
                        seen.clear()
                    seen.add(d)
                    digests.append(d)
                    grams.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(grams, pa.binary())], names=["digest", "grams"])

    return run


def key_rows(batches):
    """(key, node): nodes with one key share a signature; where one node is null, all of them are to be tied.

    Of many nodes that a task sees with one signature only the smallest goes on under it; the others are
    tied to it. So a signature that a third of all sets share has a row or so a task.
    """
    import pyarrow as pa

    seen: set = set()
    nodes, raws, size = [], [], 0

    def combined():
        keys = np.frombuffer(b"".join(raws), dtype=np.uint64)
        owner = np.repeat(np.array(nodes, dtype=np.int64), [len(r) // 8 for r in raws])
        order = np.lexsort((owner, keys))
        at = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
        times = np.diff(np.append(at, len(keys)))
        hub, tied = np.empty_like(owner), np.zeros(len(keys), dtype=bool)
        hub[order] = np.repeat(owner[order[at]], times)
        tied[order] = np.repeat(times > MANY, times)
        many = keys[order[at[times > MANY]]]
        tied &= owner != hub
        tie = np.unique(np.stack([owner, hub], axis=1)[tied], axis=0)
        with np.errstate(over="ignore"):
            own = mix(mix(tie[:, 0].astype(np.uint64)) + tie[:, 1].astype(np.uint64))
        # in the order of the nodes, which repeat and so take little room
        key = np.concatenate([keys[~tied], own, own, own, many]).astype(np.int64)
        node = np.concatenate([owner[~tied], tie[:, 0], tie[:, 1], np.zeros(len(tie) + len(many), dtype=np.int64)])
        null = np.arange(len(node)) >= len(node) - len(tie) - len(many)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node, mask=null)], names=["key", "node"])

    for batch in batches:
        for node, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if node in seen:
                continue
            if len(seen) > DIGESTS:
                seen.clear()
            seen.add(node)
            nodes.append(node)
            raws.append(raw.as_buffer().to_pybytes())
            size += len(raws[-1]) // 8
            if size > COMBINED:
                yield combined()
                nodes, raws, size = [], [], 0
    if size:
        yield combined()


def often(batches):
    """(n-gram, count) of the most frequent n-grams of some sets."""
    import pyarrow as pa

    for batch in slices(batches):
        raw = np.frombuffer(b"".join(g.as_buffer().to_pybytes() for g in batch.column(0)), dtype=np.int64)
        values, times = np.unique(raw, return_counts=True)
        some = np.flatnonzero(times > 1)
        some = some[np.argsort(-times[some], kind="stable")][:RANKED]
        yield pa.RecordBatch.from_arrays([pa.array(values[some]), pa.array(times[some])], names=["gram", "n"])


class Trie:
    """A prefix tree over sorted rank sequences, walked level by level.

    A level is SLAB ranks deep. Sequences are held in lexicographic order, so those below a node are
    neighbours: a sequence begins a new node of level l if it shares fewer than (l + 1) * SLAB ranks
    with the one before.
    """

    SLAB = 16

    def __init__(self, seqs: list, values: int):
        self.order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.seqs = [seqs[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.seqs])
        shared = [0]
        for a, b in zip(self.seqs, self.seqs[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(differ[0]) if len(differ) else m)
        levels = -(-int(self.sizes.max()) // self.SLAB)
        self.nodes = [np.cumsum(np.array(shared) < (k + 1) * self.SLAB) for k in range(levels)]
        self.slabs, self.reach = [], []
        for k in range(levels):
            reach = np.flatnonzero(self.sizes > k * self.SLAB)
            rows = np.full((len(reach), self.SLAB), values, dtype=np.int32)  # the rank beyond all others fills up
            for row, i in zip(rows, reach):
                part = self.seqs[i][k * self.SLAB : (k + 1) * self.SLAB]
                row[: len(part)] = part
            self.slabs.append(rows)
            self.reach.append(reach)

    def linked_with(self, at: int, has, t: Fraction, groups):
        """Sequences after ``at`` (whose ranks are marked in ``has``) that are linked with it and in another group.

        Overlap is counted once a node. A subtree is left when it has missed more ranks than the
        longest set that can be linked may miss.
        """
        size = int(self.sizes[at])
        low, high = -(-t.numerator * size // t.denominator), size * t.denominator // t.numerator
        allowed = high - need(size, high, t)
        sizes = self.sizes[at + 1 :]
        live = np.flatnonzero((groups[at + 1 :] != groups[at]) & (sizes >= low) & (sizes <= high)) + at + 1
        hits, out = np.zeros(len(live), dtype=np.int64), []
        for k, rows in enumerate(self.slabs):
            if not len(live):
                break
            node = self.nodes[k][live]
            first = np.concatenate([[True], node[1:] != node[:-1]])
            hits = hits + has[rows[np.searchsorted(self.reach[k], live[first])]].sum(axis=1)[np.cumsum(first) - 1]
            n, depth = self.sizes[live], (k + 1) * self.SLAB
            ended = n <= depth
            out.append(live[ended & (hits >= need(size, n, t))])
            on = ~ended & (depth - hits <= allowed)
            live, hits = live[on], hits[on]
        return np.concatenate(out) if out else live


def linked(sets: list, t: Fraction, ranked=None, groups=None) -> list[tuple[int, int]]:
    """Links (positions in ``sets``) that connect exactly the sets that all links connect.

    ranked: n-grams that come first in the global order, in that order; others follow by hash.
    groups: numbers of sets known to be connected.
    """
    if len(sets) < 2:
        return []
    values, back = np.unique(np.concatenate(sets), return_inverse=True)
    ranked = np.zeros(0, dtype=np.uint64) if ranked is None else ranked
    by_value = np.argsort(ranked)
    at = np.minimum(np.searchsorted(ranked[by_value], values), max(len(ranked) - 1, 0))
    place = np.full(len(values), len(ranked))
    if len(ranked):
        place = np.where(ranked[by_value][at] == values, by_value[at], place)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, place))] = np.arange(len(values))
    ranks = rank[back]
    ends = np.cumsum([len(s) for s in sets])
    trie = Trie([np.sort(ranks[e - len(s) : e]) for e, s in zip(ends, sets)], len(values))
    groups = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1][trie.order]
    links: list = []
    has = np.zeros(len(values) + 1, dtype=np.int64)
    for i, s in enumerate(trie.seqs):
        has[s] = 1
        found = trie.linked_with(i, has, t, groups)
        has[s] = 0
        if len(found):
            others, first = np.unique(groups[found], return_index=True)
            links += [(trie.order[i], trie.order[j]) for j in found[first]]
            groups[np.isin(groups, others)] = groups[i]
    return links


def similar_groups(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), lower: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash, and first (a number of the component; null for empty sets)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash"), text_bytes().alias("t"))
    with scratch(spark) as tmp:
        sets = tmp.table(base.mapInArrow(frugal(set_rows(n, threshold, lower)), SETS), "sets")
        for seed in range(100):  # until no two sets have the same 64-bit name
            node = F.when(F.col("digest").isNotNull(), F.xxhash64("digest", F.lit(seed))).alias("node")
            rows = sets.select("doc_id", "n_shingles", "text_hash", node, "digest", "sketch")
            names = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.min("text_hash").alias("some_text"), F.min("n_shingles").alias("size"), F.min("sketch").alias("sketch"), F.min("digest").alias("a"), F.max("digest").alias("z")))
            if names.where("a <> z").isEmpty():
                break
        total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        clusters = components(_candidates(sets.where("digest IS NOT NULL").select(node, "keys"), names, threshold))
        asked = cut(clusters.join(names.select("node", "some_text"), "node"))
        some = perhaps_in(base, F.col("text_hash"), asked.select("some_text"), bits=bits_for(asked.count())).where("perhaps").select("t")
        grams = some.mapInArrow(frugal(gram_rows(n, lower)), "digest binary, grams binary").select(F.xxhash64("digest", F.lit(seed)).alias("node"), "grams")
        held = tmp.table(grams.join(asked.select("node", "component"), "node"), "grams")
        found = components(_links(held, clusters, threshold, block))
        named = names.select("node", "low", "n").join(found, "node", "left").select("node", "low", "n", F.coalesce("component", "node").alias("first"))
        least = named.groupBy("first").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
        named = cut(looked_up(named.withColumnRenamed("n", "rows"), cut(least), "first", named.count()).select("node", F.col("rows").alias("n"), "first", "component_id"))
        out = looked_up(rows.where("node IS NOT NULL").drop("digest", "sketch"), named, "node", total)
        alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("first"))
        return cut(out.select("doc_id", "n_shingles", "component_id", "text_hash", "first").unionByName(alone))


def _candidates(keyed: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """Edges (u, v) whose components hold all links. keyed: node, keys; nodes: node, size, sketch."""
    group = Window.partitionBy("key")
    sums = {"n": F.count("*"), "lo": F.min("node"), "hi": F.max("node"), "members": F.bit_xor(F.xxhash64("node")), "all": F.max(F.col("node").isNull())}
    met = keyed.mapInArrow(frugal(key_rows), "key long, node long").select("key", "node", *[f.over(group).alias(k) for k, f in sums.items()])
    met = cut(met.where("lo <> hi AND node IS NOT NULL"))
    whole = F.col("all") | (F.col("n") > GROUP)
    sure = met.where(whole).select(F.col("node").alias("u"), F.col("lo").alias("v"))
    # near copies share many signatures: one of those with the same members will do
    once = met.where(~whole).groupBy("n", "lo", "hi", "members").agg(F.min("key").alias("key")).select("key")
    asked = met.where(~whole).join(once, "key", "left_semi").select("key", "node").join(nodes.select("node", "size", "sketch"), "node")
    sorted_ = asked.select("key", "node", "size", "sketch").repartition("key").sortWithinPartitions("key", "node")
    return sure.where("u <> v").unionByName(sorted_.mapInArrow(frugal(tie_rows(t)), "u long, v long"))


def _links(held: DataFrame, clusters: DataFrame, t: Fraction, block: int) -> DataFrame:
    """Links (u, v) that connect the sets of each candidate cluster as all its links do. held: node, component, grams."""
    spark = held.sparkSession
    counted = cut(held.select("grams").mapInArrow(frugal(often), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    top = sorted(most_frequent(counted, RANKED).collect(), key=lambda r: (-r.n, r.gram))
    ranked = spark.sparkContext.broadcast(np.array([r.gram for r in top], dtype=np.int64).tobytes())

    def check(key, table):
        import pyarrow as pa

        sets: dict = {}
        for node, group, raw in zip(table.column("node").to_pylist(), table.column("grp").to_pylist(), table.column("grams")):
            sets[node] = group, raw  # a set that several tasks saw comes several times
        nodes = sorted(sets)
        pairs = linked([np.frombuffer(sets[x][1].as_buffer(), dtype=np.uint64) for x in nodes], t, np.frombuffer(ranked.value, dtype=np.uint64), [sets[x][0] for x in nodes])
        return pa.table({"u": pa.array([nodes[a] for a, _ in pairs], pa.int64()), "v": pa.array([nodes[b] for _, b in pairs], pa.int64())})

    sized = held.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("grams") / 8).alias("held"))
    sized = cut(sized.select("component", "n", F.ceil(F.greatest(F.col("n") / block, F.col("held") / BLOCK_GRAMS)).cast("int").alias("parts")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = looked_up(held, sized, "component", total).withColumn("part", F.when(F.col("parts") <= 2, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    large = dealt.where("parts > 2")
    # the pivot of a large cluster, its smallest set, goes to every block
    pivots = large.where("node = component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = dealt.where("NOT (parts > 2 AND node = component)").unionByName(pivots).select("component", "part", "node", F.col("node").alias("grp"), "grams")
    links = cut(first.groupBy("component", "part").applyInArrow(check, "u long, v long"))
    large = sized.where("parts > 2").drop("parts")
    if large.isEmpty():
        return links
    # what is not yet connected with the pivot meets all other blocks of its cluster
    now = components(links).select(F.col("node").alias("of"), F.col("component").alias("grp"))
    pivot = cut(large.join(now, F.col("component") == F.col("of"), "left").select("component", "n", F.coalesce("grp", "component").alias("pivot")))
    grouped = held.join(now, F.col("node") == F.col("of"), "left").withColumn("grp", F.coalesce("grp", "node")).drop("of")
    split = looked_up(grouped, pivot, "component", total).withColumn("done", F.col("grp") == F.col("pivot")).drop("pivot")
    sizes = cut(split.groupBy("component").agg(*[F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.when(own, 1).otherwise(0)) / block, F.sum(F.when(own, F.length("grams")).otherwise(0)) / (8 * BLOCK_GRAMS)))).cast("int").alias(k) for k, own in (("others", ~F.col("done")), ("joined", F.col("done")))], F.count_if(~F.col("done")).alias("left"), F.count("*").alias("n")).where("left > 0").drop("left"))
    placed = looked_up(split, sizes, "component", total)
    part = F.when(F.col("done"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("joined"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    other = F.when(F.col("done"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("others") + F.col("joined") - 1), F.col("part")))
    units = placed.withColumn("part", part).withColumn("other", F.explode(other))
    units = units.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "grp", "grams")
    return links.union(units.groupBy("component", "i", "j").applyInArrow(check, "u long, v long"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """docs with one document (the smallest id) of each group of near copies; the columns stay as they are.

    Documents without words are groups of their own. Of rows with the same id and text one stays, that
    with the smallest JSON form.
    """
    groups = cut(similar_groups(docs, n, threshold).select("first", "doc_id", F.col("text_hash").alias("mark")))
    some = groups.where("first IS NOT NULL")
    best = cut(some.groupBy("first").agg(F.min(F.struct("doc_id", "mark")).alias("best"), F.count("*").alias("n")))
    judged = looked_up(some, best, "first", some.count()).select("doc_id", "mark", F.expr("struct(doc_id, mark) <=> best").alias("kept"))
    empty = groups.where("first IS NULL").select("doc_id", "mark").distinct().withColumn("kept", F.lit(True))
    return keep_rows(docs, F.xxhash64(F.col("text")), judged.unionByName(empty))
