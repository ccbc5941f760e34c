"""Set similarity join of documents on word n-grams with adaptive multi-match prefixes (operator 5).

Two sets with an overlap of at least T share at least l of their first n - T + l tokens in any common order.  Tokens are
ordered by an estimate of their frequency (word frequencies, and counts of the heaviest n-grams, both over all
documents), so prefixes hold rare tokens.  Every document chooses its own l from the lengths of the posting lists that
its prefix meets: a longer prefix costs more look-ups and asks for more shared tokens before a pair is verified.

Documents of equal sets are one member, named by half of the set's fingerprint.  Groups of near copies are tied first:
in each round every posting list that spans several groups names a pivot, and those that share enough tokens with a
pivot of another group are verified against it; after that only pairs across the groups found are generated, so no group
makes all its pairs.  A pair is generated only where a signature of its sets allows the overlap that it needs.  Every
link is verified on the whole sets; no candidate is dropped.

Input rules: a null or blank text has an empty set and links with nothing; fewer words than n make one token of them
all; rows that repeat an id are one document, linked with whatever one of them is linked with; equal similarities need
no order; a null id is never linked and keeps a null component; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, enter, materialize, text_or_empty
from tessera.llm._words import GOLDEN, mix, word_hashes
from tessera.llm.components import components

LEVELS = 4
WORD_BUCKETS = 1 << 18
ROUNDS = 3
SIGNATURE = 4  # longs


def grams_of(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each place where an n-gram of a text begins, one for all words of a text of fewer, and their number in
    each text.  `words` are those of all texts, `counts` of each."""
    per = np.where(counts < n, np.minimum(counts, 1), counts - n + 1)
    out = np.empty(int(per.sum()), dtype=np.uint64)
    starts, places = np.cumsum(counts) - counts, np.cumsum(per) - per

    def chain(at, k: int) -> np.ndarray:
        x = mix(words[at] + np.uint64(k * int(GOLDEN) & (1 << 64) - 1))
        for i in range(1, k):
            x = mix(x * GOLDEN + words[at + i])
        return x

    if len(words) >= n and (counts >= n).any():
        begins = _begins(counts, per, starts, n)
        out[np.repeat(counts >= n, per)] = chain(begins, n)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            out[places[short]] = chain(starts[short], k)
    return out, per


def _begins(counts: np.ndarray, per: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Places among all words where an n-gram of a text of n words or more begins."""
    long = counts >= n
    m = per[long]
    return np.arange(int(m.sum())) + np.repeat(starts[long] - (np.cumsum(m) - m), m)


def distinct(grams: np.ndarray, per: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text's hashes."""
    out, lo = [], 0
    for m in per.tolist():
        g = np.sort(grams[lo : lo + m])
        lo += m
        if m > 1:
            g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        out.append(g)
    return out


def least_overlap(n, num: int, den: int):
    """The overlap that a set of n tokens must have with any partner."""
    return -(-n * num // den)


def index_overlap(n, num: int, den: int):
    """The overlap that a set of n tokens must have with any partner that is not smaller."""
    return -(-2 * n * num // (num + den))


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens in 64 * SIGNATURE classes.  Two sets whose signatures differ in d bits differ in d tokens
    or more."""
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & 64 * SIGNATURE - 1, minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


@dataclass
class Frequencies:
    """Words in all; occurrences per word bucket; the heaviest n-grams (sorted) and their counts."""

    words: int
    buckets: np.ndarray
    heavy: np.ndarray
    heavy_counts: np.ndarray

    def __post_init__(self):
        self.log_share = np.log2(np.maximum(self.buckets, 1) / max(1, self.words)).astype(np.float32)
        self.maybe = np.zeros(1 << 20, dtype=np.bool_)
        self.maybe[(self.heavy >> np.uint64(20)).astype(np.int64) & (1 << 20) - 1] = True

    def classes(self, words: np.ndarray, counts: np.ndarray, grams: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
        """A number from 0 (rarest) to 60 of the estimated frequency of each of `grams_of`'s n-grams."""
        share = self.log_share[words.astype(np.int64) & WORD_BUCKETS - 1]
        est = np.empty(len(grams), dtype=np.float32)
        starts, places = np.cumsum(counts) - counts, np.cumsum(per) - per
        if (counts >= n).any():
            at = _begins(counts, per, starts, n)
            est[np.repeat(counts >= n, per)] = sum(share[at + i] for i in range(n))
        for k in range(1, n):
            short = np.flatnonzero(counts == k)
            if len(short):
                est[places[short]] = sum(share[starts[short] + i] for i in range(k))
        est += np.float32(np.log2(max(1, self.words)))
        met = np.flatnonzero(self.maybe[(grams >> np.uint64(20)).astype(np.int64) & (1 << 20) - 1])
        if len(met) and len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, grams[met]), len(self.heavy) - 1)
            hit = self.heavy[at] == grams[met]
            est[met[hit]] = np.maximum(est[met[hit]], np.log2(self.heavy_counts[at[hit]]))
        return np.clip(np.floor(est) + 1, 0, 60).astype(np.uint8)


def _statistics(n: int, share: float):
    """Partial counts of a task: kind 0 texts and words, 1 word buckets, 2 n-grams that are heavy in a run of its texts."""

    def run(batches):
        enter("jaccard")
        buckets, texts, words = np.zeros(WORD_BUCKETS, dtype=np.int64), 0, 0
        held: list[np.ndarray] = []
        size = docs = 0

        def heavy():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(3, int(share * docs))
            held.clear()
            return rows(2, g[keep].view(np.int64), c[keep])

        def rows(kind, key, count):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(np.asarray(key, dtype=np.int64)), pa.array(np.asarray(count, dtype=np.int64))], names=["kind", "key", "n"])

        for b in batches:
            for part in _slices(b.column("t")):
                w, counts = word_hashes(part)
                buckets += np.bincount(w.astype(np.int64) & WORD_BUCKETS - 1, minlength=WORD_BUCKETS)
                some = int((counts > 0).sum())
                texts, words, docs = texts + some, words + len(w), docs + some
                held.append(grams_of(w, counts, n)[0])
                size += len(held[-1])
                if size > 2_000_000:
                    yield heavy()
                    size = docs = 0
        if held:
            yield heavy()
        met = np.flatnonzero(buckets)
        yield rows(1, met, buckets[met])
        yield rows(0, [0, 1], [texts, words])

    return run


def _slices(texts: pa.Array, size: int = 1 << 21):
    """Runs of texts of about `size` bytes."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size)))
        yield texts.slice(lo, hi - lo)
        lo = hi


def frequencies(docs: DataFrame, n: int, share: float = 0.001) -> Frequencies:
    """Counts over all documents; what comes to the driver is bounded by the buckets and by 1 / share."""
    got = docs.select("t").mapInArrow(_statistics(n, share), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    got = materialize(got, "jaccard-counts")
    totals = {r.key: r.n for r in got.filter("kind = 0").collect()}
    pdf = got.filter((F.col("kind") == 1) | (F.col("n") >= max(2.0, share * totals.get(0, 0)))).filter("kind > 0").toPandas()
    discard(got)
    buckets = np.ones(WORD_BUCKETS)
    w = pdf[pdf.kind == 1]
    buckets[w.key.to_numpy()] = w.n.to_numpy()
    h = pdf[pdf.kind == 2]
    keys = h.key.to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Frequencies(totals.get(1, 0), buckets, keys[order], h.n.to_numpy(dtype=np.float64)[order])


def _sets(freq, n: int, num: int, den: int):
    """Per row: a number of its own, set size, the set's fingerprint, its signature and longest prefix in the common order."""

    def run(batches):
        enter("jaccard")
        f: Frequencies = freq.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for b in batches:
            sizes, keys, signs, prefixes = [], [], [], []
            for part in _slices(b.column("t")):
                w, counts = word_hashes(part)
                g, per = grams_of(w, counts, n)
                rank, lo = f.classes(w, counts, g, per, n), 0
                for m in per.tolist():
                    own = g[lo : lo + m]
                    order = np.argsort(own)
                    u = own[order]
                    first = np.concatenate(([True], u[1:] != u[:-1])) if m else np.zeros(0, dtype=np.bool_)
                    u, r = u[first], rank[lo : lo + m][order[first]]
                    lo += m
                    sizes.append(len(u))
                    keys.append(xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63))
                    take = len(u) - least_overlap(len(u), num, den) + LEVELS
                    signs.append(signature(u) if m else np.zeros(SIGNATURE, dtype=np.int64))
                    prefixes.append(u[np.argsort(r, kind="stable")[:take]].tobytes())
            s = np.stack(signs) if signs else np.zeros((0, SIGNATURE), dtype=np.int64)
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tk"), rows, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(s[:, i]) for i in range(SIGNATURE)), pa.array(prefixes, pa.binary())], names=["id", "tk", "row", "n", "k", *(f"s{i}" for i in range(SIGNATURE)), "prefix"])

    return run


def _postings(num: int, den: int):
    """A row per prefix token: its place in the order, and the smallest l whose prefix holds it, for the larger set of a
    pair (`level`), which looks tokens up, and for the smaller (`inner`), which is looked up and has a shorter prefix."""

    def run(batches):
        for b in batches:
            sizes = b.column("n").to_numpy()
            prefixes = b.column("prefix").to_pylist()
            per = np.array([len(p) // 8 for p in prefixes], dtype=np.int64)
            own = np.repeat(np.arange(len(per)), per)
            place = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
            n = sizes[own]
            level = np.maximum(1, place + 1 - (n - least_overlap(n, num, den)))
            inner = np.maximum(1, place + 1 - (n - index_overlap(n, num, den)))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), dtype=np.int64)), b.column("k").take(pa.array(own)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(inner.astype(np.int32))], names=["token", "k", "n", "place", "level", "inner"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        enter("jaccard")
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sides = []
                for c in ("ta", "tb"):
                    d = part.column(c).dictionary_encode()
                    each = distinct(*grams_of(*word_hashes(d.dictionary), n))
                    sides.append([each[i] for i in d.indices.to_pylist()])
                keep = []
                for x, y in zip(*sides):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * inter >= num * (len(x) + len(y) - inter))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    return materialize(both.mapInArrow(run, "a bigint, b bigint"), "jaccard-links")


def _allowed(num: int, den: int, x: str = "", y: str = "p") -> str:
    """Whether the signatures of two sets allow the overlap that they need: sets that differ in d tokens share
    (na + nb - d) / 2."""
    d = " + ".join(f"bit_count({x}s{i} ^ {y}s{i})" for i in range(SIGNATURE))
    return f"{num + den} * ({x}n + {y}n - ({d})) >= {2 * num} * ({x}n + {y}n)"


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, look_up_cost: float = 0.1) -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links of similarity num / den or more)."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t"))
    keyed = docs.withColumn("tk", F.xxhash64("t"))
    freq = spark.sparkContext.broadcast(frequencies(docs, n))  # bounded: buckets, and n-grams in a share of all documents
    signs = [f"s{i}" for i in range(SIGNATURE)]
    sets = materialize(keyed.mapInArrow(_sets(freq, n, num, den), f"id {id_type}, tk bigint, `row` bigint, n bigint, k bigint, {', '.join(f'{s} bigint' for s in signs)}, prefix binary"), "jaccard-sets")
    some = sets.filter("n > 0 and id is not null")
    reps = some.join(some.groupBy("k").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")
    post = materialize(reps.select("k", "n", "prefix").mapInArrow(_postings(num, den), "token bigint, k bigint, n int, place int, level int, inner int"), "jaccard-postings")
    # posting lists of one document match nothing
    lists = post.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1").select("token")
    met = materialize(post.join(lists, "token"), "jaccard-met")
    discard(post)
    wanted = reps.join(met.select("k").distinct(), "k", "left_semi")
    texts = materialize(keyed.join(wanted.select("id", "tk", "k").hint("merge"), ["id", "tk"]).groupBy("id", "tk", "k").agg(F.first("t").alias("t")).select("k", "t"), "jaccard-texts")
    marks = materialize(wanted.select("k", *signs), "jaccard-signatures")

    links: list[DataFrame] = []
    group, labelled = None, met.withColumn("g", F.col("k"))
    for turn in range(ROUNDS):
        links.append(_verified(_stars(labelled, marks, turn, num, den), texts, n, num, den))
        if not links[-1].take(1):
            break
        old, group = group, components(_union(links), "jaccard-groups")
        discard(old)
        labelled = met.join(group.select(F.col("id").alias("k"), F.col("component").alias("g_")), "k", "left").select(*met.columns, F.coalesce("g_", "k").alias("g"))

    counts = [F.sum((F.col("inner") <= k).cast("bigint")).alias(f"c{k}") for k in range(1, LEVELS + 1)]
    across = labelled.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), *counts).filter("g1 <> g2").drop("g1", "g2")
    open_ = materialize(labelled.join(across, "token").join(marks, "k"), "jaccard-open")
    discard(met, group, marks)
    # looking up costs the lists' lengths; the candidates that share k tokens are about as many as the k-th longest list
    cost = []
    for k in range(1, LEVELS + 1):
        c = F.when(F.col("level") <= k, F.col(f"c{k}"))
        cost.append(look_up_cost * F.coalesce(F.sum(c), F.lit(0)) + F.coalesce(F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(k - 1)), F.lit(0)))
    # the least cost wins, among levels that the set's overlap allows
    choice = open_.groupBy("k").agg(F.first("n").alias("n_"), *(c.alias(f"x{k}") for k, c in enumerate(cost, 1)))
    best = F.array_min(F.array(*(F.when(F.ceil(F.col("n_") * num / den) >= k, F.struct(F.col(f"x{k}").alias("x"), F.lit(k).alias("l"))) for k in range(1, LEVELS + 1))))
    choice = choice.select("k", best["l"].alias("l"))
    probe = open_.join(choice, "k").filter("level <= l").select("token", F.col("k").alias("a"), F.col("n").alias("an"), F.col("g").alias("ga"), F.col("place").alias("pa"), "l", *(F.col(s).alias("a" + s) for s in signs))
    index = open_.select("token", F.col("k").alias("b"), F.col("n").alias("bn"), F.col("g").alias("gb"), F.col("place").alias("pb"), "inner", *(F.col(s).alias("b" + s) for s in signs))
    # the overlap that this pair needs makes both prefixes shorter still
    need = f"ceil({num} * (an + bn) / {num + den})"
    near = probe.join(index, "token").filter("ga <> gb and inner <= l and (an > bn or (an = bn and a > b))").filter(f"{den} * bn >= {num} * an and pa < an - {need} + l and pb < bn - {need} + l").filter(_allowed(num, den, "a", "b"))
    pairs = near.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("l").alias("l")).filter("shared >= l").select("a", "b")
    links.append(_verified(pairs, texts, n, num, den))
    discard(open_, texts)
    # rows of one id tie what they hold
    member = some.select("id", "k").distinct()
    ties = member.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("z")).filter("a <> z").drop("z")
    links.append(materialize(member.join(ties, "id").filter("a <> k").select("a", F.col("k").alias("b")), "jaccard-ties"))
    found = components(_union(links), "jaccard-components")
    discard(*links)
    named = sets.select("id", "n", "k").join(found.select(F.col("id").alias("k"), F.col("component").alias("c_")), "k", "left")
    named = named.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.coalesce("c_", "k")).alias("c"))
    least = named.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    return named.join(least, "c", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _stars(labelled: DataFrame, marks: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs of a document and a list's pivot of another group that share so many tokens that a link is likely.

    At first the pivot is the document that has the token earliest, hence the fewest rare tokens of its own; then another
    one each time."""
    order = F.struct("place", "n", "k", "g") if not turn else F.struct(F.xxhash64("k", F.lit(turn)).alias("place"), "n", "k", "g")
    pivots = labelled.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.min(order).alias("p")).filter("g1 <> g2").select("token", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("p.g").alias("pg"))
    share = F.greatest(F.lit(2.0), 0.3 * (F.col("n") - F.ceil(F.col("n") * num / den) + LEVELS))
    near = labelled.join(pivots, "token").filter("g <> pg").filter(f"{den} * least(n, pn) >= {num} * greatest(n, pn)")
    stars = near.groupBy("k", "pk").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("pn").alias("pn")).filter(F.col("shared") >= share)
    mine, other = marks, marks.select(F.col("k").alias("pk"), *(F.col(f"s{i}").alias(f"ps{i}") for i in range(SIGNATURE)))
    return stars.join(mine, "k").join(other, "pk").filter(_allowed(num, den)).select(F.col("k").alias("a"), F.col("pk").alias("b"))
