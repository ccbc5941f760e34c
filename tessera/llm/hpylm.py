"""Language model scoring by a hierarchical Pitman-Yor model (operator 4).

Every word is a customer in the restaurant of its context (the previous word, by its 64-bit hash); each table there
sends one customer to the restaurant that all contexts share, and each of its tables one to the uniform base.  Seating
is sampled by Gibbs in the table-indicator form: a customer is taken out, alone at its table with the chance
S(c-1, t-1) / S(c, t) of generalised Stirling numbers, and seated again by the Chinese-restaurant rule; a sweep moves as
many customers as there are.  The predictive probabilities of several samples are averaged and summed over a text as log10.

Documents are read in chunks; what is dealt are a chunk's distinct pairs, by word: a block holds all contexts of its
words, so the seating of a pair, the word's count and its place in the shared restaurant are local.  At the end a block
answers each chunk with the probabilities of the chunk's pairs, and the chunk sums them by document.  Contexts are dealt by hash to parts that add up what blocks tell of them:
after each sweep every block tells the tables of its contexts and is told those of all blocks.  Pairs met once have one
table, so only the contexts of other pairs take part; those get numbers within their part once.  Words that take more
than a share of all tokens in a sample of documents are dealt by word and context instead; the sample only steers the
dealing, and their seats in the shared restaurant come from the sums over all blocks.

Input rules: null text is the empty text, which has its end token alone; every row is scored and, unless held out,
counted, whether its id repeats or not; with no training token every probability is that of the base; other columns are
not read, whatever their names.  Documents are read three times and must be the same each time, else the job fails.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import crc_mod, discard, enter, materialize, partition_keys, release_memory, text_or_empty
from tessera.llm._words import word_hashes

STIRLING = 64
SEED = 5
END = b"\n"  # no word holds a line feed
END_HASH = np.uint64(0x5851F42D4C957F2D)
CHUNK = 2_500_000  # tokens
FINE = 1 << 16  # blocks answer with log10 probabilities in steps of 1 / FINE
BLOCK_BYTES = 24 << 20  # of text that a block stands for


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end behind each text's, and the number of tokens of each."""
    w, counts = word_hashes(texts, SEED)
    return np.insert(w, np.cumsum(counts), END_HASH), counts + 1


def lone_table(discount: float) -> np.ndarray:
    """[c, t]: the chance that a customer out of c at t tables sits alone, from generalised Stirling numbers (in logs)."""
    s = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, STIRLING + 1):
        for t in range(1, c + 1):
            stay = s[c - 1, t] + math.log(c - 1 - discount * t) if t < c and c - 1 - discount * t > 0 else -np.inf
            s[c, t] = np.logaddexp(s[c - 1, t - 1], stay)
    out = np.zeros((STIRLING + 1, STIRLING + 1))
    for c in range(1, STIRLING + 1):
        for t in range(1, c + 1):
            out[c, t] = math.exp(s[c - 1, t - 1] - s[c, t]) if np.isfinite(s[c - 1, t - 1]) else 0.0
    return out


def _lone_factors(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """log(c / t) and x / f(x) at the saddle point x of f(x) ** t for the power c, f(x) = (1 - (1 - x) ** discount) / discount."""
    y = np.concatenate([1 - np.geomspace(1e-6, 0.5, 2000), np.geomspace(0.5, 1e-120, 8000)[1:]])
    f = (1 - y**discount) / discount
    return np.log((1 - y) * y ** (discount - 1) / f), (1 - y) / f


def alone_at(c: np.ndarray, t: np.ndarray, discount: float, factors=None) -> np.ndarray:
    """The chance that a customer out of many sits alone, by the saddle point of the generating function of the Stirling numbers."""
    at, factor = factors or _lone_factors(discount)
    c1, t1 = np.maximum(c - 1.0, 1.0), np.maximum(t - 1.0, 0.0)
    return np.minimum(1.0, t1 / c1 * np.interp(np.log(c1 / np.maximum(t1, 1e-9)), at, factor))


def expected_tables(c: np.ndarray, discount: float, new_mass: np.ndarray) -> np.ndarray:
    """The number of tables at which as many are given up as are opened."""
    factors = _lone_factors(discount)
    low, high = np.ones(len(c)), c.astype(np.float64)
    for _ in range(40):
        t = (low + high) / 2
        more = new_mass / (np.maximum(c - 1 - discount * t, 1e-12) + new_mass) > alone_at(c, t, discount, factors)
        low, high = np.where(more, t, low), np.where(more, high, t)
    return np.clip(np.rint(low), 1, c).astype(np.int64)


def reseat(rng, c: np.ndarray, t: np.ndarray, lone: np.ndarray, discount: float, new_mass: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Gibbs moves in every restaurant-dish pair at once, `steps` in each or as many as it has customers: c customers at
    t tables, weight `new_mass` of opening one.

    Within the Stirling table customers move one by one; beyond it a sixteenth of them at a time, by binomial numbers of
    tables given up and opened."""
    moves = c if steps is None else np.full(len(c), steps)
    t = t.copy()
    few = np.flatnonzero(c <= STIRLING)
    few = few[np.argsort(-moves[few], kind="stable")]
    if len(few):
        ci, ti, mass, m = c[few], t[few], new_mass[few], -moves[few]
        for k in range(-int(m[0])):
            n = int(np.searchsorted(m, -k, "left"))
            a, b = ci[:n], ti[:n]
            left = b - ((rng.random(n) < lone[a, b]) & (b > 1))
            opened = rng.random(n) * (np.maximum(a - 1 - discount * left, 1e-12) + mass[:n]) < mass[:n]
            ti[:n] = np.minimum(left + opened, a)
        t[few] = ti
    many = np.flatnonzero(c > STIRLING)
    if len(many):
        factors = _lone_factors(discount)
        ci, ti, mass, rest = c[many], t[many], new_mass[many], moves[many].copy()
        while rest.any():
            n = np.minimum(rest, -(-ci // 16))
            alone = alone_at(ci, ti, discount, factors)
            left = np.maximum(ti - rng.binomial(n, alone), 1)
            ti = np.minimum(left + rng.binomial(n, mass / (np.maximum(ci - 1 - discount * (ti - alone), 1e-12) + mass)), ci)
            rest -= n
        t[many] = ti
    return t


class Setting:
    """Parameters that all tasks share."""

    def __init__(self, keys: list[int], hot: dict[int, float], discount: float, strength: float, samples: int, burn_in: int, seed: int):
        self.keys, self.blocks, self.discount, self.strength = np.array(keys, dtype=np.int64), len(keys), discount, strength
        self.samples, self.burn_in, self.seed = samples, burn_in, seed
        order = sorted(hot)
        self.hot = np.array(order, dtype=np.uint64)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(words), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)] == words

    def block_of(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        block = (words >> np.uint64(20)) % np.uint64(self.blocks)
        hot = self.is_hot(words)
        block[hot] = ((words[hot] + contexts[hot] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(self.blocks)
        return block.astype(np.int64)


DEALT = "kind int, block bigint, chunk bigint, blob binary, ids array<{0}>, held array<boolean>"


def _squeeze(head: list[int], *arrays: np.ndarray) -> bytes:
    """Some numbers and arrays, compressed; arrays lie byte plane by byte plane, as high bytes repeat."""
    planes = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, dtype=np.int64).tobytes() + b"".join(planes))


def _spread(blob: bytes, head: int):
    """The numbers at a blob's head and a function that takes one array after another from the rest."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 8 * head

    def take(kind, count):
        nonlocal at
        size, lo = np.dtype(kind).itemsize, at
        at += size * int(count)
        return np.frombuffer(raw, dtype=np.uint8, count=at - lo, offset=lo).reshape(size, int(count)).T.copy().view(kind).reshape(-1)

    return np.frombuffer(raw, dtype=np.int64, count=head), take


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes, which need fewer bytes; np.cumsum undoes it."""
    return np.diff(x, prepend=np.zeros(1, dtype=x.dtype))


def _width(n: int):
    return np.dtype(np.uint16 if n < 1 << 16 else np.uint32)


class Chunk:
    """The distinct pairs of a run of documents, ordered by block, word and context, and the pair of each token."""

    def __init__(self, setting: Setting, w: np.ndarray, lens: np.ndarray, held: np.ndarray):
        names, word = np.unique(w, return_inverse=True)
        context = np.empty(len(w), dtype=np.int64)
        context[1:] = word[:-1]
        context[np.cumsum(lens) - lens] = len(names)  # nothing stands before the first word
        names = np.append(names, np.uint64(0))
        pairs, token = np.unique(word * len(names) + context, return_inverse=True)
        pw, pc = pairs // len(names), pairs % len(names)
        block = setting.block_of(names[pw], names[pc])
        order = np.argsort(block, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.token, self.names, self.word, self.context, self.block = place[token], names, pw[order], pc[order], block[order]
        self.count = np.bincount(self.token, weights=np.repeat(~held, lens), minlength=len(order)).astype(np.int64)
        new = np.ones(len(order), dtype=np.bool_)
        new[1:] = (self.word[1:] != self.word[:-1]) | (self.block[1:] != self.block[:-1])
        self.firsts = np.flatnonzero(new)  # where a word's pairs of a block begin
        self.cuts = np.append(np.flatnonzero(np.diff(self.block, prepend=-1)), len(order))

    def blobs(self):
        """Block and blob of each run of pairs of one block: words, pairs of each, contexts, context of each pair, counts."""
        for lo, hi in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            firsts = self.firsts[np.searchsorted(self.firsts, lo) : np.searchsorted(self.firsts, hi)]
            known, of = np.unique(self.context[lo:hi], return_inverse=True)
            each, counts, wide = np.diff(np.append(firsts, hi)).astype(np.uint32), _small(self.count[lo:hi]), _width(len(known))
            head = [len(firsts), len(known), hi - lo, counts.itemsize]
            yield int(self.block[lo]), _squeeze(head, _gaps(self.names[self.word[firsts]]), each, _gaps(self.names[known]), of.astype(wide), counts)

    def tokens(self, lens: np.ndarray) -> bytes:
        """Lengths of the documents, pair of each token, and the number of pairs of each word of a block."""
        each = np.diff(np.append(self.firsts, len(self.word))).astype(np.uint32)
        return _squeeze([len(lens), len(self.token), len(each), len(self.word)], lens.astype(np.int64), self.token.astype(np.uint32), each)


def _deal(setting: Setting, modulus: int, held_out: int, blobs: bool):
    """Chunks of documents: with `blobs` kind 0, what each block is told of their pairs; else kind 1, the ids, whether
    each is held out, and their tokens.

    A chunk is named by its place and content, so that rows of two readings that differ never meet."""

    def run(batches):
        enter("hpylm")
        part, number = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        ws, lens, ids, held = [], [], [], []

        def flush(id_type):
            nonlocal number
            number += 1
            w, n, out = np.concatenate(ws), np.concatenate(lens), np.array(held, dtype=np.bool_)
            name = xxhash.xxh3_64_intdigest(w.tobytes() + n.tobytes() + out.tobytes() + repr((part, number, ids)).encode()) >> 1
            chunk = Chunk(setting, w, n, out)
            if blobs:
                keys, data = zip(*chunk.blobs())
                rows = len(data)
                cols = ([0] * rows, [int(setting.keys[k]) for k in keys], [name] * rows, data, [None] * rows, [None] * rows)
            else:
                cols = ([1], [0], [name], [chunk.tokens(n)], [list(ids)], [out.tolist()])
            for x in (ws, lens, ids, held):
                x.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(id_type), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "block", "chunk", "blob", "ids", "held"])

        size = 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                w, n = token_hashes(some.column("t"))
                names = some.column("id").to_pylist()
                ws.append(w), lens.append(n), ids.extend(names)
                held.extend(i is None or crc_mod(i, modulus) == held_out for i in names)
                size += len(w)
                if size > CHUNK:
                    yield flush(b.column("id").type)
                    size = 0
            id_type = b.column("id").type
        if ids:
            yield flush(id_type)

    return run


class Block:
    """All pairs of one block's words and the sampled seating of its training pairs."""

    def __init__(self, rows: list[tuple], setting: Setting, number: int):
        """`rows`: chunks and their blobs."""
        names, known, each, ofs, counts = [], [], [], [], []
        self.chunks = []
        for chunk, blob in rows:
            (k, x, n, size), take = _spread(blob, 4)
            names.append(np.cumsum(take(np.uint64, k), dtype=np.uint64))
            each.append(take(np.uint32, k))
            known.append(np.cumsum(take(np.uint64, x), dtype=np.uint64))
            ofs.append(take(_width(x), n))
            counts.append(take(np.dtype(f"u{size}"), n))
            self.chunks.append((chunk, int(k), int(n)))
        self.words, self.contexts = np.unique(np.concatenate(names)), np.unique(np.concatenate(known))
        width = len(self.contexts)
        self.word = np.concatenate([np.searchsorted(self.words, a).astype(np.int32) for a in names])  # of the words of all chunks
        key = np.repeat(self.word, np.concatenate(each)).astype(np.int64) * width
        key += np.concatenate([np.searchsorted(self.contexts, a)[i] for a, i in zip(known, ofs)])
        del names, known, each, ofs
        pairs, at = np.unique(key, return_inverse=True)  # of all rows, held out or not
        del key
        self.at = at.astype(np.int32)  # of the pairs of all chunks
        self.c = np.bincount(self.at, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        self.pw, self.pc = (pairs // width).astype(np.int32), (pairs % width).astype(np.int32)
        self.hot = setting.is_hot(self.words)
        self.count = np.bincount(self.pw, weights=self.c, minlength=len(self.words)).astype(np.int64)
        self.part = ((self.contexts >> np.uint64(20)) % np.uint64(setting.blocks)).astype(np.int64)
        self.order = np.lexsort((self.contexts, self.part))  # contexts by part, then hash: as parts are asked and answer
        self.setting, self.number = setting, number


def _blocks(batches, setting: Setting, told: bool = False):
    """The blocks of a partition that is sorted by block, `told` with their states by sweep and the parts' answers.  The
    consumer lets one go before it asks for the next."""
    held: list[tuple] = []
    states: dict[int, dict] = {}
    answers: dict[int, tuple] = {}
    number = None
    enter("hpylm")
    release_memory()

    def out():
        block = Block(held, setting, number)
        held.clear()
        return (block, dict(states), dict(answers)) if told else block

    for b in batches:
        for k, kind, chunk, blob, part, sample in zip(*(b.column(c) for c in ("block", "kind", "chunk", "blob", "part", "sample"))):
            if number is not None and k.as_py() != number:
                yield out()
                states.clear(), answers.clear()
            number = k.as_py()
            if kind.as_py() == 0:
                states[sample.as_py()] = {x: v for x, v in _undo(blob.as_py()).items() if x in ("t", "root")}
            elif kind.as_py() == 3:
                answers[part.as_py()] = _undo(blob.as_py())
            else:
                held.append((chunk.as_py(), blob.as_py()))
    if held:
        yield out()


# ---- sweeps ---------------------------------------------------------------------------------------------------------
# Rows between tasks.  kind 0: a block's state; 1: what a block tells a part of its contexts; 2: key and value of a sum
# over all blocks; 3: a part's answer.  `sample` tells the sweeps apart where several are read together.

ROWS = "kind int, block bigint, part bigint, sample int, blob binary, key bigint, value bigint"
TOKENS, WORDS, SENT, TABLES, HOT, HOT_COUNT = 0, 1, 2, 3, 1 << 20, 1 << 21


def _press(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _undo(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["kind", "block", "part", "sample", "blob", "key", "value"])


def _sums(values: dict[int, int]) -> list[tuple]:
    return [(2, None, None, 0, None, k, int(v)) for k, v in values.items()]


def _pieces(part: np.ndarray):
    """Part and range of each run of a sorted array."""
    cut = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[lo]), lo, hi) for lo, hi in zip([0, *cut], [*cut, len(part)])] if len(part) else []


def _open(setting: Setting):
    """A block's state at one table a pair, and what it tells of all its contexts: hash, customers, pairs met once, others."""

    def run(batches):
        for block in _blocks(batches, setting):
            n, width, cold = len(block.words), len(block.contexts), ~block.hot
            once, many = block.c == 1, np.flatnonzero(block.c > 1)
            c, t1, others = (np.bincount(block.pc, weights=x, minlength=width).astype(np.int64)[block.order] for x in (block.c, once, block.c > 1))
            met, part = block.contexts[block.order], block.part[block.order]
            place = np.cumsum(others > 0) - 1
            back = np.empty(width, dtype=np.int64)
            back[block.order] = place
            sent1 = np.bincount(block.pw, weights=once, minlength=n).astype(np.int64)
            sent = sent1 + np.bincount(block.pw[many], minlength=n)
            hot = np.flatnonzero(block.hot)
            root = np.where(cold, np.minimum(sent, 1), 0)
            at = np.searchsorted(setting.hot, block.words[hot])
            state = {"w": block.pw[many], "x": _small(back[block.pc[many]]), "c": _small(block.c[many]), "t": np.ones(len(many), dtype=np.uint8), "sent1": _small(sent1), "root": _small(root), "hot": hot, "hot_at": at, "part": part[others > 0]}
            rows = [(0, block.number, None, 0, _press(state), None, None)]
            rows += [(1, block.number, int(setting.keys[p]), -1, _press((met[lo:hi], _small(c[lo:hi]), _small(t1[lo:hi]), _small(others[lo:hi]))), None, None) for p, lo, hi in _pieces(part)]
            rows += _sums({TOKENS: block.count.sum(), WORDS: (block.count[cold] > 0).sum(), SENT: sent[cold].sum(), TABLES: root.sum()} | {HOT + int(a): sent[h] for a, h in zip(at, hot)} | {HOT_COUNT + int(a): block.count[h] for a, h in zip(at, hot)})
            yield _batch(rows)
            del block

    return run


def _groups(batches, by: str):
    """(key, its rows) of a partition that is sorted by `by`."""
    now, rows = None, []
    for b in batches:
        for x in zip(*(b.column(c).to_pylist() for c in (by, "kind", "block", "part", "sample", "blob"))):
            if rows and x[0] != now:
                yield now, rows
                rows = []
            now = x[0]
            rows.append(x[1:])
    if rows:
        yield now, rows


def _first_answers(batches):
    """Numbers of a part's contexts that have pairs met more than once; to each block: number, pairs met once, others."""
    enter("hpylm")
    for part, rows in _groups(batches, "part"):
        told = [(block, *_undo(blob)) for _, block, _, _, blob in rows]
        busy = np.unique(np.concatenate([h[o > 0] for _, h, _, _, o in told]))
        t1, others = np.zeros(len(busy), dtype=np.int64), np.zeros(len(busy), dtype=np.int64)
        if len(busy):
            for _, h, _, t, o in told:
                at = np.minimum(np.searchsorted(busy, h), len(busy) - 1)
                hit = busy[at] == h
                t1[at[hit]] += t[hit]
                others[at[hit]] += o[hit]
        out = [(3, block, part, 0, _press((at := np.searchsorted(busy, h[o > 0]), _small(t1[at]), _small(others[at]))), None, None) for block, h, _, _, o in told if (o > 0).any()]
        if out:
            yield _batch(out)


def _answers(batches):
    """The tables of a part's contexts over all blocks, to each block those it has told of."""
    enter("hpylm")
    for part, rows in _groups(batches, "part"):
        told = [(block, np.cumsum(d, dtype=np.int64), t) for _, block, _, _, blob in rows for d, t in [_undo(blob)]]
        total = np.zeros(max(int(i[-1]) for _, i, _ in told) + 1, dtype=np.int64)
        for _, i, t in told:
            total[i] += t
        yield _batch([(3, block, part, 0, _press(_small(total[i])), None, None) for block, i, _ in told])


class Shared:
    """Sums over all blocks and the seats of the hot words after a sweep; its size is that of the number of hot words."""

    def __init__(self, sums: dict[int, int], setting: Setting, before: Shared | None = None):
        n, d, theta = len(setting.hot), setting.discount, setting.strength
        self.tokens = before.tokens if before else sums.get(TOKENS, 0)
        self.hot_count = before.hot_count if before else np.array([sums.get(HOT_COUNT + k, 0) for k in range(n)], dtype=np.int64)
        self.words = before.words if before else sums.get(WORDS, 0) + int((self.hot_count > 0).sum())
        self.sweep = before.sweep + 1 if before else 0
        self.base = 1.0 / (self.words + 1)
        self.hot_sent = np.array([sums.get(HOT + k, 0) for k in range(n)], dtype=np.int64)
        cold = sums.get(TABLES, 0)
        root = np.minimum(np.maximum(before.hot_root, self.hot_sent > 0), self.hot_sent) if before else np.minimum(self.hot_sent, 1)
        busy = np.flatnonzero(self.hot_sent > 1)
        if len(busy):
            mass = np.full(len(busy), (theta + d * (cold + root.sum())) * self.base)
            c = self.hot_sent[busy]
            start = root[busy] if before else np.where(c > STIRLING, expected_tables(c, d, mass), 1)
            root[busy] = reseat(np.random.default_rng([setting.seed, 1, self.sweep]), c, start, lone_table(d), d, mass)
        self.hot_root, self.tables, self.sent = root, float(cold + root.sum()), float(sums.get(SENT, 0) + self.hot_sent.sum())
        self.hot_p = self.p(self.hot_sent, root, setting)

    def p(self, sent, root, setting: Setting):
        d, theta = setting.discount, setting.strength
        return (sent - d * root + (theta + d * self.tables) * self.base) / (theta + self.sent)


def _sweep(setting: Setting, g: Shared):
    """Moves all customers of a block's pairs and of its words' places in the shared restaurant once."""

    def run(batches):
        enter("hpylm")
        lone, d, theta = lone_table(setting.discount), setting.discount, setting.strength
        for number, rows in _groups(batches, "block"):
            st = _undo(next(x[4] for x in rows if x[0] == 0))
            answers = {x[2]: _undo(x[4]) for x in rows if x[0] == 3}
            told = [answers[int(setting.keys[p])] for p, _, _ in _pieces(st["part"])]
            if g.sweep == 0 and told:
                st["id"], st["t1"], tables = (np.concatenate([x[k] for x in told]).astype(np.int64) for k in range(3))
            elif told:
                tables = np.concatenate(told).astype(np.int64)
            w, x, c, t = (st[k].astype(np.int64) for k in "wxct")
            sent1, root, n = st["sent1"].astype(np.int64), st["root"].astype(np.int64), len(st["sent1"])
            rng = np.random.default_rng([setting.seed, 0, g.sweep, number & (1 << 63) - 1])
            cold = np.ones(n, dtype=bool)
            cold[st["hot"]] = False
            sent = sent1 + np.bincount(w, weights=t, minlength=n).astype(np.int64)
            busy = np.flatnonzero((sent > 1) & cold)
            mass = np.full(len(busy), (theta + d * g.tables) * g.base)
            if g.sweep == 0:
                root[busy] = np.where(sent[busy] > STIRLING, expected_tables(sent[busy], d, mass), root[busy])
            root[busy] = reseat(rng, sent[busy], root[busy], lone, d, mass)
            p = g.p(sent, root, setting)
            p[st["hot"]] = g.hot_p[st["hot_at"]]
            if len(w):
                mass = (theta + d * (st["t1"] + tables)[x]) * p[w]
                if g.sweep == 0:
                    t = np.where(c > STIRLING, expected_tables(c, d, mass), t)
                t = reseat(rng, c, t, lone, d, mass)
            sent = sent1 + np.bincount(w, weights=t, minlength=n).astype(np.int64)
            root = np.where(cold, np.minimum(np.maximum(root, sent > 0), sent), 0)
            own = np.bincount(x, weights=t, minlength=len(st["part"])).astype(np.int64)
            st["t"], st["root"] = _small(t), _small(root)
            out = [(0, number, None, g.sweep, _press(st), None, None)]
            out += [(1, number, int(setting.keys[p_]), g.sweep, _press((_small(np.diff(st["id"][lo:hi], prepend=0)), _small(own[lo:hi]))), None, None) for p_, lo, hi in _pieces(st["part"])]
            out += _sums({SENT: sent[cold].sum(), TABLES: root.sum()} | {HOT + int(a): sent[h] for a, h in zip(st["hot_at"], st["hot"])})
            yield _batch(out)

    return run


def _last_answers(sweeps: list[int]):
    """Customers and, by sample, tables over all blocks of every context that a block has."""

    def run(batches):
        enter("hpylm")
        for part, rows in _groups(batches, "part"):
            asked = [(block, *_undo(blob)) for _, block, _, sample, blob in rows if sample < 0]
            met = np.unique(np.concatenate([h for _, h, _, _, _ in asked]))
            c, t1, others = (np.zeros(len(met), dtype=np.int64) for _ in range(3))
            for _, h, x, y, z in asked:
                at = np.searchsorted(met, h)
                c[at] += x
                t1[at] += y
                others[at] += z
            tables, busy = np.tile(t1, (len(sweeps), 1)), np.flatnonzero(others)
            for _, _, _, sample, blob in rows:
                if sample >= 0:
                    d, t = _undo(blob)
                    tables[sweeps.index(sample), busy[np.cumsum(d, dtype=np.int64)]] += t
            for block, h, *_ in asked:
                at = np.searchsorted(met, h)
                yield _batch([(3, block, part, 0, _press((_small(c[at]), [_small(t[at]) for t in tables])), None, None)])

    return run


def _scores(setting: Setting, shared):
    """A row per block and chunk: places of the documents, their known tokens, sums of log10(c + 1) and of log10 p."""

    def run(batches):
        after: list[Shared] = shared.value
        g, d, theta = after[0], setting.discount, setting.strength
        press = zstandard.ZstdCompressor(level=1)
        for block, states, answers in _blocks(batches, setting, True):
            hot = np.flatnonzero(block.hot)
            count = block.count.astype(np.float64)
            hot_at = np.searchsorted(setting.hot, block.words[hot])
            count[hot] = g.hot_count[hot_at]
            told = [answers[int(setting.keys[p])] for p, _, _ in _pieces(block.part[block.order])]
            c = np.empty(len(block.contexts))
            c[block.order] = np.concatenate([x[0] for x in told])
            mean, many = np.zeros(len(block.pw)), block.c > 1
            for k, now in enumerate(after):
                state = states[now.sweep - 1]
                t = np.minimum(block.c, 1)
                t[many] = state["t"]
                tables = np.empty(len(block.contexts))
                tables[block.order] = np.concatenate([x[1][k] for x in told])
                p = now.p(np.bincount(block.pw, weights=t, minlength=len(block.words)), state["root"].astype(np.float64), setting)
                p[hot] = now.hot_p[hot_at]
                mean += (np.maximum(block.c - d * t, 0) + (theta + d * tables[block.pc]) * p[block.pw]) / (theta + c[block.pc])
            del states, answers, told
            logp, lo, at = np.rint(np.log10(mean / setting.samples) * -FINE).astype(np.uint32), 0, 0
            seen, out = _small(count.astype(np.int64)), []
            for chunk, k, n in block.chunks:
                own = seen[block.word[lo : lo + k]]
                out.append((chunk, block.number, _squeeze([k, n, own.itemsize], logp[block.at[at : at + n]], own)))
                lo, at = lo + k, at + n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "block", "blob"])
            del block, mean, logp, out

    return run


def _gather(setting: Setting):
    """Reads a chunk's tokens (kind 1 sorts first), then what every block answers; sums both by document."""
    rank = {int(k): i for i, k in enumerate(setting.keys)}

    def scores(ids, held, blob, answers):
        (docs, n, words, pairs), take = _spread(blob, 4)
        lens, token, each = take(np.int64, docs), take(np.uint32, n), take(np.uint32, words)
        logps, counts = [], []
        for _, x in sorted(answers, key=lambda x: rank[x[0]]):
            (k, m, size), part = _spread(x, 3)
            logps.append(part(np.uint32, m) / -FINE)
            counts.append(part(np.dtype(f"u{size}"), k).astype(np.int64))
        logp, count = np.concatenate(logps), np.concatenate(counts)
        if len(logp) != pairs or len(count) != words:
            raise ValueError("answers for other pairs than a chunk's: the documents differ between two readings")
        count = np.repeat(count, each)[token]
        starts = np.cumsum(lens) - lens
        known, base, own = (np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), np.log10(count + 1.0), logp[token]))
        return pa.RecordBatch.from_arrays([ids, held, pa.array(lens), pa.array(known), pa.array(base), pa.array(own)], names=["id", "held", "n", "known", "logc", "logp"])

    def run(batches):
        enter("hpylm")
        now, answers = None, []
        for b in batches:
            for kind, block, blob, ids, held in zip(*(b.column(c) for c in ("kind", "block", "blob", "ids", "held"))):
                if kind.as_py() == 1:
                    if now:
                        yield scores(*now, answers)
                    now, answers = (ids.values, held.values, blob.as_py()), []
                elif now is None:
                    raise ValueError("answers for an unknown chunk: the documents differ between two readings")
                else:
                    answers.append((block.as_py(), blob.as_py()))
        if now:
            yield scores(*now, answers)

    return run


def _sample_counts(most: int):
    def run(batches):
        held = [token_hashes(b.column("t"))[0] for b in batches]
        words, n = np.unique(np.concatenate(held) if held else np.empty(0, dtype=np.uint64), return_counts=True)
        top = np.argsort(-n, kind="stable")[:most]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words[top].view(np.int64), 0)), pa.array(np.append(n[top], n.sum())), pa.array([False] * len(top) + [True])], names=["h", "n", "all"])

    return run


def hot_words(docs: DataFrame, rows: int, share: float = 0.003, sample: int = 2000) -> dict[int, float]:
    """Hashes of the words that take more than `share` of the tokens in about `sample` of `rows` documents, and their shares.

    The sample only steers how work is dealt over blocks; no result follows from it but by the blocks' random numbers."""
    step = max(1, rows // sample)
    got = docs.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("t").mapInArrow(_sample_counts(max(2000, int(2 / share))), "h bigint, n bigint, all boolean").groupBy("h", "all").agg(F.sum("n").alias("n")).orderBy(F.desc("all"), F.desc("n")).limit(int(2 / share)).collect()
    total = sum(r.n for r in got if r["all"]) or 1
    return {r.h & (1 << 64) - 1: r.n / total for r in got if not r["all"] and r.n > share * total}


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2, discount: float = 0.8, strength: float = 1.0, samples: int = 3, burn_in: int = 5, seed: int = 1, least_blocks: int = 6) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `df`.

    Rows whose crc32(id as text) mod `modulus` is `held_out` (and null ids) teach nothing."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t"))
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes")).first()
    blocks = max(least_blocks, -(-(size.bytes or 0) // BLOCK_BYTES))
    setting = Setting(partition_keys(spark, blocks), hot_words(docs, size.rows, min(0.003, 0.5 / blocks)), discount, strength, samples, burn_in, seed)
    told_blocks, told_chunks = (docs.mapInArrow(_deal(setting, modulus, held_out, x), DEALT.format(id_type)) for x in (True, False))
    blobs = told_blocks.select(F.lit(4).alias("kind"), "block", "chunk", "blob", F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("int").alias("sample"))

    def dealt(rows, by):
        return rows.repartition(setting.blocks, by).sortWithinPartitions(by)

    def sums(rows):
        return {r.key: r.value for r in rows.filter("kind = 2").groupBy("key").agg(F.sum("value").alias("value")).collect()}

    first = now = materialize(dealt(blobs, "block").mapInArrow(_open(setting), ROWS), "hpylm-open")
    shared = Shared(sums(now), setting)
    after, tables = [], []
    for k in range(burn_in + samples):
        answers = dealt(now.filter("kind = 1"), "part").mapInArrow(_answers if k else _first_answers, ROWS)
        before, now = now, materialize(dealt(now.filter("kind = 0").unionByName(answers), "block").mapInArrow(_sweep(setting, shared), ROWS), "hpylm-sweep")
        if before is not first and before not in tables:
            discard(before)
        shared = Shared(sums(now), setting, shared)
        if k >= burn_in:
            after.append(shared)
            tables.append(now)
    asked, states = first.filter("kind = 1"), None
    for x in tables:
        asked = asked.unionByName(x.filter("kind = 1"))
        states = x.filter("kind = 0") if states is None else states.unionByName(x.filter("kind = 0"))
    answers = dealt(asked, "part").mapInArrow(_last_answers([x.sweep - 1 for x in after]), ROWS)
    told = states.unionByName(answers).select("kind", "block", F.lit(None).cast("bigint").alias("chunk"), "blob", "part", "sample")
    parts = dealt(blobs.unionByName(told), "block").mapInArrow(_scores(setting, spark.sparkContext.broadcast(after)), "chunk bigint, block bigint, blob binary").withColumn("kind", F.lit(0))
    both = told_chunks.unionByName(parts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"))
    each = materialize(both.select("kind", "block", "blob", "ids", "held").mapInArrow(_gather(setting), f"id {id_type}, held boolean, n bigint, known bigint, logc double, logp double"), "hpylm-scores")
    discard(first, *tables)
    floor = math.log10(shared.tokens + shared.words + 1)
    return each.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(shared.tokens).cast("bigint").alias("train_tokens"), (F.col("logc") - F.col("n") * F.lit(floor)).alias("base_score"), F.col("logp").alias("score"))


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, tokens, perplexity: 10 to the minus mean score per token."""
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
