"""Chunks of a full-text index: some blocks in a row with the places of all their terms, as bytes.

A chunk numbers the tokens of its blocks: the fields of a block (id, breadcrumb, raw) follow one another, with a number that
no token has after each.  A term's places are those numbers, written as differences of one to five bytes.  Fields but the id
stand in the index twice (`text.mirrored`), the second time with Han characters apart; where there are none, only the first
copy is written.  Everything here is numpy."""

from __future__ import annotations

import ctypes
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions import text as X

#: Tokens of a chunk, about; a chunk ends after the slice of rows that reaches them.
TOKENS = 800_000
SLICE = 1_000
FOLD = str.maketrans(X.FOLD_FROM, X.FOLD_TO)
HAN = re.compile("[一-鿿]")
PIECE = re.compile("[一-鿿]|[^一-鿿]+")
#: The part of the rows that say which blocks a chunk has; terms have parts from 0 on.
REGISTER = -1
ROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("terms", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("n", pa.int64()), ("whole", pa.int64()), ("dl", pa.int64())])
SQL_ROW = "part int, chunk bigint, terms binary, ends binary, data binary, n bigint, whole bigint, dl bigint"


def _give_back() -> None:
    """Memory that a chunk took goes back to the system: a worker lives on with what it once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def part_of(term: bytes, parts: int) -> int:
    return zlib.crc32(term) % parts


def packed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, seven bits in each, and where each number ends."""
    v = v.astype(np.int64)
    size = np.ones(len(v), np.int64)
    long = np.flatnonzero(v >= 128)
    size[long] = 2 + sum((v[long] >= 1 << 7 * k).astype(np.int64) for k in range(2, 5))
    ends = np.cumsum(size)
    first = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[first] = v & 127
    for k in range(1, 5):
        long = long[size[long] > k]
        out[first[long] + k - 1] |= 128
        out[first[long] + k] = (v[long] >> 7 * k) & 127
    return out, ends


def unpacked(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    at = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * at, starts)


class Blocks:
    """The blocks of a chunk: ids (bytes), tokens written of each field, which fields stand twice."""

    def __init__(self, id_sizes: np.ndarray, id_bytes: bytes, lens: np.ndarray, twice: np.ndarray):
        self.id_sizes, self.id_bytes, self.lens, self.twice = id_sizes.astype(np.int32), id_bytes, lens.astype(np.int32).reshape(-1, 3), twice.astype(bool).reshape(-1, 3)
        self.n = len(self.id_sizes)
        full = self.lens.astype(np.int64) * (1 + self.twice)
        self.dl = full.sum(axis=1)
        ends = np.cumsum(full.ravel() + 1)
        self.starts = ends - full.ravel() - 1
        self.room = int(ends[-1]) if len(ends) else 0

    @classmethod
    def read(cls, blob: bytes) -> Blocks:
        raw = zlib.decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        return cls(np.frombuffer(raw, np.int32, n, 8), raw[8 + 19 * n :], np.frombuffer(raw, np.int32, 3 * n, 8 + 4 * n), np.frombuffer(raw, np.uint8, 3 * n, 8 + 16 * n))

    def blob(self) -> bytes:
        return zlib.compress(b"".join((self.n.to_bytes(8, "little"), self.id_sizes.tobytes(), self.lens.tobytes(), self.twice.astype(np.uint8).tobytes(), self.id_bytes)), 6)

    @cached_property
    def id_ends(self) -> np.ndarray:
        return np.cumsum(self.id_sizes, dtype=np.int64)

    def ids(self, which: Iterable[int]) -> list[bytes]:
        return [self.id_bytes[self.id_ends[i] - self.id_sizes[i] : self.id_ends[i]] for i in which]

    @cached_property
    def by_id(self) -> np.ndarray:
        """The place of each block in the order of ids."""
        every = self.ids(range(self.n))
        out = np.empty(self.n, np.int64)
        out[sorted(range(self.n), key=every.__getitem__)] = np.arange(self.n)
        return out

    @cached_property
    def field_at(self) -> np.ndarray:
        """The field (three to a block) of every number."""
        return np.repeat(np.arange(3 * self.n, dtype=np.int32), (self.lens * (1 + self.twice) + 1).ravel())

    def places(self, data: bytes) -> np.ndarray:
        """The numbers at which a term stands, both copies of a field that stands twice."""
        g = np.cumsum(unpacked(np.frombuffer(data, np.uint8)))
        if len(g):
            f = self.field_at[g]
            again = self.twice.ravel()[f]
            g = np.sort(np.concatenate((g, g[again] + self.lens.ravel()[f[again]])))
        return g

    def counts(self, at: dict[str, np.ndarray], phrase: tuple[str, ...], dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The blocks in which the tokens of a phrase follow one another, and how often in each."""
        none = np.empty(0, np.int64)
        x = at.get(phrase[0], none)
        for j, t in enumerate(phrase[1:], 1):
            x = x[np.isin(x + j, at.get(t, none), assume_unique=True)]
        each = self.field_at[x] // 3  # in order, as the places are
        new = np.flatnonzero(np.diff(each, prepend=-1))
        b, tf = each[new].astype(np.int64), np.diff(new, append=len(each))
        if dead is not None and len(b):
            live = ~dead[b]
            b, tf = b[live], tf[live]
        return b, tf


def rows_of(chunk: int, blocks: Blocks, uncounted: int, terms: list[bytes], codes: np.ndarray, g: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk: its register, and a row for each part in which it has terms.  `codes` and `g` are the term and
    the number of every token; `uncounted` blocks have no id or no text and are only counted."""
    n, dl = blocks.n + uncounted, int(blocks.dl.sum())

    def batch(part, *cells):
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, chunk, *cells, n, blocks.n, dl), ROW)], schema=ROW)

    yield batch(REGISTER, blocks.blob(), b"", b"")
    if not len(g):
        return
    part = np.fromiter((part_of(t, parts) for t in terms), np.int32, len(terms))
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    key = np.sort((rank[codes] << 32) | g)
    code, g = key >> 32, key & 0xFFFFFFFF
    new = np.concatenate(([True], code[1:] != code[:-1]))
    data, ends = packed(np.where(new, g, np.diff(g, prepend=0)))
    has = code[new]  # terms that stand somewhere, in order of parts
    upto = ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(g) - 1]))]
    at = np.searchsorted(part[order][has], np.arange(parts + 1))
    for p in np.unique(part[order][has]):
        a, b = at[p], at[p + 1]
        first = int(upto[a - 1]) if a else 0
        yield batch(int(p), zlib.compress(b"\0".join(terms[order[i]] for i in has[a:b]), 1), zlib.compress((upto[a:b] - first).astype(np.int32).tobytes(), 1), zlib.compress(data[first : int(upto[b - 1])].tobytes(), 1))


def terms_of(row: dict) -> tuple[list[bytes], np.ndarray, bytes]:
    """The terms of a row, where the bytes of each end, the bytes."""
    return zlib.decompress(row["terms"]).split(b"\0"), np.frombuffer(zlib.decompress(row["ends"]), np.int32), zlib.decompress(row["data"])


@lru_cache(100_000)
def _pieces(term: bytes) -> list[bytes]:
    """A term with its Han characters apart; empty where it holds none."""
    w = term.decode()
    return [x.encode() for x in PIECE.findall(w)] if HAN.search(w) else []


def _split_han(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The terms of words in lower case (their accents folded here, once for each word) and what they become where Han
    characters stand apart: the term of each word, which terms hold Han characters, how many pieces each makes, the pieces'
    numbers one after another, and all terms."""
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(w if w.isascii() else w.decode().translate(FOLD).encode(), len(number)) for w in words), np.int64, len(words))
    own = list(number)
    han, size, pieces = np.zeros(len(own), bool), np.ones(len(own), np.int64), []
    for i, t in enumerate(own):
        cut = None if t.isascii() else _pieces(t)
        if not cut:
            pieces.append(i)
            continue
        han[i], size[i] = True, len(cut)
        pieces += [number.setdefault(x, len(number)) for x in cut]
    return of, han, size, np.array(pieces, np.int64), list(number)


def _chunk(batches: list[pa.RecordBatch], chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    whole = pc.and_(pc.and_(pc.is_valid(t["id"]), pc.is_valid(t["ti"])), pc.and_(pc.is_valid(t["tb"]), pc.is_valid(t["tr"])))
    uncounted = t.num_rows
    t = t.filter(whole)
    uncounted -= t.num_rows
    one = lambda c: t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    ids = one("id").cast(pa.binary())
    fields = [one(c) for c in ("ti", "tb", "tr")]
    lens = np.stack([pc.list_value_length(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields], axis=1)
    d = pa.concat_arrays([f.flatten() for f in fields]).dictionary_encode()
    term, han, size, pieces, terms = _split_han(d.dictionary.cast(pa.binary()).to_pylist())
    codes = np.split(term[d.indices.to_numpy(zero_copy_only=False)], np.cumsum(lens.sum(axis=0))[:-1])
    twice = np.ones((t.num_rows, 3), bool)
    twice[:, 0] = False  # an id stands once, whatever it holds
    again: list = [None, None, None]  # second copies of the fields with Han characters: their tokens and the field of each
    if han.any():
        first = np.cumsum(size) - size
        for f in (1, 2):
            of = np.repeat(np.arange(t.num_rows), lens[:, f])
            twice[np.unique(of[han[codes[f]]]), f] = False
            m = ~twice[of, f]
            c = codes[f][m]
            n = size[c]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            again[f] = pieces[np.repeat(first[c], n) + at], np.repeat(of[m], n)
    written = lens.copy()
    for f in (1, 2):
        if again[f] is not None:
            written[:, f] += np.bincount(again[f][1], minlength=t.num_rows)
    blocks = Blocks(pc.binary_length(ids).to_numpy(zero_copy_only=False), b"".join(ids.to_pylist()), written, twice)
    every, g = [], []

    def place(code, n, start):
        every.append(code)
        g.append(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(code)))

    for f in range(3):
        place(codes[f], lens[:, f], blocks.starts[f::3])
        if again[f] is not None:
            place(again[f][0], written[:, f] - lens[:, f], blocks.starts[f::3] + lens[:, f])
    yield from rows_of(chunk, blocks, uncounted, terms, np.concatenate(every), np.concatenate(g), parts)


def encode(parts: int):
    """For mapInArrow: rows (id, ti, tb, tr: the words of the fields in lower case) to rows of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        tokens = 0
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            held.append(b)
            for c in ("ti", "tb", "tr"):
                flat = b.column(c).flatten()
                # a Han character of three bytes is a token of its own once more, and so may be what follows it
                tokens += len(flat) + int((pc.sum(pc.binary_length(flat)).as_py() or 0) - (pc.sum(pc.utf8_length(flat)).as_py() or 0))
            if tokens >= TOKENS:
                yield from _chunk(held, chunk, parts)
                held, tokens, chunk = [], 0, chunk + 1
                _give_back()
        if held:
            yield from _chunk(held, chunk, parts)
            held = []
        _give_back()

    return run


def pick(segment: int, terms: list[str] | None):
    """For mapInArrow: the rows of a table of postings to (segment, chunk, term, data) of some terms, or of all."""
    wanted = None if terms is None else [t.encode() for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, ends, data = terms_of(row)
                if wanted is None:
                    found = range(len(words))
                elif len(wanted) < 9:
                    found = [words.index(t) for t in wanted if t in words]
                else:
                    at = {w: i for i, w in enumerate(words)}
                    found = [at[t] for t in wanted if t in at]
                if len(found):
                    cut = [data[ends[i - 1] if i else 0 : ends[i]] for i in found]
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(cut), pa.int32()), pa.array([row["chunk"]] * len(cut), pa.int64()), pa.array([words[i].decode() for i in found], pa.string()), pa.array(cut, pa.binary())], names=["segment", "chunk", "term", "data"])

    return run


def numbered(segment: int):
    """For mapInArrow: registers to (segment, chunk, no, id) of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                blocks = Blocks.read(row["terms"])
                n = blocks.n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment, np.int32)), pa.array(np.full(n, row["chunk"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(blocks.ids(range(n)), pa.binary()).cast(pa.string())], names=["segment", "chunk", "no", "id"])

    return run


def opened(rows: pa.Table) -> tuple[Blocks | None, np.ndarray | None, dict[str, np.ndarray]]:
    """A chunk's blocks, which of them no longer count, and the places of its terms, of rows (term, data, dead): the register
    has neither a term nor dead blocks."""
    blocks, gone, data = None, [], {}
    for term, x, dead in zip(rows["term"].to_pylist(), rows["data"].to_pylist(), rows["dead"].to_pylist()):
        if term is not None:
            data[term] = x
        elif dead is not None:
            gone += dead
        else:
            blocks = Blocks.read(x)
    if blocks is None or not data:
        return None, None, {}
    dead = None
    if gone:
        dead = np.zeros(blocks.n, bool)
        dead[gone] = True
    return blocks, dead, {t: blocks.places(x) for t, x in data.items()}


def count(wanted: dict[str, tuple[str, ...]], schema: pa.Schema):
    """For applyInArrow over chunks: id, dl, and how often each phrase stands in a block, of blocks that hold one."""

    def run(rows: pa.Table) -> pa.Table:
        blocks, dead, at = opened(rows)
        if blocks is None:
            return schema.empty_table()
        tf = np.zeros((len(wanted), blocks.n), np.int64)
        for k, phrase in enumerate(wanted.values()):
            b, c = blocks.counts(at, phrase, dead)
            tf[k, b] = c
        some = np.flatnonzero(tf.any(axis=0))
        return pa.Table.from_arrays([pa.array(blocks.ids(some), pa.binary()).cast(pa.string()), pa.array(blocks.dl[some], pa.int64()), *(pa.array(x[some]) for x in tf)], schema=schema)

    return run


def recode(parts: int):
    """For applyInArrow over groups of chunks: one chunk of the blocks that still count, of rows (segment, chunk, kind, terms,
    ends, data, dead)."""

    def run(rows: pa.Table) -> pa.Table:
        held: dict[tuple[int, int], dict] = {}
        for row in rows.to_pylist():
            one = held.setdefault((row["segment"], row["chunk"]), {"terms": [], "dead": []})
            if row["dead"] is not None:
                one["dead"] += row["dead"]
            elif row["part"] == REGISTER:
                one["blocks"], one["uncounted"] = Blocks.read(row["terms"]), row["n"] - row["whole"]
            else:
                one["terms"].append(row)
        number: dict[bytes, int] = {}
        sizes, names, lens, twice, codes, places, base, uncounted = [], [], [], [], [], [], 0, 0
        for _, one in sorted(held.items(), key=lambda x: x[0]):
            b = one["blocks"]
            keep = np.ones(b.n, bool)
            keep[one["dead"]] = False
            live = np.flatnonzero(keep)
            now = Blocks(b.id_sizes[live], b"".join(b.ids(live)), b.lens[live], b.twice[live])
            at = np.zeros(3 * b.n, np.int64)
            at[np.repeat(keep, 3)] = now.starts
            for row in one["terms"]:
                words, ends, data = terms_of(row)
                data = np.frombuffer(data, np.uint8)
                raw = unpacked(data)
                stops = np.cumsum(data < 128)[ends - 1]  # numbers up to the end of each term
                counts = np.diff(stops, prepend=0)
                g = np.cumsum(raw)
                g -= np.repeat(np.where(stops > counts, g[stops - counts - 1], 0), counts)
                f = b.field_at[g]
                m = keep[f // 3]
                codes.append(np.repeat(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), counts)[m])
                places.append((g - b.starts[f] + at[f] + base)[m])
            sizes.append(now.id_sizes)
            names.append(now.id_bytes)
            lens.append(now.lens)
            twice.append(now.twice)
            base += now.room
            uncounted += one["uncounted"]
        whole = Blocks(np.concatenate(sizes), b"".join(names), np.concatenate(lens), np.concatenate(twice))
        none = np.empty(0, np.int64)
        chunk = int.from_bytes(hashlib.blake2b(repr(sorted(held)).encode(), digest_size=8).digest(), "little", signed=True)
        return pa.Table.from_batches(rows_of(chunk, whole, uncounted, list(number), np.concatenate([none, *codes]), np.concatenate([none, *places]), parts), schema=ROW)

    return run


# ---- many searches at once


class Asked:
    """Questions as numbers: the distinct phrases, and for each question those of its words and of its single terms (None
    where they are the same)."""

    def __init__(self, questions: list[tuple[list[list[str]], list[str]]]):
        number: dict[tuple[str, ...], int] = {}
        of = lambda ps: [number.setdefault(tuple(p), len(number)) for p in ps]
        self.questions = [(of(p), of([t] for t in s) if any(len(x) > 1 for x in p) else None) for p, s in questions]
        self.phrases = list(number)

    @property
    def terms(self) -> list[str]:
        return sorted({t for p in self.phrases for t in p})


class _Found:
    """What a chunk holds of the phrases asked for."""

    def __init__(self, rows: pa.Table, asked: Asked):
        self.blocks, dead, at = opened(rows)
        self.hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.blocks is None:
            return
        self.masks: dict[int, np.ndarray] = {}
        for k, p in enumerate(asked.phrases):
            if p[0] in at:
                b, tf = self.blocks.counts(at, p, dead)
                if len(b):
                    self.hits[k] = (b, tf)

    def all_of(self, ks: list[int]) -> np.ndarray:
        """The blocks that hold every one of the phrases."""
        none = np.empty(0, np.int64)
        if not ks or any(k not in self.hits for k in ks):
            return none
        first, *rest = sorted(set(ks), key=lambda k: len(self.hits[k][0]))
        out = self.hits[first][0]
        for k in rest:
            if not len(out):
                break
            b = self.hits[k][0]
            if len(b) * 16 > self.blocks.n:
                if k not in self.masks:
                    self.masks[k] = np.zeros(self.blocks.n, bool)
                    self.masks[k][b] = True
                out = out[self.masks[k][out]]
            else:
                out = out[np.isin(out, b, assume_unique=True)]
        return out


def tally(asked: Asked):
    """For applyInArrow over chunks: (k, n): in how many blocks phrase k stands; beyond the phrases, that some block holds all
    of a question's phrases."""
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        _give_back()  # of the chunk before
        found = _Found(rows, asked)
        if not found.hits:
            return schema.empty_table()
        out = [(k, len(b)) for k, (b, _) in found.hits.items()]
        out += [(len(asked.phrases) + i, 1) for i, (p, _) in enumerate(asked.questions) if len(found.all_of(p))]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


#: The best scores that this worker has met of each question of one search, and the chunks that they come from.
_MET: dict[str, tuple[np.ndarray, set]] = {}


def best(asked: Asked, plan: list[tuple[int, str]], idf: np.ndarray, avg: float, k1: float, b1: float, limit: int, search: str):
    """For applyInArrow over chunks: (q, id, score, rung) of the best `limit` blocks of each question, less those that can't be
    among them for the scores that the worker has met before.  `plan` has the rung of each question and its kind."""
    schema = pa.schema([("q", pa.int32()), ("id", pa.string()), ("score", pa.float64()), ("rung", pa.int32())])
    slack = 2e-6  # scores are compared before they are rounded

    def run(key, rows):
        _give_back()  # of the chunk before
        found = _Found(rows, asked)
        if not found.hits:
            return schema.empty_table()
        if search not in _MET:
            _MET.clear()
            _MET[search] = (np.full((len(asked.questions), limit), -1.0), set())
        met, seen = _MET[search]
        mark = tuple(x.as_py() for x in key)
        fresh = mark not in seen
        seen.add(mark)
        blocks = found.blocks
        norm = k1 * (1 - b1 + b1 * blocks.dl / avg)
        weight = {k: idf[k] * tf * (k1 + 1) / (tf + norm[b]) for k, (b, tf) in found.hits.items()}
        most = {k: float(w.max()) for k, w in weight.items()}
        dense: dict[int, np.ndarray] = {}

        def at(k: int, some: np.ndarray) -> np.ndarray:
            b, w = found.hits[k][0], weight[k]
            if len(b) * 8 > blocks.n:
                if k not in dense:
                    dense[k] = np.zeros(blocks.n)
                    dense[k][b] = w
                return dense[k][some]
            i = np.minimum(np.searchsorted(b, some), len(b) - 1)
            return np.where(b[i] == some, w[i], 0.0)

        q_, b_, s_, r_ = [], [], [], []
        for q, (rung, kind) in enumerate(plan):
            if not rung:
                continue
            p, s = asked.questions[q]
            ks = [k for k in (s if kind == "terms" and s is not None else p) if k in found.hits]
            floor = met[q, 0] - slack  # the worst of the best `limit` met so far
            if not ks or sum(most[k] for k in ks) < floor:
                continue
            if kind == "and":
                some = found.all_of(p)
            else:
                ranked = sorted(ks, key=most.__getitem__)
                left = 0.0
                while ranked and left + most[ranked[0]] < floor:  # blocks of these alone can't reach it
                    left += most[ranked.pop(0)]
                lists = [found.hits[k][0] for k in dict.fromkeys(ranked)]
                if len(lists) == 1:
                    some = lists[0]
                else:
                    mask = np.zeros(blocks.n, bool)
                    for x in lists:
                        mask[x] = True
                    some = np.flatnonzero(mask)
            if not len(some):
                continue
            score = at(ks[0], some)
            for k in ks[1:]:
                score = score + at(k, some)
            if len(some) > limit:
                floor = max(floor, float(np.partition(score, len(some) - limit)[len(some) - limit]) - slack)
            m = np.flatnonzero(score >= floor)
            if not len(m):
                continue
            some, score = some[m], np.floor(score[m] * 1e6 + 0.5) / 1e6
            if len(some) > limit:
                m = np.lexsort((blocks.by_id[some], -score))[:limit]
                some, score = some[m], score[m]
            if fresh:
                met[q] = np.sort(np.concatenate((met[q], score)))[-limit:]
            q_.append(np.full(len(some), q))
            b_.append(some)
            s_.append(score)
            r_.append(np.full(len(some), rung))
        if not q_:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(q_), pa.int32()), pa.array(blocks.ids(np.concatenate(b_)), pa.binary()).cast(pa.string()), pa.array(np.concatenate(s_)), pa.array(np.concatenate(r_), pa.int32())], schema=schema)

    return run


def among(hashes: np.ndarray):
    """For mapInArrow: rows (id, raw, h) whose h is among sorted `hashes`, as (id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            i = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            m = hashes[i] == h if len(hashes) else np.zeros(len(h), bool)
            if m.any():
                yield b.select(["id", "raw"]).filter(pa.array(m))

    return run


# ---- texts

TEXTS = "part int, size bigint, data binary"
#: Bytes of texts that are packed together.
TEXT_BYTES = 32_000_000


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows (part, id, raw) to rows of many texts of one part, as compressed bytes."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held).sort_by("part")
        part = t["part"].to_numpy()
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            rows = t.slice(a, b - a).select(["id", "raw"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            raw = sink.getvalue()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part[a]], pa.int32()), "size": pa.array([raw.size], pa.int64()), "data": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TEXT_BYTES:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def unpack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of `pack_texts` to (id, raw)."""
    for b in batches:
        for row in b.to_pylist():
            with pa.ipc.open_stream(pa.decompress(row["data"], row["size"], "zstd")) as r:
                yield from r
