"""Byte-pair encoding and decoding with a word-level vocabulary file (operator 9).

Every word holds a segment tree over the ranks of its adjacent symbol pairs.  The root is the leftmost pair of the
lowest rank; a merge rewrites three leaves (the merged pair, its left neighbour, the consumed pair) and the paths
above them, and the word is done when the root says that no pair can merge.  The trees of many words of like length
lie side by side in one array, so numpy takes one step for all of them at once.

Input rules: null text is the empty text, empty text has no tokens, equal rows give equal rows, any length is taken.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm._shared import enter, text_or_empty, worker_cache

# Fixed values of the vocabulary format: byte-to-character table, contractions, end-of-word mark.
END_OF_WORD = "</w>"
CONTRACTIONS = "s|t|re|ve|m|ll|d"
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

NONE = np.int64(1 << 60)
SPECIAL = "S:"
CONTROL = 0x10FF00  # where the separators 1C to 1F wait during splitting: private code points


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else 256, 257, ..."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _char_class(first: str) -> str:
    """A character class of all code points whose general category starts with `first`."""
    spans, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}" if c - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(spans)


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.size = size
        self.cells = 1 << 15  # symbols of a block of words: its arrays stay in the processor's cache
        chars = byte_characters()
        self.mid = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.end = np.array([vocab[c + END_OF_WORD] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.slot = np.zeros(size, dtype=np.int64)  # the symbols of single bytes, numbered 0 to 511
        singles = np.concatenate((self.mid, self.end))
        self.slot[singles] = np.arange(512)
        self.byte_ranks = self.rank(np.repeat(singles, 512), np.tile(singles, 512)).reshape(512, 512)
        letters, numbers = _char_class("L"), _char_class("N")
        self.pattern = re.compile(f"[{letters}]+|'(?:{CONTRACTIONS})|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")
        self.ascii_pattern = re.compile(f"[a-z]+|'(?:{CONTRACTIONS})|[0-9]|[^\\t-\\r a-z0-9]+")
        self.odd_space = re.compile("[\\x1c-\\x1f]")
        self.moved = re.compile(f"[{chr(CONTROL + 0x1C)}-{chr(CONTROL + 0x1F)}]")
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pack(self, token_id: int) -> bytes:
        return int(token_id).to_bytes(self.kind.itemsize, "little")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it can't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _encode_block(self, words: list[bytes]) -> list[bytes]:
        """Words of at least two bytes, of like length, encoded side by side."""
        rows, lens = len(words), np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        n = int(lens.max())
        width = 1 << max(1, (n - 1).bit_length())
        kind = np.int32 if (len(self.merged) + 1) * width < 1 << 31 else np.int64
        none = kind(len(self.merged) * width)
        raw = np.zeros((rows, n), dtype=np.uint8)
        mask = np.arange(n) < lens[:, None]
        raw[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.mid[raw]
        sym[np.arange(rows), lens - 1] = self.end[raw[np.arange(rows), lens - 1]]
        nxt = np.minimum(np.arange(1, n + 1, dtype=np.int32)[None, :], lens[:, None])  # lens: past the end
        prv = np.broadcast_to(np.arange(-1, n - 1, dtype=np.int32), (rows, n)).copy()
        alive = mask.copy()
        tree = np.full((rows, 2 * width), none, dtype=kind)
        r = self.byte_ranks[self.slot[sym[:, :-1]], self.slot[sym[:, 1:]]]
        ok = (r < NONE) & mask[:, 1:]
        tree[:, width : width + n - 1] = np.where(ok, r * width + np.arange(n - 1), none)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        row = np.flatnonzero(tree[:, 1] < none)
        while row.size:
            root = tree[row, 1]
            i = root % width
            j = nxt[row, i]
            k = nxt[row, j]
            p = prv[row, i]
            sym[row, i] = merged = self.merged[root // width]
            alive[row, j] = False
            nxt[row, i] = k
            more, before = k < lens[row], p >= 0
            prv[row[more], k[more]] = i[more]
            right = np.full(row.size, none)
            if more.any():
                q = self.rank(merged[more], sym[row[more], k[more]])
                right[more] = np.where(q < NONE, q * width + i[more], none)
            tree[row, width + i] = right
            tree[row, width + j] = none
            touched = [(row, i), (row, j)]
            if before.any():
                b, pb = row[before], p[before]
                q = self.rank(sym[b, pb], merged[before])
                tree[b, width + pb] = np.where(q < NONE, q * width + pb, none)
                touched.append((b, pb))
            for who, leaf in touched:
                node = (width + leaf) >> 1
                while node[0]:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
            row = row[tree[row, 1] < none]
        flat, ends = sym[alive].astype(self.kind).tobytes(), (np.cumsum(alive.sum(axis=1)) * self.kind.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian integers of `kind`."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [b""] * len(raw)
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(lens, kind="stable")
        sizes, order = lens[order], order.tolist()
        at = int(np.searchsorted(sizes, 2))
        for i in order[:at]:
            out[i] = b"".join([self.pack(self.end[b]) for b in raw[i]])
        while at < len(order):
            stop = min(int(np.searchsorted(sizes, 2 * sizes[at])), at + max(1, self.cells // int(sizes[at])))
            block = order[at:stop]
            for i, ids in zip(block, self._encode_block([raw[i] for i in block])):
                out[i] = ids
            at = stop
        return out

    def clean(self, text: str) -> str:
        """The normalised text; runs between white space are what the vocabulary's pattern works on.

        A special token is a run of its own, marked by a capital letter, which no other run can hold."""
        if "<|" in text and self.split_special:
            return " ".join([SPECIAL + part if part in self.special else self._clean(part) for part in self.split_special.split(text)]).strip()
        return self._clean(text).strip()

    def _clean(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if self.odd_space.search(text):  # control characters that splitting takes for white space and the pattern doesn't
            text = self.odd_space.sub(lambda m: chr(CONTROL + ord(m.group())), text)
        return text

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of one run without white space; none crosses white space."""
        if self.moved.search(piece):
            piece = self.moved.sub(lambda m: chr(ord(m.group()) - CONTROL), piece)
        return (self.ascii_pattern if piece.isascii() else self.pattern).findall(piece)

    def decode(self, ids) -> str:
        """The tokens of `ids` joined by one space, as a file without a decoder asks."""
        return " ".join([self.token[i] for i in ids])


class WordCache:
    """What is made of the ids of each distinct run between white space, kept between the batches and tasks of one
    Python worker.  Holds at most `limit` runs and starts anew beyond that, so memory doesn't grow with the input."""

    def __init__(self, bpe: WordBPE, make, limit: int = 800_000):
        self.bpe, self.make, self.limit, self.known = bpe, make, limit, {}

    def look_up(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """What was made of the distinct runs of the texts; the runs of all texts, as places in that list; where each
        text's runs begin, and the end."""
        if len(self.known) > self.limit:
            self.known.clear()
        lists = pc.utf8_split_whitespace(pa.array([self.bpe.clean(t) for t in texts], pa.string()))
        runs = lists.flatten().dictionary_encode()
        names = runs.dictionary.to_pylist()
        made = list(map(self.known.get, names))
        missing = [x for x, y in zip(names, made) if y is None]
        if missing:
            gc.disable()  # many small lists and no cycles: collecting would only walk them
            try:
                self._learn(missing)
            finally:
                gc.enable()
            made = [self.known[x] if y is None else y for x, y in zip(names, made)]
        offsets = lists.offsets.to_numpy()
        return made, runs.indices.to_numpy(), offsets - offsets[0]

    def _learn(self, missing: list[str]) -> None:
        bpe, make, known = self.bpe, self.make, self.known
        special = [x for x in missing if x.startswith(SPECIAL)]
        whole = [x for x in missing if x.isalpha()]  # one pre-token each: no need to ask the pattern
        mixed = [(x, bpe.words(x)) for x in missing if not x.isalpha() and not x.startswith(SPECIAL)]
        words = list({w for _, p in mixed for w in p}.union(whole))
        ids = dict(zip(words, bpe.encode_words(words), strict=True))
        for x in special:
            known[x] = make(bpe.pack(bpe.special[x[len(SPECIAL) :]]))
        for x in whole:
            known[x] = make(ids[x])
        for x, p in mixed:
            known[x] = make(b"".join([ids[w] for w in p]))


_LOADED: dict[tuple, object] = {}


def load(path: str) -> WordBPE:
    """The vocabulary of `path`, read once in each process."""
    if ("bpe", path) not in _LOADED:
        _LOADED["bpe", path] = WordBPE(path)
    return _LOADED["bpe", path]  # type: ignore[return-value]


def _clear() -> None:
    for c in _LOADED.values():
        if isinstance(c, WordCache):
            c.known = {}


worker_cache("bpe", _clear)


def cache_of(path: str, kind: str, make) -> WordCache:
    enter("bpe")
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = WordCache(load(path), make)
    return _LOADED[kind, path]  # type: ignore[return-value]


def chunks(texts: list[str], limit: int = 6 << 20):
    """Runs of texts of about `limit` characters together."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= limit):
            size += len(texts[stop]) + 1
            stop += 1
        yield at, stop
        at = stop


def encode_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text; returns the id, n_tokens, ids_sha256 and decoded_sha256.

    Narrow: one pass, no shuffle; a lost task is simply run again.  Null texts are empty and have no ids; very long ones
    are encoded whole; repeated rows have a row each.  Columns other than id and text are ignored, whatever their names."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(vocab_path)
        cache = cache_of(vocab_path, "digest", lambda raw: (" ".join(map(str, ids := np.frombuffer(raw, dtype=bpe.kind).tolist())), bpe.decode(ids), len(ids)))
        sha = hashlib.sha256
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in chunks(texts):
                made, at, offsets = cache.look_up(texts[lo:hi])
                total = np.concatenate(([0], np.cumsum(np.array([m[2] for m in made], dtype=np.int64)[at])))
                n = total[offsets[1:]] - total[offsets[:-1]]
                digests = []
                for k in (0, 1):  # of the ids, of the decoded text
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([m[k] for m in made], pa.string()).take(pa.array(at))), " ")
                    digests.append(pa.array([sha(x).hexdigest() for x in joined.cast(pa.binary()).to_pylist()], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()), *digests], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
