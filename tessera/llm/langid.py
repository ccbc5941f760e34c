"""Language identification by a bidirectional gated recurrent network over bytes (operator 10).

The network reads a text byte by byte in both directions and labels every position; a document pools the probabilities
of its letter positions.  A text is read in windows of `CORE` positions, each with `MARGIN` bytes of its neighbours on
the side that a direction comes from, so states carry across words and long texts are many rows of one batch; before and
behind a text stand spaces.  The network is trained in numpy by backpropagation through time with Adam, on the driver, on a bounded sample.

Input rules: a text that is null or has no letter (Unicode category L) is `und` with score 0; null languages teach
nothing; with no training row every text is `und`; repeated rows teach and are labelled each on their own; languages
that tie go to the one that sorts first; only the columns named in the arguments are read, whatever else there is.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import enter, id_remainder, text_or_empty

UNKNOWN = "und"
CORE, MARGIN = 128, 16
SLICE = 1 << 18  # bytes that are labelled together
LETTER = regex.compile(r"\p{L}")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LETTER_BYTE = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def bytes_of(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased; line ends and tabs count as spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BLANK)


_BLANK = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


@dataclass
class ByteGRU:
    """Two gated recurrent layers over one-hot bytes, one in each direction, and a softmax at every position."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = 8, seed: int = 11) -> ByteGRU:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p["u" + d] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            p["c" + d] = np.zeros(3 * hidden, dtype=np.float32)
        p["o"] = r.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        p["q"] = np.zeros(len(langs), dtype=np.float32)
        return cls(langs, p)

    def _states(self, x: np.ndarray, d: str, order, keep: list | None = None) -> np.ndarray:
        """States (length, rows, hidden) after each of the byte rows of `x` (length, rows) named by `order`; `keep` gets
        what backpropagation needs."""
        w, u = self.p["x" + d] + self.p["c" + d], self.p["u" + d]
        k, rows = u.shape[0], x.shape[1]
        uz, um = np.ascontiguousarray(u[:, : 2 * k]), np.ascontiguousarray(u[:, 2 * k :])
        h = np.zeros((rows, k), dtype=w.dtype)
        states = np.empty((x.shape[0], rows, k), dtype=w.dtype)
        a, zr, rh, m = (np.empty((rows, n), dtype=w.dtype) for n in (3 * k, 2 * k, k, k))
        for t in order:
            if keep is not None:
                zr, rh, m = zr.copy(), rh.copy(), m.copy()
            np.take(w, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, uz, out=zr)
            zr += a[:, : 2 * k]
            zr *= 0.5  # the logistic function by tanh
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[:, k:], h, out=rh)
            np.matmul(rh, um, out=m)
            m += a[:, 2 * k :]
            np.tanh(m, out=m)
            if keep is not None:
                keep.append((t, h, zr[:, :k], zr[:, k:], rh, m))
            new = states[t]
            np.subtract(m, h, out=new)
            new *= zr[:, :k]
            new += h
            h = new
        return states

    def probs(self, x: np.ndarray, margin: int = 0) -> np.ndarray:
        """Probabilities (positions, rows, languages) of the byte rows of `x` without `margin` rows at either end."""
        n, x = len(x), x.astype(np.intp)
        hf = self._states(x, "f", range(n - margin))[margin : n - margin]
        hb = self._states(x, "b", range(n - 1, margin - 1, -1))[margin : n - margin]
        k = hf.shape[2]
        s = hf @ self.p["o"][:k] + hb @ self.p["o"][k:] + self.p["q"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        n, rows = x.shape
        x = x.astype(np.intp)
        nf: list = []
        nb: list = []
        hf, hb = self._states(x, "f", range(n), nf), self._states(x, "b", range(n - 1, -1, -1), nb)
        h = np.concatenate([hf, hb], axis=2)
        s = h @ self.p["o"] + self.p["q"]
        s -= s.max(axis=2, keepdims=True)
        e = np.exp(s)
        prob = e / e.sum(axis=2, keepdims=True)
        loss = float(-np.log(prob[:, np.arange(rows), y] + 1e-9).mean())
        prob[:, np.arange(rows), y] -= 1
        prob /= n * rows
        g = {"o": np.tensordot(h, prob, axes=([0, 1], [0, 1])), "q": prob.sum(axis=(0, 1))}
        dh = prob @ self.p["o"].T
        k = hf.shape[2]
        for d, notes, part in (("f", nf, dh[:, :, :k]), ("b", nb, dh[:, :, k:])):
            u = self.p["u" + d]
            gu, steps = np.zeros_like(u), np.empty((n, rows, 3 * k), dtype=u.dtype)
            back = np.zeros((rows, k), dtype=u.dtype)
            for t, prev, z, r, rh, m in reversed(notes):
                back = back + part[t]
                dm = back * z * (1 - m * m)
                dz = back * (m - prev) * z * (1 - z)
                drh = dm @ u[:, 2 * k :].T
                da = steps[t]
                da[:, :k], da[:, k : 2 * k], da[:, 2 * k :] = dz, drh * prev * r * (1 - r), dm
                gu[:, : 2 * k] += prev.T @ da[:, : 2 * k]
                gu[:, 2 * k :] += rh.T @ dm
                back = back * (1 - z) + drh * r + da[:, : 2 * k] @ u[:, : 2 * k].T
            flat, at = steps.reshape(-1, 3 * k), np.argsort(x.reshape(-1), kind="stable")
            met, first = np.unique(x.reshape(-1)[at], return_index=True)
            gx = np.zeros_like(self.p["x" + d])
            gx[met] = np.add.reduceat(flat[at], first)
            g |= {"x" + d: gx, "u" + d: gu, "c" + d: flat.sum(axis=0)}
        return loss, g


def columns_of(windows: list[bytes]) -> np.ndarray:
    """Byte rows (length, number) of windows of one length."""
    return np.ascontiguousarray(np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(len(windows), -1).T)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, epochs: int = 5, rows: int = 256, rate: float = 0.02, seed: int = 11, least_steps: int = 150) -> ByteGRU:
    """Adam over batches of windows, byte rows of `windows` (length, number), `least_steps` at least."""
    net, rng = ByteGRU.fresh(langs, hidden, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    each = -(-windows.shape[1] // rows)
    epochs = max(epochs, -(-least_steps // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(windows.shape[1])
        for lo in range(0, len(order), rows):
            b = order[lo : lo + rows]
            _, grad = net.gradients(windows[:, b], labels[b])
            step += 1
            pace = rate * (1 - step / (total + 1)) * min(1.0, len(b) / 64) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                net.p[name] = (net.p[name] - pace * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return net


def _sample_windows(per_doc: int, length: int):
    """At most `per_doc` windows of a document that hold a letter, drawn from its whole text between spaces."""

    def run(batches):
        for b in batches:
            langs, windows = [], []
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist()):
                raw = b" " * MARGIN + bytes_of(t) + b" " * MARGIN
                rng = np.random.default_rng(zlib.crc32(raw))
                picks = rng.integers(0, max(1, len(raw) - length + 1), min(per_doc, 1 + len(raw) // length)).tolist()
                for s in picks:
                    w = raw[s : s + length]
                    if LETTER.search(w.decode("utf-8", "ignore")):
                        windows.append(w.ljust(length))
                        langs.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(langs, pa.string())], names=["w", "y"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, docs_per_lang: int = 800, max_docs: int = 8_000, windows_per_doc: int = 4, length: int = 48) -> ByteGRU:
    """Train on at most `docs_per_lang` documents a language (those of the smallest id hashes), `max_docs` in all, and
    `windows_per_doc` windows of each.

    A threshold of the hash, from the counts of all rows, leaves little more than the sample before rows are ranked."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), docs[lang_col].alias("y")).filter("id is not null and t is not null and y is not null").filter(id_remainder("id", modulus) != held_out)
    counts = rows.groupBy("y").agg(F.count("*").alias("rows_")).orderBy(F.desc("rows_"), "y").limit(max_docs).collect()
    langs = sorted(r.y for r in counts)
    if not langs:
        return ByteGRU([], {})
    each = max(1, min(docs_per_lang, max_docs // len(langs)))
    limits = docs.sparkSession.createDataFrame([(r.y, min(1.0, (2.0 * each + 100) / r.rows_)) for r in counts], "y string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.join(F.broadcast(limits), "y").filter(draw < F.col("share")).select("id", "y", "t")  # bounded by max_docs
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", F.xxhash64("t")))
    chosen = some.withColumn("n", rank).filter(F.col("n") <= each).select("t", "y")
    got = chosen.mapInArrow(_sample_windows(windows_per_doc, length), "w binary, y string").toPandas().sort_values(["y", "w"], kind="stable")
    if not len(got):
        return ByteGRU([], {})
    langs = sorted(got["y"].unique())
    code = {y: i for i, y in enumerate(langs)}
    return train(columns_of([bytes(w) for w in got["w"]]), got["y"].map(code).to_numpy(), langs)


def position_probs(net: ByteGRU, raws: list[bytes]):
    """Probabilities of all positions, as (texts of the windows, valid positions, probabilities): window i holds up to
    CORE positions of a text, in order; arrays are (windows,), (CORE, windows) and (CORE, windows, languages)."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    per = -(-sizes // CORE)
    own = np.repeat(np.arange(len(raws)), per)
    number = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raws) + b" ", dtype=np.uint8)
    at = number * CORE + np.arange(-MARGIN, CORE + MARGIN)[:, None]
    inside = (at >= 0) & (at < sizes[own])
    x = data[np.where(inside, at + base[own], len(data) - 1)]
    core = slice(MARGIN, MARGIN + CORE)
    return own, inside[core], x[core], net.probs(x, MARGIN)


def _parts(net: ByteGRU, raw: bytes):
    """What `position_probs` returns of one text, some windows at a time, each part read with its neighbours."""
    step = max(1, SLICE // CORE) * CORE
    for lo in range(0, len(raw), step):
        _, inside, x, p = position_probs(net, [raw[max(0, lo - CORE) : lo + step + CORE]])
        own = slice(lo > 0, (lo > 0) + step // CORE)
        yield inside[:, own], x[:, own], p[:, own]


def _pooled(net: ByteGRU, raws: list[bytes]) -> np.ndarray:
    """Mean probabilities over the letter positions of each text."""

    def sums(inside, x, p):
        mask = (inside & _LETTER_BYTE[x]).astype(np.float32)
        return np.column_stack([np.einsum("tb,tbl->bl", mask, p), mask.sum(axis=0)])

    out = np.zeros((len(raws), len(net.langs) + 1))
    if len(raws) == 1:
        out[0] = sum((sums(*part).sum(axis=0, dtype=np.float64) for part in _parts(net, raws[0])), out[0])
    else:
        own, inside, x, p = position_probs(net, raws)
        np.add.at(out, own, sums(inside, x, p))
    return out[:, :-1] / np.maximum(out[:, -1:], 1)


def label_texts(net: ByteGRU, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, texts of about SLICE bytes at a time."""
    out: list[tuple[str, float]] = []
    held: list[bytes] = []

    def flush():
        for p in _pooled(net, held) if held else ():
            k = int(np.argmax(p))
            out.append((net.langs[k], float(min(1.0, p[k]))))
        held.clear()

    size = 0
    for t in texts:
        raw = bytes_of(t or "")
        if held and size + len(raw) > SLICE:
            flush()
            size = 0
        held.append(raw)
        size += len(raw)
    flush()
    return [x if t is not None and LETTER.search(t) else (UNKNOWN, 0.0) for t, x in zip(texts, out)]


def language_column(net: ByteGRU, text):
    """struct<lang_pred string, score double> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        enter("langid")
        values = texts.tolist()
        if not net.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(values), "score": [0.0] * len(values)})
        return pd.DataFrame(label_texts(net, values), columns=["lang_pred", "score"])

    return label.asNondeterministic()(text)


def label_documents(docs: DataFrame, net: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of every document."""
    rows = docs.select(docs[id_col], language_column(net, text_or_empty(text_col)).alias("x_"))
    return rows.select(id_col, "x_.lang_pred", "x_.score")


def label_spans(docs: DataFrame, net: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and `spans`, the label of every position: runs (start and length in bytes of UTF-8, language) that cover the text."""

    def spans(raw: bytes) -> list[dict]:
        found = [p.argmax(axis=2).T[inside.T] for inside, _, p in _parts(net, raw)]
        label = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        cut = np.flatnonzero(np.diff(label)) + 1
        starts = np.concatenate(([0], cut)) if len(label) else cut
        return [{"start": int(a), "length": int(b - a), "lang": net.langs[label[a]]} for a, b in zip(starts, np.append(starts[1:], len(label)))]

    @F.pandas_udf("array<struct<start: int, length: int, lang: string>>")
    def label(texts: pd.Series) -> pd.Series:
        enter("langid")
        return pd.Series([spans(bytes_of(t)) if net.langs else [] for t in texts])

    return docs.select(docs[id_col], label(text_or_empty(text_col)).alias("spans"))
