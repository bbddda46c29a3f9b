"""Operator 7: language identification by a bidirectional gated recurrent
network over bytes.

The network reads the UTF-8 bytes of a word (lower-cased letters between two
border bytes) forwards and backwards, both states giving a probability of each
language at every byte; a document's probabilities are the mean over all its
bytes. It starts afresh at each word, so equal words are run once per block
and counted as often as they occur; runs of letters longer than ``LONGEST``
bytes are cut there and read in pieces. It is trained in numpy by
backpropagation through time with Adam, on the driver, from the words of a
bounded sample: per language at most ``SAMPLE`` distinct documents, those of
least hash of id and text, of rows the fold rule allows.

Edge cases: null text or text without a letter is ``und`` with score 0;
rows without lang are not learned from; without any learned language
everything is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, WORDS = 300, 60_000     # documents per language, training words in all
LONGEST, UNITS, EMBED = 32, 12, 8
STEPS, BATCH, RATE = 350, 384, 0.012
BLOCK = 8 << 20        # characters whose equal words are run once
LETTERS = re.compile(r"[^\W\d_]+")
BORDER = 256


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a border on both sides, lengths, word of each row)."""
    rows, owner = [], []
    for k, w in enumerate(words):
        raw = w.encode("utf-8")
        for i in range(0, len(raw), LONGEST):
            rows.append(raw[i:i + LONGEST])
            owner.append(k)
    size = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(rows), int(size.max(initial=0)) + 2), BORDER, np.int16)
    body = np.arange(out.shape[1] - 2) < size[:, None]
    out[:, 1:-1][body] = np.frombuffer(b"".join(rows), np.uint8)
    return out, size + 2, np.array(owner, np.int64)


class ByteGru:
    """h' = h + z * (c - h), z and r from bytes and h, c from bytes and r * h."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.langs = langs
        self.p = {"emb": (0.3 * rng.normal(size=(257, EMBED))).astype(np.float32), "out": n(2 * UNITS, len(langs)),
                  "bias": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {"w" + d: n(EMBED, 3 * UNITS), "v" + d: np.zeros(3 * UNITS, np.float32),
                       "u" + d: n(UNITS, 2 * UNITS), "c" + d: n(UNITS, UNITS)}

    def _run(self, x, live, d, keep=None):
        """States (steps, rows, UNITS) of one direction; padding leaves a state as it is."""
        p, (n, steps) = self.p, x.shape
        table = p["emb"] @ p["w" + d] + p["v" + d]
        h, out = np.zeros((n, UNITS), np.float32), np.zeros((steps, n, UNITS), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            e = table[x[:, t]]
            g = h @ p["u" + d]
            g += e[:, :2 * UNITS]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:, :UNITS], g[:, UNITS:]
            c = (r * h) @ p["c" + d]
            c += e[:, 2 * UNITS:]
            np.tanh(c, out=c)
            new = h + z * (c - h) * live[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = out[t] = new
        return out

    def positions(self, x, size):
        """Probabilities (steps, rows, languages) and the live positions."""
        live = (np.arange(x.shape[1]) < size[:, None]).astype(np.float32)
        s = np.concatenate([self._run(x, live, "f"), self._run(x, live, "b")], axis=2)
        o = s @ self.p["out"] + self.p["bias"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        return o / o.sum(axis=2, keepdims=True), live

    def gradients(self, x, size, y):
        """Mean cross-entropy over all positions, and its gradients (backpropagation through time)."""
        p, live = self.p, (np.arange(x.shape[1]) < size[:, None]).astype(np.float32)
        kept = {"f": [], "b": []}
        s = np.concatenate([self._run(x, live, d, kept[d]) for d in "fb"], axis=2)
        o = s @ p["out"] + p["bias"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        o /= o.sum(axis=2, keepdims=True)
        weight = live.T / live.sum()
        loss = -float((np.log(o[:, np.arange(len(y)), y] + 1e-9) * weight).sum())
        o[:, np.arange(len(y)), y] -= 1
        o *= weight[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = np.tensordot(s, o, ([0, 1], [0, 1])), o.sum(axis=(0, 1))
        ds = o @ p["out"].T
        for d, part in (("f", slice(0, UNITS)), ("b", slice(UNITS, None))):
            dh, dtable = np.zeros((len(y), UNITS), np.float32), np.zeros((257, 3 * UNITS), np.float32)
            for t, h, z, r, c in reversed(kept[d]):
                dh = dh + ds[t, :, part]
                m = live[:, t, None]
                dz, dc = dh * (c - h) * m * z * (1 - z), dh * z * m * (1 - c * c)
                g["c" + d] += (r * h).T @ dc
                drh = dc @ p["c" + d].T
                dr = drh * h * r * (1 - r)
                both = np.concatenate([dz, dr], axis=1)
                g["u" + d] += h.T @ both
                np.add.at(dtable, x[:, t], np.concatenate([both, dc], axis=1))
                dh = dh * (1 - z * m) + drh * r + both @ p["u" + d].T
            g["w" + d], g["v" + d] = p["emb"].T @ dtable, dtable.sum(axis=0)
            g["emb"] += dtable @ p["w" + d].T
        return loss, g

    def fit(self, words: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 12):
        x, size, owner = matrix(words)
        y, rng = labels[owner], np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), BATCH)
            pick = pick[np.argsort(size[pick])]
            _, g = self.gradients(x[pick][:, :size[pick].max()], size[pick], y[pick])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Per word: language probabilities summed over its positions, then their number."""
        out = np.zeros((len(words), len(self.langs) + 1), np.float64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), 4096):
            part = order[i:i + 4096]
            x, size, owner = matrix([words[k] for k in part])
            prob, live = self.positions(x, size)
            at = np.array(part)[owner]
            np.add.at(out[:, :-1], at, np.einsum("tnl,nt->nl", prob, live))
            np.add.at(out[:, -1], at, live.sum(axis=1))
        return out


def _predictor(net: ByteGru | None):
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            langs, scores, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK):
                    size += len(texts[j] or "")
                    j += 1
                docs = [words_of(t) if t and net else [] for t in texts[i:j]]
                place: dict = {}
                at = [np.array([place.setdefault(w, len(place)) for w in d], np.int64) for d in docs]
                sums = net.word_sums(list(place)) if place else None
                for d in at:
                    if not len(d):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = sums[d].sum(axis=0)
                    p = total[:-1] / total[-1]
                    langs.append(net.langs[int(p.argmax())])
                    scores.append(float(p.max()))
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names, "lang_pred", "score"])
    return run


def train(labelled: DataFrame, sample: int = SAMPLE) -> ByteGru | None:
    """``labelled``: doc_id, text, lang of the rows that may be learned from."""
    rows = labelled.filter("lang is not null and text is not null")
    h = F.xxhash64(F.lit("langid"), "doc_id", "text")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return None
    # A hash of id and text picks about twice ``sample`` distinct rows per language
    # in one scan; the ``sample`` of least hash are kept of them.
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, min(1.0, 2 * sample / max(1, count[k]))).otherwise(share)
    some = rows.filter(F.pmod(h, F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "lang", "text", h.alias("h"))
    picked = some.select("lang", "h").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    keep = picked.withColumn("rn", first).filter(F.col("rn") <= sample).select(F.col("lang").alias("l"), F.col("h").alias("k"))
    docs = (some.join(F.broadcast(keep), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k")), "left_semi")
                .dropDuplicates(["lang", "h"]).select("doc_id", "lang", "text").orderBy("lang", "doc_id", "text").collect())
    by = {k: [] for k in langs}
    for r in docs:
        by[r.lang].append(words_of(r.text))
    rng, words, labels = np.random.default_rng(13), [], []
    for k, lang in enumerate(langs):
        own = [w for d in by[lang] for w in d]
        if own:
            take = rng.integers(0, len(own), max(1, WORDS // len(langs)))
            words += [own[i] for i in take]
            labels += [k] * len(take)
    return ByteGru(langs).fit(words, np.array(labels)) if words else None


def identify(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_predictor(net), schema + ", lang_pred string, score double")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op7_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
