"""Operator 5: toxicity by a subsequence string-kernel support vector machine
with Nystroem landmarks.

Kernel: two strings are alike by the subsequences of three letters they share,
each occurrence weighted by DECAY to the power of its span, so letters may be
skipped or put in between; spans are at most ``SPAN`` letters. A string is a
word between borders, its letters only; runs of single letters form one string.
What stands between two blanks with marks inside is one string as a whole and
one per part ("i-d.i0t" is "idit", "id" and "it"; "you/idiot" has "idiot"). A
string crosses a blank only as a run of single letters: "id iot" stays two.

Training: words of a bounded sample of labelled documents. Landmarks are
the strings most typical of toxic documents and as many common clean ones; the
Nystroem map K(x, L) K(L, L)^-1/2 makes the kernel machine a linear one, which
is fitted by Newton steps on the squared hinge loss. A document is a bag: the
string that scores highest in a toxic one is its witness, chosen anew in each
round (strings of a dozen toxic documents and hardly a clean one always are);
negatives are strings of clean documents, the highest of each added in
each round.

Scoring: since every kernel value is a dot product over subsequences, the
machine's sum over landmarks is one weight per subsequence; a document scores
its highest string, put through a logistic curve
fitted on the training documents. Whole texts are read; equal strings of a
block are scored once.

Edge cases: null text or text without a letter scores like a clean text (the
curve at the lowest string); with labels of one class only every score is 0;
repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 800               # labelled documents per class, about
LANDMARKS, SPAN, DECAY = 192, 7, 0.6
ROUNDS, NEGATIVES, PENALTY = 4, 8000, 0.05
BLOCK = 1 << 20
ALPHABET = 64
_STRING = re.compile(r"(?:\b[^\W\d_]\b[\W\d_]{0,2}){3,}|[^\W\d_](?:[^\s,;:.!?]*[^\W\d_])?")
_PUNCT = re.compile(r"[\W\d_]+")
_MARKS = re.compile(r"[\W_]+")


def strings_of(text: str) -> set[str]:
    """Distinct strings of a text, lower-cased letters only: its words, and what
    stands between two blanks as a whole and in the parts that marks cut it into."""
    low = text.lower()
    out = {_PUNCT.sub("", w) for w in set(_STRING.findall(low))}
    for t in set(low.split()):
        if not t.isalpha() and len(parts := [p for p in _MARKS.split(t) if p]) > 1:
            out.add(_PUNCT.sub("", t))
            out.update(_PUNCT.sub("", p) for p in parts)
    return out - {""}


_CODE = np.zeros(0x110000, np.uint8)
_CODE[:] = 28 + np.arange(0x110000) % 36
_CODE[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CODE[ord("^")] = 27
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]


def features(strings: list[str]):
    """Sparse feature map, normalised: (row, subsequence, weight), by rows."""
    marked = [f"^{s}^" for s in strings]
    size = np.array([len(s) for s in marked], np.int64)
    flat = _CODE[np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)].astype(np.int64)
    row = np.repeat(np.arange(len(marked)), size)
    rows, keys, weights = [], [], []
    n = len(flat)
    for a, b in _STEPS:
        if n > b:
            ok = np.flatnonzero(row[:n - b] == row[b:])
            rows.append(row[ok])
            keys.append((flat[ok] * ALPHABET + flat[ok + a]) * ALPHABET + flat[ok + b])
            weights.append(np.full(len(ok), DECAY ** (b + 1), np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    rows, keys, weights = np.concatenate(rows), np.concatenate(keys), np.concatenate(weights)
    # The norm of a string of that length whose subsequences all differ.
    norm = np.sqrt(np.maximum(np.bincount(rows, weights ** 2, minlength=len(marked)), 1e-12))
    return rows, keys, (weights / norm[rows]).astype(np.float32)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel matrix, through the dense features of ``b`` (landmarks)."""
    rb, kb, wb = features(b)
    used, place = np.unique(kb, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(b)), np.float32)
    np.add.at(dense, (place, rb), wb)
    out = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, len(a), 4096):
        ra, ka, wa = features(a[i:i + 4096])
        at = np.searchsorted(used, ka)
        ok = (at < len(used)) & (used[np.minimum(at, len(used) - 1)] == ka)
        np.add.at(out, ra[ok] + i, dense[at[ok]] * wa[ok, None])
    return out


class Machine:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for i in range(0, len(strings), 8192):
            part = strings[i:i + 8192]
            r, k, w = features(part)
            out[i:i + len(part)] = np.bincount(r, self.weights[k] * w, minlength=len(part))
        return out + self.bias

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weighted squared-hinge support vector machine by Newton steps in the
    Nystroem space; the last column of x is 1."""
    w, inside = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(30):
        a = x[inside] * cost[inside, None]
        w = np.linalg.solve(x[inside].T @ a + PENALTY * np.eye(x.shape[1]), a.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def _shares(bags: list[set[str]]) -> list[float]:
    """1 / the number of documents like this one, so copies count as one: alike
    are those whose rarer strings have the same least checksum."""
    often = Counter(s for b in bags for s in b)
    least = [min((zlib.crc32(s.encode()) for s in b if often[s] <= 0.1 * len(bags) + 1), default=-1) for b in bags]
    many = Counter(least)
    return [1 / many[x] if x >= 0 else 1.0 for x in least]


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Machine | None:
    bags = [strings_of(t or "") for t in texts]
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    toxic, clean = Counter(), Counter()
    for b, k, share in zip(bags, y, _shares(bags)):
        (toxic if k else clean).update(dict.fromkeys(b, share))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    odds = {s: (np.log((c + 0.2) / (n1 + 1)) - np.log((clean[s] + 0.2) / (n0 + 1))) * min(1, c / 3) for s, c in toxic.items()}
    typical = sorted(odds, key=lambda s: (-(odds[s] * np.sqrt(toxic[s])), s))[:LANDMARKS // 2]
    common = [s for s, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if s not in set(typical)][:LANDMARKS // 4]
    rng = np.random.default_rng(seed)
    rest = sorted(set(clean) - set(common) - set(typical))
    rest = [rest[i] for i in rng.permutation(len(rest))]
    marks = typical + common + rest[:LANDMARKS // 4]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])                       # K(L, L)^-1/2, Nystroem
    r, k, v = features(marks)
    pool = sorted(set(toxic) | set(clean))
    index = {s: i for i, s in enumerate(pool)}
    at = [np.array(sorted(index[s] for s in b), np.int64) for b in bags]
    score = np.array([odds.get(s, -9.0) for s in pool])
    free = np.array([clean[s] for s in pool])
    here = np.array([toxic[s] for s in pool])
    sure = np.array([index[s] for s, c in sorted(toxic.items()) if c >= 12 and odds[s] > 4], np.int64)
    easy = np.array([index[s] for s in rest[:NEGATIVES]], np.int64)
    hard = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        witness = np.array([a[score[a].argmax()] for a, t in zip(at, y) if t and len(a)], np.int64)
        witness = np.unique(witness[(free[witness] * n1 <= 0.2 * here[witness] * n0) & (here[witness] > 2)])
        pos = np.union1d(witness, sure)
        worst = [a[score[a].argmax()] for a, t in zip(at, y) if not t and len(a)]
        hard = np.union1d(hard, np.array(worst, np.int64))
        neg = np.setdiff1d(np.union1d(easy, hard), pos)
        if not len(pos) or not len(neg):
            return None
        rows = np.concatenate([pos, neg])
        side = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        x = np.hstack([kernel([pool[i] for i in rows], marks) @ root, np.ones((len(rows), 1))])
        w = _svm(x, side, np.where(side > 0, 3.0, np.where(np.isin(rows, hard), 3.0, 0.3)))
        table = np.zeros(ALPHABET ** 3)
        np.add.at(table, k, v * (root @ w[:-1])[r])
        machine = Machine(table, float(w[-1]), 1.0, 0.0)
        score = machine.margins(pool)
    low = float(score.min())
    top = np.array([score[a].max() if len(a) else low for a in at])
    a, b = 1.0, 0.0                                                     # logistic curve, classes weighted alike
    cw = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    z = (top - top.mean()) / (top.std() + 1e-9)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a - 20 * (((p - y) * z * cw).sum() + 1e-3 * a), b - 20 * ((p - y) * cw).sum()
    machine.slope, machine.shift = a / (top.std() + 1e-9), b - a * top.mean() / (top.std() + 1e-9)
    machine.low = low
    return machine


def _scorer(machine: Machine | None):
    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            out, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= BLOCK):
                    size += len(texts[j] or "")
                    j += 1
                if machine is None:
                    out += [0.0] * (j - i)
                else:
                    bags = [strings_of(t) if t else set() for t in texts[i:j]]
                    pool = list(set().union(*bags))
                    margin = dict(zip(pool, machine.margins(pool).tolist()))
                    top = np.array([max(map(margin.__getitem__, s), default=machine.low) for s in bags])
                    out += machine.probability(top).tolist()
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of the rows that
    may be learned from. A hash of the id picks about ``sample`` labels per
    class, 4 * ``sample`` at most; only they are broadcast to the texts."""
    labels = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    count = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in count.items():
        share = F.when(F.col("toxic") == k, min(1.0, sample / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000))
    some = labels.filter(place < share * 1_000_000).orderBy(place / share, "doc_id", "toxic").limit(4 * sample)
    got = (docs.filter("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
               .orderBy("doc_id", "text").collect())
    return fit([r.text for r in got], [int(r.toxic) for r in got])


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``docs`` with ``score``."""
    docs = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(machine), schema + ", score double")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def op5_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    machine = train(docs.filter(~held_out()), labels.filter(~held_out()))
    out = score_toxicity(docs, machine)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
