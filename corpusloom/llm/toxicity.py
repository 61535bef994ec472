"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries of one size are trained by zstandard, one on ordinary and one on toxic text. Both begin with the same base,
trained on ordinary text; then comes what the trainer takes from each class: ordinary text for the one, and for the other toxic
text without the strings that ordinary text has as well. (A string of `GRAM` bytes stays if its document frequency in toxic
text is `CONTRAST` times that in ordinary text or more. Toxic documents are ordinary prose for the most part, so a trainer that
reads them whole picks the same common words as the other, and windows then differ by chance.) Every text is cut at spaces into
windows of about `WINDOW` bytes; a window is compressed with either dictionary, and the bytes the toxic one saves are its
evidence. The size of the class parts is chosen by cross-validated log loss on the calibration documents. How many windows save 2, 3, ... bytes (the thresholds), and the largest savings, are calibrated by a logistic
regression fitted on labelled documents that no dictionary saw, weighted to the classes' shares among all labels.

Bounds: the dictionaries and the calibration learn from at most `MAX_TOXIC` and `MAX_ORDINARY` labelled documents, the
first by a hash of doc_id; they are read whole, as are all documents that are scored. Only label ids are sampled before the
texts are read; the sampled texts alone are sorted, and the model (tens of KB) is all that is sent to the workers.

Edge cases: null and empty texts score as a text without evidence; repeated doc_ids in labels count as toxic if any row is;
without labels of both classes every score is the share of toxic labels (0 if there are none); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, received, shipped, table

WINDOW, SLACK, LEVEL = 40, 40, 3
BASE_BYTES, CLASS_BYTES, SEGMENT = 65_536, (384, 512, 768, 1024), 32
GRAM, CONTRAST, SHARE, LEAST = 6, 5.0, 0.02, 5
MAX_TOXIC, MAX_ORDINARY = 3_000, 6_000
STEPS = (2, 3, 4, 5, 6, 8)
OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"  # the repeat offsets that end a trained dictionary's header


def fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo parts; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    data, out, i = text.lower().encode("utf-8", "replace"), [], 0
    while i < len(data):
        j = i + size
        if j < len(data):
            k = data.find(b" ", j, j + SLACK)
            j = k if k >= 0 else j + SLACK
        out.append(data[i:j])
        i = j
    return out or [b""]


def trained(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """The content, of at most size bytes, of a dictionary that zstandard trains on the samples; where they are too few, their end."""
    try:
        most = max(1024, sum(map(len, samples)) // 10) if not segment else size + 512
        out = zstandard.train_dictionary(min(size + 512, most), samples, k=segment, d=GRAM if segment else 0).as_bytes()
        return out[out.index(OFFSETS) + len(OFFSETS) :][-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def gram_codes(data: bytes) -> np.ndarray:
    """The GRAM bytes from each place on as a number."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | x[i : i + n]
    return out


def telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Codes of the strings that set toxic texts apart, ascending."""
    codes, n = np.unique(np.concatenate([np.unique(gram_codes(t)) for t in toxic]), return_counts=True)
    often = n >= max(LEAST, SHARE * len(toxic))
    codes, n = codes[often], n[often]
    other = np.zeros(len(codes) + 1)
    for t in ordinary:
        own = np.unique(gram_codes(t))
        at = np.searchsorted(codes, own)
        at[at == len(codes)] = 0
        other[at[codes[at] == own] if len(codes) else at[:0]] += 1
    return codes[n / len(toxic) > CONTRAST * (other[:-1] + 0.5) / max(1, len(ordinary))]


def apart(text: bytes, codes: np.ndarray) -> list[bytes]:
    """The maximal runs of text that the strings with these codes cover."""
    own = gram_codes(text)
    if not len(own) or not len(codes):
        return []
    hit = np.flatnonzero(codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] == own)
    covered = np.zeros(len(text) + 2, np.int8)
    for i in range(GRAM):
        covered[hit + 1 + i] = 1
    edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
    return [text[a:b] for a, b in edges]


class Model:
    """Two dictionaries and the calibration."""

    def __init__(self, toxic: bytes, ordinary: bytes, prior: float):
        self.toxic, self.ordinary, self.prior = toxic, ordinary, prior
        self.mean = self.spread = self.weights = None

    def compressors(self):
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        return out

    @staticmethod
    def features(text: str, compressors) -> list[float]:
        plain, toxic = compressors
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)])
        counts = [int((saved >= k).sum()) for k in STEPS]
        top = np.sort(saved)[-3:]
        return [c / len(saved) for c in counts] + [float(np.log1p(c)) for c in counts] + [float(top.mean()), float(top[-1]), float(saved.mean()), float(np.log(len(saved)))]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        ridge = np.r_[np.full(len(w) - 1, 0.3), 1e-6]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * w)
            w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        self.weights = w

    def score(self, features: list[list[float]]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        return self.score_matrix(np.array(features).reshape(len(features), -1))

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str]], float]:
    """Labelled texts within the bounds, and the share of toxic ones among all labels that may be learned from."""
    learn = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.xxhash64("doc_id")
    ids = None
    for value, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        part = learn.where(F.col("toxic") == value).orderBy(key, "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # One text an id, so repeated rows do not pass the bounds.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = texts.orderBy(key, "doc_id").select("toxic", "text").toLocalIterator()
    return [(row["toxic"], row["text"]) for row in texts], counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))


def train(rows: list[tuple[int, str]], prior: float) -> Model:
    held = [zlib.crc32(t.encode("utf-8", "replace")) % 10 < 4 for _, t in rows]  # 4 in 10 calibrate; equal texts go together
    parts = {c: list(dict.fromkeys(t.lower().encode("utf-8", "replace") for (y, t), h in zip(rows, held, strict=True) if y == c and not h)) for c in (0, 1)}
    calibrate = [(y, t) for (y, t), h in zip(rows, held, strict=True) if h]
    y = np.array([c for c, _ in calibrate], float)
    if not parts[0] or not parts[1] or len(set(y.tolist())) < 2:
        return Model(b"", b"", prior)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    plain = [t[a : a + 128] for t in parts[0] for a in range(0, len(t), 128)]
    codes = telling(parts[1], parts[0])
    bad = [r for t in parts[1] for r in apart(t, codes)]
    base = trained(plain, BASE_BYTES)
    best, least = None, np.inf
    ordinary = trained(plain, max(CLASS_BYTES), SEGMENT)
    for size in CLASS_BYTES:
        toxic = trained(bad, size, SEGMENT)
        width = min(len(toxic), len(ordinary))
        model = Model(base + toxic[len(toxic) - width :], base + ordinary[len(ordinary) - width :], prior)
        tools = model.compressors()
        x = np.array([model.features(t, tools) for _, t in calibrate])
        loss = 0.0
        for fold_ in (0, 1):
            test = np.arange(len(y)) % 2 == fold_
            if len(set(y[~test].tolist())) < 2:
                continue
            model.fit(x[~test], y[~test], weight[~test])
            p = np.clip(model.score_matrix(x[test]), 1e-6, 1 - 1e-6)
            loss -= float((weight[test] * (y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))).sum())
        model.fit(x, y, weight)
        if loss < least:
            best, least = model, loss
    return best


def scored(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs, and the score under a name that is none of theirs."""
    shared = shipped(docs.sparkSession, model)

    def start():
        own = received(shared)
        tools = own.compressors()

        def score(texts: list[str | None]):
            return None, [own.score([own.features(t or "", tools) for t in texts]) if texts else []]

        return score

    return map_rows(docs, keep, ["text"], f"{name} double", start)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(*sample(docs, table(spark, sf_dir, "labels"))), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
