"""Language ID of words by a linear-chain conditional random field.

Every word gets a score for each language from character n-grams (2 and 3 letters, word edges included), affixes (3 letters
at either edge) and a lexicon (words seen `LEXICON` times or more in the training sample); learned transitions tie
neighbouring words together. Forward-backward gives each word's label distribution, so runs of one language in
code-switched text are labelled apart; a document's language is the one with the most expected words, its score their share.

Training: labelled documents carry one language each, so sequences are made by joining passages of different documents,
which is what teaches the transitions to switch. Parameters are fitted by AdaGrad on the exact likelihood gradient.

Bounds: at most `MAX_DOCS` documents a language and `MAX_TOTAL` in all (one a language at least), the first by a hash of doc_id, are
learned from; they are read whole, and `SEQUENCES` sequences are drawn from all places of their texts. All documents are
labelled, whole. Feature tables have a fixed size (`BITS`) and the lexicon is bounded by the sample, so what is broadcast is too.

All feature and dynamic-programming steps are array operations over a batch of documents: n-grams over one code-point stream,
forward-backward time-major over documents by descending length. Documents are never split or cut. Words are runs of letters
of the lower-cased text; a dotted capital I is lower-cased to i, the only letter that lower() would make two characters of.

Edge cases: null texts and texts without a letter are `und` with score 0; without any labelled document all are `und`;
repeated rows each give a row and are learned from once; rows without doc_id are labelled but not learned from; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, received, shipped, table
from .toxicity import fold

BITS, LEXICON = 16, 5
MAX_DOCS, MAX_TOTAL = 800, 20_000
SEQUENCES, LENGTH, EPOCHS, BATCH, RATE = 6_000, 40, 4, 200, 0.3
CHARS, WORDS = 1 << 20, 1 << 21
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def lowered(text: str) -> str:
    return text.replace("İ", "i").lower()


def mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a stream: (table rows [chars, 4], first char of each word, hash of each word).

    Each word stands between edges (0); row i holds the features that begin at char i: the 2-gram, the 3-gram, the affix (an
    edge and 3 letters), or 0, the row that stays zero. Documents are told apart by the caller, by word counts.
    """
    cp = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[cp]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a word is its edge
    s = np.where(is_letter, cp, 0)[keep].astype(np.uint64)
    if not len(s):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.r_[np.uint64(0), s, np.zeros(4, np.uint64)]
    n = len(s) - 4
    a, b, c, d = s[:n], s[1 : n + 1], s[2 : n + 2], s[3 : n + 3]
    two = mix(a * np.uint64(0x1FFFFF) + b)
    three = mix(two + c * np.uint64(0x100000001B3))
    four = mix(three + d * np.uint64(0x5BD1E995))
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(64 - BITS)
    inside_b, inside_c = b != 0, c != 0
    rows = np.zeros((n, 3), np.int64)
    rows[:, 0] = ((two >> shift) & mask).astype(np.int64)
    rows[:, 1] = np.where(inside_b, ((three >> shift) & mask).astype(np.int64) + (1 << BITS), 0)
    affix = inside_b & inside_c & ((a == 0) | (d == 0))
    rows[:, 2] = np.where(affix, ((four >> shift) & mask).astype(np.int64) + (2 << BITS), 0)
    rows[rows == 0] = ZERO
    first = np.flatnonzero((a == 0) & inside_b)  # the edge before a word
    place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))[: n - first[0]] if first[0] == 0 else None
    word = np.add.reduceat(mix(b + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), first)
    return rows, first, word


ZERO = 3 << BITS  # the row that stays zero


class Field:
    """The parameters: feature table, lexicon, transitions, start."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        k = len(langs)
        self.langs = langs
        self.table = np.zeros((ZERO + 1, k), np.float32)
        self.lexicon = np.sort(lexicon)
        self.lexicon_table = np.zeros((len(lexicon) + 1, k), np.float32)
        self.transition = np.zeros((k, k))
        self.start = np.zeros(k)

    def lexicon_rows(self, words: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words, at + 1, 0)

    def emissions(self, rows: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        per_char = self.table[rows[:, 0]]
        per_char += self.table[rows[:, 1]]
        per_char += self.table[rows[:, 2]]
        return np.add.reduceat(per_char, first, axis=0) + self.lexicon_table[self.lexicon_rows(words)]


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents by descending length, active documents at each time, place of each word of the concatenated documents)."""
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    longest = int(sorted_lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(longest), "left")
    start = np.r_[0, np.cumsum(active)]
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    time = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    return order, active, start[time] + np.repeat(rank, lengths)


def forward_backward(e: np.ndarray, active: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time-major scores e -> (word marginals, scaled forward values, exp of scaled scores); docs by descending length."""
    x = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(transition).astype(np.float32)
    alpha = np.empty_like(x)
    at, before = 0, None
    for n in active.tolist():
        now = x[at : at + n] * (np.exp(start).astype(np.float32) if before is None else before[:n] @ a)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at : at + n] = now
        before, at = now, at + n
    gamma = np.empty_like(x)
    beta = np.ones((0, x.shape[1]), np.float32)
    after = None
    for n in reversed(active.tolist()):
        at -= n
        now = np.ones((n, x.shape[1]), np.float32)
        if after is not None:
            m = len(after)
            now[:m] = (x[at + n : at + n + m] * after) @ a.T
            now[:m] /= now[:m].sum(axis=1, keepdims=True)
        g = alpha[at : at + n] * now
        gamma[at : at + n] = g / g.sum(axis=1, keepdims=True)
        after = now
    del beta
    return gamma, alpha, x


def fit(rows: list[tuple[str, str]], seed: int = 11) -> Field | None:
    """rows (lang, text) of the training sample."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows})
    passages: dict[str, list[list[str]]] = {lang: [] for lang in langs}
    is_letter = letters()
    for lang, text in rows:
        words = "".join(c if is_letter[ord(c)] else " " for c in lowered(text)).split()
        if words:
            passages[lang].append(words)
    langs = [x for x in langs if passages[x]]
    if not langs:
        return None
    sequences, labels = [], []
    for _ in range(SEQUENCES if len(langs) > 1 else BATCH):
        words, own = [], []
        while len(words) < LENGTH:
            k = int(rng.integers(len(langs)))
            source = passages[langs[k]][int(rng.integers(len(passages[langs[k]])))]
            size = int(rng.integers(3, LENGTH + 1))
            at = int(rng.integers(0, max(1, len(source) - size + 1)))
            words += source[at : at + size]
            own += [k] * len(source[at : at + size])
        sequences.append(words[:LENGTH])
        labels.append(own[:LENGTH])
    counts = Counter(w for lang in langs for p in passages[lang] for w in p)
    known = [w for w, n in counts.items() if n >= LEXICON]
    field = Field(langs, features(" ".join(known))[2] if known else np.zeros(0, np.uint64))
    k = len(langs)
    if k == 1:
        return field
    grads = [np.full(p.shape, 1e-6) for p in (field.table, field.lexicon_table, field.transition, field.start)]
    data = []
    for b in range(0, len(sequences), BATCH):
        parts = sequences[b : b + BATCH]
        f = features("\n".join(" ".join(s) for s in parts))
        y = np.array(labels[b : b + BATCH])
        data.append((*f, field.lexicon_rows(f[2]), y))

    def update(which: int, parameter: np.ndarray, gradient: np.ndarray) -> None:
        grads[which] += gradient**2
        parameter += (RATE * gradient / np.sqrt(grads[which])).astype(parameter.dtype)

    for _ in range(EPOCHS):
        for rows_, first, words, lexicon_rows, y in data:
            n = len(y)
            e = field.emissions(rows_, first, words).reshape(n, LENGTH, k).transpose(1, 0, 2).reshape(-1, k)
            gamma, alpha, x = forward_backward(e, np.full(LENGTH, n), field.transition, field.start)
            truth = np.zeros_like(gamma)
            truth[np.arange(len(truth)), y.T.ravel()] = 1
            diff = truth - gamma
            # Expected transitions: alpha_t (A) (x_{t+1} beta_{t+1}); beta comes back from gamma / alpha.
            al, ga = alpha.reshape(LENGTH, n, k), gamma.reshape(LENGTH, n, k)
            right = ga[1:] / np.maximum(np.einsum("tni,ij->tnj", al[:-1], np.exp(field.transition)), 1e-12)
            expected = np.einsum("tni,tnj->ij", al[:-1], right) * np.exp(field.transition)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            per_word = diff.reshape(LENGTH, n, k).transpose(1, 0, 2).reshape(-1, k)
            per_char = np.repeat(per_word, np.diff(np.r_[first, len(rows_)]), axis=0)
            g = np.stack([np.bincount(rows_.ravel(), np.repeat(per_char[:, j], 3), ZERO + 1) for j in range(k)], axis=1) / n
            g[ZERO] = 0
            update(0, field.table, g)
            gl = np.stack([np.bincount(lexicon_rows, per_word[:, j], len(field.lexicon_table)) for j in range(k)], axis=1) / n
            gl[0] = 0
            update(1, field.lexicon_table, gl)
            update(2, field.transition, (seen - expected) / n)
            update(3, field.start, diff[:n].sum(axis=0) / n)
    return field


def word_counts(texts: list[str]) -> np.ndarray:
    """Words of each text, counted on the joined stream."""
    if not texts:
        return np.zeros(0, np.int64)
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[cp]
    starts = is_letter.copy()
    starts[1:] &= ~is_letter[:-1]
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]]
    total = np.r_[0, np.cumsum(starts)]
    return total[np.r_[begins[1:], len(cp)]] - total[np.minimum(begins, len(cp))]


def label(field: Field, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of consecutive texts: (expected words of each language [texts, k], word counts, most likely label of each word)."""
    k = len(field.langs)
    at = 0
    while at < len(texts):
        emissions, counts, words, end = [], [], 0, at
        while end < len(texts) and words < WORDS:
            size, stop = 0, end
            while stop < len(texts) and size < CHARS:
                size += len(texts[stop])
                stop += 1
            part = [lowered(t) for t in texts[end:stop]]
            counts.append(word_counts(part))
            rows, first, hashes = features("\n".join(part))
            if len(first):
                emissions.append(field.emissions(rows, first, hashes))
            words += len(first)
            end = stop
        lengths = np.concatenate(counts)
        out = np.zeros((len(lengths), k))
        best = np.zeros(0, np.int64)
        if words:
            some = np.flatnonzero(lengths)
            order, active, place = time_major(lengths[some])
            e = np.empty((words, k), np.float32)
            e[place] = np.concatenate(emissions)
            gamma, _, _ = forward_backward(e, active, field.transition, field.start)
            gamma = gamma[place]
            out[some] = np.add.reduceat(gamma, np.r_[0, np.cumsum(lengths[some])[:-1]], axis=0)
            best = gamma.argmax(axis=1)
        yield out, lengths, best
        at = end


def sample(docs: DataFrame, most: int = MAX_DOCS) -> list[tuple[str, str]]:
    """(lang, text) of at most `most` documents a language, of those that may be learned from."""
    learn = docs.select("doc_id", "text", "lang").where((fold(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_langs = learn.agg(F.count_distinct("lang")).first()[0]
    if not n_langs:
        return []
    most = min(most, max(1, MAX_TOTAL // n_langs))
    # Only ids are ranked, and each task keeps its own first ones before the shuffle.
    rank = F.rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = learn.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "lang").distinct()
    texts = learn.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in texts.select("lang", "text").collect())


def labelled(docs: DataFrame, field: Field | None, runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, n_words) of every row, and with runs the label runs [start, end) in words."""
    shared = shipped(docs.sparkSession, field)
    schema = "lang_pred string, score double, n_words long" + ", runs array<struct<start:int,end:int,lang:string>>" * runs

    def start():
        field = received(shared)

        def predict(texts: list[str | None]):
            texts = [t or "" for t in texts]
            if field is None:
                return None, [[UNKNOWN] * len(texts), [0.0] * len(texts), word_counts([lowered(t) for t in texts]), *[[[]] * len(texts)] * runs]
            sums, counts, found = [], [], []
            for s, n, best in label(field, texts):
                sums.append(s)
                counts.append(n)
                if runs:
                    ends = np.cumsum(n)
                    for a, b in zip(ends - n, ends, strict=True):
                        cut = np.r_[0, np.flatnonzero(np.diff(best[a:b])) + 1, b - a] if b > a else [0]
                        found.append([{"start": int(i), "end": int(j), "lang": field.langs[best[a + i]]} for i, j in zip(cut[:-1], cut[1:], strict=True)])
            total, n = (np.concatenate(sums), np.concatenate(counts)) if sums else (np.zeros((0, len(field.langs))), np.zeros(0, np.int64))
            best = total.argmax(axis=1) if len(total) else np.zeros(0, int)
            score = np.where(n > 0, total[np.arange(len(total)), best] / np.maximum(n, 1), 0.0)
            langs = np.where(n > 0, np.array(field.langs, object)[best], UNKNOWN).tolist()
            return None, [langs, np.clip(score, 0, 1), n, *[found] * runs]

        return predict

    return map_rows(docs, ["doc_id"], ["text"], schema, start)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = labelled(docs, fit(sample(docs)))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
