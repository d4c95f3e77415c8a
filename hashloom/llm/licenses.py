"""Licence scan by a trained paragraph classifier.

A paragraph (what stands between blank lines) is described by the distinct words and pairs of
adjacent words of its windows of WIDTH words, which overlap by half.  Multinomial logistic regression over those gives
licence families and an unknown class; its weights are sparse (small ones shrink to 0).  On
held-out passages and on licences of no family, of which no weight has seen any, a temperature and an
offset of the unknown class calibrate the probabilities.  A prediction counts once the
window also holds enough of one of the family's templates.

Only windows whose positive weights together could beat the unknown class are
scored in full; that bound is computed for every window and loses none.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sample_texts, tokens
from .license_texts import HELD_OUT, LOOKALIKES, OTHER, TEMPLATES

SCHEMA = "doc_id bigint, paragraph bigint, family string, probability double, similarity double, confirmed boolean"
UNKNOWN = "unknown"
#: Words of a window.
WIDTH = 128
FAMILIES = (UNKNOWN, *TEMPLATES)
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")


def plain_words(text: str) -> list[str]:
    return tokens([text])[0].to_pylist()


def paragraphs_of(text: str) -> list[str]:
    return _BLANK_LINE.split(text)


def _triples(words: list[str]) -> set[tuple]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


_TEMPLATE_TRIPLES = {f: [_triples(plain_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
_TRIGGERS = frozenset(w for ts in TEMPLATES.values() for t in ts for w in plain_words(t) if len(w) > 4)


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template of the family that the words hold (in
    runs of three words)."""
    own = _triples(words)
    return max(len(t & own) / len(t) for t in _TEMPLATE_TRIPLES[family])


@dataclass(frozen=True)
class LicenseModel:
    words: tuple[str, ...]
    #: features: single words by number, then pairs as left * len(words) + right
    pair_keys: tuple[int, ...]
    #: (len(words) + len(pair_keys)) x families, then the intercepts; calibrated
    weights: np.ndarray
    min_similarity: float

    def __hash__(self):
        return hash(self.words)


def _varied(template: list[str], filler: list[str], rng: random.Random) -> list[str]:
    """The template, or a long stretch of it, with words lost and put in, among other words."""
    if len(template) > 12 and rng.random() < 0.3:
        n = rng.randint(len(template) * 2 // 3, len(template))
        at = rng.randrange(len(template) - n + 1)
        template = template[at : at + n]
    words = [w for w in template if rng.random() > 0.05] or template
    if rng.random() < 0.3:
        words = [*words, rng.choice(filler)]
        words[rng.randrange(len(words))], words[-1] = words[-1], words[rng.randrange(len(words))]
    around = lambda: [rng.choice(filler) for _ in range(rng.choice([0, 0, 2, 8, 30, 60]))]
    return [*around(), *words, *around()][:WIDTH]


def _training_lines(background: list[str], rng: random.Random) -> tuple[list, list]:
    """(words, class) to fit on, and to calibrate on: every family with three templates or more lends
    one to the second, and so do licences of no family."""
    filler = [w for line in background for w in plain_words(line)] or ["the", "of", "and", "work"]
    fit, held = [], []
    for n, family in enumerate(TEMPLATES, 1):
        for k, template in enumerate(TEMPLATES[family]):
            words = plain_words(template)
            fit += [(_varied(words, filler, rng), n) for _ in range(16)]
            held += [(_varied(words, filler, rng), n) for _ in range(2)]
        for _ in range(6):  # several passages of a text in one window
            both = [w for t in rng.sample(TEMPLATES[family], 2) for w in plain_words(t)]
            fit.append((_varied(both, filler, rng), n))
    for name, passages in OTHER.items():
        for t in passages:
            (held if name in HELD_OUT else fit).extend((_varied(plain_words(t), filler, rng), 0) for _ in range(8 if name in HELD_OUT else 16))
    lines = [plain_words(line)[:WIDTH] for line in background]
    fit += [(w, 0) for w in lines[::2]]
    held += [(w, 0) for w in lines[1::2][:600]]
    for text in LOOKALIKES:
        fit += [([w for w in plain_words(text) if rng.random() > 0.05], 0) for _ in range(16)]
    legal = [w for ts in (*TEMPLATES.values(), *OTHER.values()) for t in ts for w in plain_words(t)]
    for k in range(700):  # the same words, but scattered
        words = [rng.choice(legal) for _ in range(rng.randint(1, 12))] + [rng.choice(filler) for _ in range(rng.randint(3, 40))]
        rng.shuffle(words)
        (fit if k % 7 else held).append((words, 0))
    return [x for x in fit if x[0]], [x for x in held if x[0]]


class _Rows:
    """Sparse rows of 0 and 1, and the sums that a fit needs."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.feature = np.array([f for r in rows for f in r], np.int64)
        self.by_feature = np.argsort(self.feature, kind="stable")
        self.first = np.flatnonzero(np.diff(self.feature[self.by_feature], prepend=-1))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, w.shape[1]), w.dtype)
        starts = np.flatnonzero(np.diff(self.row, prepend=-1))
        out[self.row[starts]] = np.add.reduceat(w[self.feature], starts, axis=0)
        return out

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, g.shape[1]), g.dtype)
        at = self.feature[self.by_feature[self.first]]
        out[at] = np.add.reduceat(g[self.row[self.by_feature]], self.first, axis=0)
        return out


def fit_model(background: list[str], seed: int = 3, min_similarity: float = 0.6, steps: int = 150) -> LicenseModel:
    """A model from the templates, varied, and background lines that hold none of them."""
    clear = [b for b in background if not (set(plain_words(b)) & _TRIGGERS)]
    fit, held = _training_lines(clear, random.Random(seed))
    said = [plain_words(t) for ts in (LOOKALIKES, *TEMPLATES.values(), *OTHER.values()) for t in ts]
    vocabulary = sorted({w for t in said for w in t})
    number = {w: k for k, w in enumerate(vocabulary)}
    v = len(vocabulary)
    pairs = sorted({number[a] * v + number[b] for w in said for a, b in zip(w, w[1:])})
    place = {k: v + n for n, k in enumerate(pairs)}
    width = v + len(pairs) + 1

    def row(words: list[str]) -> list[int]:
        ids = [number.get(w, -1) for w in words]
        return sorted({i for i in ids if i >= 0} | {place[k] for a, b in zip(ids, ids[1:]) if a >= 0 <= b and (k := a * v + b) in place} | {width - 1})

    x, labels = _Rows([row(words) for words, _ in fit], width), np.array([y for _, y in fit])
    y = np.eye(len(FAMILIES), dtype=np.float32)[labels]
    w = np.zeros((width, len(FAMILIES)), np.float32)
    speed, square = np.zeros_like(w), np.zeros_like(w)
    for _ in range(steps):  # Adagrad, with soft thresholds for sparse weights
        z = x.times(w)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.transposed_times((p - y) / x.n)
        speed = 0.8 * speed + g
        square += g * g
        rate = 0.3 / (np.sqrt(square) + 1e-4)
        w = w - rate * speed
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 2e-6 * rate[:-1], 0)
    h, truth = _Rows([row(words) for words, _ in held], width), np.array([y for _, y in held])
    z = h.times(w.astype(np.float64))

    def loss(t: float, offset: float) -> float:
        s = z / t
        s[:, 0] += offset
        s -= s.max(axis=1, keepdims=True)
        each = np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]
        return float(each[truth == 0].mean() + each[truth > 0].mean())  # as often a licence as none

    t, offset = min(((t, o) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0) for o in np.arange(-2, 4.1, 0.5)), key=lambda c: loss(*c))
    calibrated = w.astype(np.float64) / t
    calibrated[-1, 0] += offset
    return LicenseModel(tuple(vocabulary), tuple(pairs), calibrated, min_similarity)


def train(docs: DataFrame, per_language: int = 60, seed: int = 3, max_languages: int = 50, background_lines: int = 4000) -> LicenseModel:
    """Background lines come from a bounded sample: `per_language` documents of each of the
    `max_languages` most frequent labels of docs.lang (of equal ones the first by name),
    and of their lines `background_lines`, those with the smallest seeded hash whatever their language.

    Null labels give no background, and where there is none (an empty table, or only nulls) a few
    plain words take its place; null and blank texts and null ids are not drawn; repeated rows count once."""
    counts = docs.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    texts = sample_texts(docs, docs, "lang", sorted(r.lang for r in counts.collect()), per_language, seed, max_bytes=1 << 20)
    lines = [line for c in sorted(texts) for _, t in texts[c] for line in t.split("\n")]
    lines.sort(key=lambda x: hashlib.blake2b(f"{seed}:{x}".encode("utf-8", "replace"), digest_size=8).digest())
    return fit_model(lines[:background_lines], seed)


class Scanner:
    def __init__(self, model: LicenseModel):
        self.model = model
        self.vocabulary = pa.array(model.words, pa.large_string())
        self.keys = np.array(model.pair_keys, np.int64)
        gain = (model.weights - model.weights[:, :1]).max(axis=1)
        self.gain, self.start = np.maximum(gain[:-1], 0), float(gain[-1])

    def judge(self, features: np.ndarray, words: list[str]) -> tuple[str, float, float, bool] | None:
        """The verdict on a window of these distinct features: None for unknown."""
        z = self.model.weights[features].sum(axis=0) + self.model.weights[-1]
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if best == 0:
            return None
        s = similarity(words, FAMILIES[best])
        return FAMILIES[best], float(p[best]), s, s >= self.model.min_similarity

    def scan(self, texts: list) -> list[tuple[int, int, tuple]]:
        """(row, paragraph, verdict) for each family that a window of the paragraph is given to: that of its best
        window (confirmed first, then by similarity and probability, then the first)."""
        parts = [paragraphs_of(t) if t else [] for t in texts]
        flat, offsets = tokens([p for ps in parts for p in ps])
        ids = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(ids):
            return []
        size = np.diff(offsets)
        windows = np.maximum(1, -(-(size - WIDTH) // (WIDTH // 2)) + 1)
        owner = np.repeat(np.arange(len(size)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        lo = offsets[owner] + nth * (WIDTH // 2)
        hi = np.minimum(lo + WIDTH, offsets[owner + 1])
        v, width = len(self.model.words), len(self.model.words) + len(self.keys)
        feature = np.full((2, len(ids)), -1, np.int64)  # of the word, and of the pair that begins there
        feature[0] = ids
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[both] * v + ids[both + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        feature[1, both] = np.where(self.keys[at] == key, v + at, -1)
        found = []
        for row, short in ((0, 0), (1, 1)):
            n = np.maximum(hi - lo - short, 0)
            window = np.repeat(np.arange(len(lo)), n)
            f = feature[row, np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append((window * width + f)[f >= 0])
        uniq = np.unique(np.concatenate(found))
        rows, feats = uniq // width, uniq % width
        most = np.bincount(rows, self.gain[feats], minlength=len(lo)) + self.start
        first = np.cumsum([0, *map(len, parts)])
        best: dict[tuple[int, str], tuple] = {}
        for n in np.flatnonzero(most > 0).tolist():
            a, b = np.searchsorted(rows, [n, n + 1])
            verdict = self.judge(feats[a:b], flat[int(lo[n]) : int(hi[n])].to_pylist())
            if verdict:
                known = best.get((int(owner[n]), verdict[0]))
                if known is None or (verdict[3], verdict[2], verdict[1]) > (known[3], known[2], known[1]):
                    best[int(owner[n]), verdict[0]] = verdict
        out = []
        for (p, _), verdict in best.items():
            r = int(np.searchsorted(first, p, side="right") - 1)
            out.append((r, p - int(first[r]), verdict))
        return out


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of each licence family
    that the classifier finds in a paragraph; confirmed is false where no template
    of that family is near enough.  paragraph counts the text's paragraphs, which blank lines divide, from 0.

    Null and empty texts have no such paragraph; texts and paragraphs of any length are read whole, in windows;
    a null doc_id is returned as null; repeated rows and paragraphs each report theirs; of equal probabilities the first
    family wins; other columns are not read; an empty table gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scanner = Scanner(spread.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[r], n, *verdict) for r, n, verdict in scanner.scan(b.column(1).to_pylist())]
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)
