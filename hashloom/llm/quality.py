"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A document's bytes are compressed with each; the difference of the two
sizes, normalised by their sum, tells which it resembles.  A logistic fit on held-out
labelled documents, weighted so that the classes stand as they do among all labels, turns it into a probability.
The fit also takes how far the text compresses at all: text that repeats itself is as small with either dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fit_logistic, held_out, map_arrow, sample_texts

BLOCK = 4096
LEVEL = 3
#: Bytes of no evidence that are added to every text, so that short ones aren't judged by a few.
PRIOR = 64
#: Documents that are less probably good go.  Where six in seven are good, these are the odds that 0.3 means in an even mix.
THRESHOLD = 0.72


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    good_trained: bool
    bad_trained: bool
    weights: tuple[float, ...]
    threshold: float


def _dictionary(texts: list[str], size: int) -> tuple[bytes, bool]:
    """A dictionary trained on the texts' blocks; their raw content, where there
    is too little of it to train on."""
    parts = [b for t in texts for b in blocks(t.encode(), 1024)]
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(parts)[-size:], False


def _compressor(data: bytes, trained: bool) -> zstandard.ZstdCompressor | None:
    if len(data) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(data, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


class Scorer:
    def __init__(self, model: QualityModel):
        self.model = model
        self.good = _compressor(model.good, model.good_trained)
        self.bad = _compressor(model.bad, model.bad_trained)

    def features(self, text: str) -> tuple[float, float]:
        """The normalised size difference (positive: nearer to good text), and how
        far the text compresses against the nearer dictionary."""
        data = text.encode("utf-8", "replace")
        parts = blocks(data, BLOCK)
        good = sum(len(self.good.compress(b)) for b in parts)
        bad = sum(len(self.bad.compress(b)) for b in parts)
        return (bad - good) / (bad + good + PRIOR), min(good, bad) / len(data)

    def probability(self, text: str) -> tuple[float, float]:
        diff, ratio = self.features(text)
        a, b, c = self.model.weights
        return diff, float(1 / (1 + np.exp(-np.clip(a * diff + b * np.log(ratio) + c, -30, 30))))


def fit_model(sample: dict, dict_bytes: int = 96 << 10, threshold: float = THRESHOLD, prior: float = 0.5) -> QualityModel:
    """A model from {1: [(doc_id, text)], 0: [...]}; seven in ten documents make
    the dictionaries, the others the calibration.  prior is the share of good documents."""
    train = {c: [t for i, t in sample[c] if not held_out(i)] for c in (0, 1)}
    held = [(t, c) for c in (0, 1) for i, t in sample[c] if held_out(i)]
    (good, gt), (bad, bt) = (_dictionary(train[c], dict_bytes) for c in (1, 0))
    draft = QualityModel(good, bad, gt, bt, (1.0, 0.0, 0.0), threshold)
    if len({c for _, c in held}) < 2:
        return QualityModel(good, bad, gt, bt, (20.0, 0.0, 0.0), threshold)
    s = Scorer(draft)
    x = np.array([s.features(t) for t, _ in held])
    x[:, 1] = np.log(x[:, 1])
    y = np.array([c for _, c in held], float)
    w = fit_logistic(x, y, weight=np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())), l2=1e-2)
    return QualityModel(good, bad, gt, bt, tuple(map(float, w)), threshold)


SCHEMA = "doc_id bigint, diff double, p_good double, keep boolean"
_scorers: dict[QualityModel, Scorer] = {}


def _scorer(model: QualityModel) -> Scorer:
    if model not in _scorers:
        _scorers.clear()
        _scorers[model] = Scorer(model)
    return _scorers[model]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 400, seed: int = 17, threshold: float = THRESHOLD) -> QualityModel:
    """A model from a bounded sample: `per_class` labelled documents of each class.

    The share of good ones is counted over all labels.  Null and contradicting labels, null ids and
    blank texts are left out; a label that stands there twice counts once in the sample; without labels, or with those of one class, a
    text's difference alone decides."""
    n = {r.quality: r["count"] for r in labels.filter("quality in (0, 1)").groupBy("quality").count().collect()}
    prior = n[1] / (n[0] + n[1]) if n.get(0) and n.get(1) else 0.5
    return fit_model(sample_texts(docs, labels, "quality", [0, 1], per_class, seed), threshold=threshold, prior=prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, diff, p_good, keep) of every row of docs.

    keep is p_good >= the model's threshold.  A null or blank text has nothing
    to compress: diff and p_good are null and it is rejected.  A null doc_id is
    returned as null, repeated rows each get their (equal) row, other columns of
    docs are not read.  An empty table gives no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        s = _scorer(spread.value)
        for b in batches:
            diff, p = [], []
            for t in b.column(1).to_pylist():
                d, q = s.probability(t) if t and t.strip() else (None, None)
                diff.append(d)
                p.append(q)
            keep = [q is not None and q >= s.model.threshold for q in p]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(diff, pa.float64()), pa.array(p, pa.float64()), pa.array(keep, pa.bool_())],
                names=["doc_id", "diff", "p_good", "keep"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs without the rows that `score` rejects, in one pass and with all columns."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        s = _scorer(spread.value)
        for b in batches:
            keep = [bool(t and t.strip()) and s.probability(t)[1] >= s.model.threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
