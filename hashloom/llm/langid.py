"""Language identification by compression.

Each language has a zstandard dictionary of raw content: a stretch of labelled
text.  A document is compressed with every dictionary and gets the language of
the smallest size, or none where the runner-up is nearly as small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_arrow, sample_texts

BLOCK = 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")
LEVEL = 3
#: Beyond 128 KiB zstandard searches a dictionary with the parameters for long inputs, which find short matches better.
DICT_BYTES = 132 << 10
MIN_MARGIN = 0.03
SCHEMA = "doc_id bigint, lang string, predicted string, margin double, accepted boolean"


def letters(text: str) -> bytes:
    """The text in lower case, with one blank for whatever is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    #: (language, raw content), by language
    content: tuple[tuple[str, bytes], ...]
    #: The runner-up must be larger by this share of the smallest size.
    min_margin: float


def build_model(sample: dict, dict_bytes: int = DICT_BYTES, min_margin: float = MIN_MARGIN) -> LanguageModel:
    """A model from {language: [(doc_id, text)]}; each text gives as many bytes as
    fit when all of a language's texts share dict_bytes evenly."""
    content = []
    for lang in sorted(sample):
        texts = sorted((letters(t) for _, t in sample[lang]), key=len)
        left, parts = dict_bytes, []
        for k, t in enumerate(texts):
            parts.append(t[: left // (len(texts) - k)])
            left -= len(parts[-1])
        if parts:
            content.append((lang, b"\n".join(parts)[:dict_bytes]))
    return LanguageModel(tuple(content), min_margin)


class Identifier:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.by = []
        for lang, data in model.content:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))

    def sizes(self, data: bytes) -> list[tuple[int, str]]:
        parts = blocks(data, BLOCK)
        return sorted((sum(len(c.compress(b)) for b in parts), lang) for lang, c in self.by)

    def best(self, text: str) -> tuple[str | None, float | None]:
        """The language of the smallest size (of equal ones the first by name) and
        its margin; (None, None) where there is no model or nothing to read."""
        data = letters(text)
        if not self.by or not data:
            return None, None
        s = self.sizes(data)
        return s[0][1], (s[1][0] - s[0][0]) / s[0][0] if len(s) > 1 else 1.0


_known: dict[LanguageModel, Identifier] = {}


def train(docs: DataFrame, per_language: int = 200, seed: int = 29, min_margin: float = MIN_MARGIN, max_languages: int = 400, least: int = 3) -> LanguageModel:
    """A model from a bounded sample: `per_language` documents of each language
    that docs.lang names.

    Labels of fewer than `least` documents are strays and count as none, and so do
    those after the `max_languages` most frequent (of equal ones the first by name).  Null labels, null ids and blank texts
    are not drawn; an id with two labels is left out; no labels, or an empty table, give a model that predicts nothing."""
    counts = docs.filter("lang is not null").groupBy("lang").count().filter(F.col("count") >= least)
    langs = [r.lang for r in counts.orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    return build_model(sample_texts(docs, docs, "lang", sorted(langs), per_language, seed), min_margin=min_margin)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang, predicted, margin, accepted) of every row of docs.

    predicted is the language of the smallest compressed size; accepted is false
    where the margin is narrow.  Null and empty texts, and those without letters, get null
    predictions and are not accepted; a null lang is only carried.  Repeated rows each get
    their (equal) row, other columns of docs are not read; an empty table gives
    no rows.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = spread.value
        if m not in _known:
            _known.clear()
            _known[m] = Identifier(m)
        known = _known[m]
        for b in batches:
            found = [known.best(t) if t else (None, None) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([p for p, _ in found], pa.string()),
                    pa.array([g for _, g in found], pa.float64()),
                    pa.array([g is not None and g >= m.min_margin for _, g in found], pa.bool_()),
                ],
                names=["doc_id", "lang", "predicted", "margin", "accepted"],
            )

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return map_arrow(picked, run, SCHEMA)
