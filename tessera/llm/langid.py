"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is a bag of character 1-grams to 4-grams, where a word's edges count as characters, hashed into buckets.  Its vector is
the mean of their embeddings; a linear layer and a softmax give the languages.  Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample.

A part of the sample is kept out of the descent and calibrates.  A temperature is fitted on these texts and on as many made of
their letters in random order, which should get even probabilities.  Two bounds then reject: the least probability, and the
largest share of subwords never met in training, that nearly all calibration texts keep; the second one tells languages that
were never learned, whose probabilities mean nothing.

As all is linear up to the softmax, a bucket's embedding times the layer is computed once; predicting a text of any length
then is a sum over its whole bag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 16
DIMENSION = 16
#: Expected size of the training sample: documents of a language, documents of all languages, bytes of their whole texts.
#: Where one of them binds, fewer documents are drawn, by a hash of the id.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_BYTES = 1200, 50_000, 64 << 20
#: Share of calibration texts that may be rejected by either bound.
REJECTED = 0.001
#: Log-odds by which the least probability lies below what calibration texts reach, as these are few.
MARGIN = 1.0
#: Subwords that a text is taken to have besides, all of them known, when the share of unknown ones is judged; and the least
#: such share that may reject.
PRIOR, LEAST_UNKNOWN = 8, 0.1
#: Code points of a text that are hashed at once.
CHUNK = 1 << 17


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-grams to 4-grams of a lower-cased text, chunk by chunk; everything but letters is a gap."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(points) - 3), CHUNK):
        p = points[at : at + CHUNK + 3]
        own = slice(1, CHUNK + 1)  # of the overlap, only the longer subwords belong to this chunk
        letter = ((p >= 97) & (p <= 122)) | ((p >= 0xAA) & (p != 0xD7) & (p != 0xF7) & ~((p >= 0x2000) & (p < 0x2C00)) & ~((p >= 0x3000) & (p < 0x3040)))
        p = np.where(letter, p, np.uint32(32))
        yield _bucket(p[own][letter[own]] * np.uint32(0x27220A95))
        two = p[:-1] * np.uint32(0x9E3779B1) + p[1:]
        some = letter[:-1] | letter[1:]
        yield _bucket(two[: CHUNK + 1][some[: CHUNK + 1]] ^ np.uint32(0x5851F42D))
        three = two[:-1] * np.uint32(0x85EBCA6B) + p[2:]
        inner = letter[1:-1]
        yield _bucket(three[inner & (letter[:-2] | letter[2:])])
        if len(p) > 3:
            four = three[:-1] * np.uint32(0xC2B2AE35) + p[3:]
            yield _bucket(four[letter[1:-2] & letter[2:-1]] ^ np.uint32(0x27D4EB2F))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """langs, for each bucket the scores that it adds to each language, whether training met it, and the bounds."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    met: np.ndarray
    temperature: float
    least: float
    unknown: float

    def weigh(self, text: str) -> tuple[np.ndarray, float]:
        """The languages' logits, and the share of subwords that training never met."""
        total, n, new = np.zeros(len(self.langs)), 0, 0
        for b in subwords(text):
            total += self.scores[b].sum(axis=0, dtype=np.float64)
            n, new = n + len(b), new + len(b) - int(self.met[b].sum())
        return (total / n if n else total) + self.bias, new / (n + PRIOR)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The most likely language, its calibrated probability, and whether it is rejected; ``und`` and 0 for null, or without a letter."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        z, unknown = self.weigh(text)
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.least or unknown > self.unknown)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _scrambled(text: str, rng: np.random.Generator) -> str:
    """Words of the text's length, of its letters in random order."""
    letters = [c for c in text.lower() if c.isalpha()]
    return "".join(letters[k] if c.isalpha() else c for c, k in zip(text, rng.integers(0, max(1, len(letters)), len(text)))) if letters else ""


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits a model on (text, lang).  A fifth of the rows calibrate only, where there are enough of them."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(BUCKETS, bool), 1.0, 1.0, 0.0)
    number = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    bags = []
    for text, lang in rows:
        u, c = np.unique(np.concatenate(list(subwords(text))), return_counts=True)
        if len(u):
            bags.append((u, (c / c.sum()).astype(np.float32), number[lang], text))
    order = rng.permutation(len(bags))
    held = [bags[k] for k in order[: len(bags) // 5]] if len(bags) >= 50 else bags
    learn = [bags[k] for k in order[len(bags) // 5 :]] if len(bags) >= 50 else bags
    weight = np.bincount([k for _, _, k, _ in learn], minlength=len(langs)).astype(np.float64)
    weight = np.where(weight > 0, len(learn) / np.maximum(weight, 1) / len(langs), 0)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSION, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    met = np.zeros(BUCKETS, bool)
    for u, *_ in learn:
        met[u] = True
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learn)):
            u, share, y, _ = learn[k]
            mean = share @ embed[u]
            p = _softmax(mean @ layer + bias)
            p[y] -= 1
            g = (rate * (1 - done / steps) * min(weight[y], 3)) * p.astype(np.float32)
            back = layer @ g
            layer -= np.outer(mean, g)
            bias -= 0.1 * g
            embed[u] -= (share * min(len(u), 200))[:, None] * back
            done += 1
    model = Model(langs, (embed @ layer).astype(np.float32), bias.astype(np.float64), met, 1.0, 0.0, 1.0)
    _calibrate(model, [text for *_, text in held], np.array([k for _, _, k, _ in held]), rng)
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Sets the temperature and the two bounds from texts of known languages."""
    if not texts:
        return
    weighed = [model.weigh(t) for t in texts]
    z = np.array([w[0] for w in weighed])
    noise = np.array([model.weigh(_scrambled(t[:2000], rng))[0] for t in texts])

    def logs(some: np.ndarray, t: float) -> np.ndarray:
        s = some / t - (some / t).max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def loss(t: float) -> float:
        return float(-logs(z, t)[np.arange(len(y)), y].mean() - logs(noise, t).mean())

    model.temperature = float(min(np.geomspace(0.01, 100, 120), key=loss))
    p = np.exp(logs(z, model.temperature))
    right = p.argmax(axis=1) == y
    if right.any():
        least = float(np.quantile(p.max(axis=1)[right], REJECTED))
        model.least = least / (least + (1 - least) * np.exp(MARGIN))
    model.unknown = max(LEAST_UNKNOWN, float(np.quantile([w[1] for w in weighed], 1 - REJECTED)))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(text, lang) of a sample of the documents that are not held out, of every language, within the bounds above."""
    own = docs.where(f"{lang_col} is not null and {text_col} is not null").select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(~_held_out(F.col("i")))
    own = own.withColumn("draw", F.pmod(F.xxhash64("i", "t"), F.lit(1_000_003)) / 1_000_003.0)
    counts = own.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("bytes")).collect()  # a row for each language, as the model has
    most, size = min(SAMPLE_DOCS, SAMPLE_ALL / max(1, len(counts))), SAMPLE_BYTES / max(1, len(counts))
    shares = [(r["l"], float(min(1.0, most / r["n"], size / max(1, r["bytes"])))) for r in counts]
    chosen = own.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "l string, share double")), "l").where("draw < share")
    return [(r["t"], r["l"]) for r in chosen.select("i", "t", "l").orderBy("i", "t").collect()]


def _held_out(doc_id) -> F.Column:  # type: ignore[name-defined]
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the sample of the labelled documents that are not held out."""
    return train(sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score and rejected for every row of ``docs``; with ``carry``, these columns instead of doc_id and held_out.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned; these are rejected, as is a
    score below the model's least and a text of too many subwords that training never met.  Of equal scores the language
    that comes first in order counts.  The held-out documents are those whose crc32 of the id, modulo 4, is 2; a null id is
    not held out.  Repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats and a flag for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in slices(batches):
            out = [m.predict(t) for t in b.column(0).to_pylist()]
            lang, score, rejected = (pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], lang, score, rejected], [*b.schema.names[1:], "lang_pred", "score", "rejected"])

    own = [F.col(c) for c in carry] or [F.col(id_col).alias("doc_id"), _held_out(F.col(id_col)).alias("held_out")]
    rows = docs.select(F.col(text_col).alias("_text"), *own)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")
