"""Language identification by nearest centroid.

A text is its byte trigrams (of the lower-cased text with a space for each ASCII byte that isn't a letter, none
across texts, none with two spaces), hashed to ``DIMS`` groups, as a
length-normalised TF-IDF vector. Spherical k-means gives several centroids per language; a text gets the language
of the centroid with the largest cosine. Distance-based rejection: each centroid has a least cosine (the
``REJECT`` quantile of its own training texts less a margin); below it the prediction is marked rejected.

Fitting uses a bounded sample, chosen by a hash of the id: about ``PER_LANG`` texts a language, fewer where there are
so many languages that this would exceed ``MAX_FIT`` in all, but ``LEAST_FIT`` a language in any case. Predicting reads
whole texts; the centroids are a few hundred KB.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang teach nothing; without
any training row every text is ``und``; ties go to the language that sorts first; equal texts get equal results; an
empty table gives no rows.
Only doc_id and text (and lang when fitting) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import crc_mod, documents, released, slices, small_batches

DIMS = 4096
PER_LANG, MAX_FIT, LEAST_FIT = 500, 4000, 20
CENTROIDS, ROUNDS = 4, 12
REJECT, MARGIN = 0.01, 0.1
#: Share of a language's training texts that a centroid must have; smaller clusters are stray texts.
LEAST_SHARE = 0.05
#: Letters stay, every other ASCII byte is a space.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)
#: Texts whose vectors are held at once.
ROWS = 1000


def vectors(texts: pa.Array) -> np.ndarray:
    """1 + log of the count of each trigram group, 0 where there is none; a row for each text."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    out = np.zeros((len(texts), DIMS), np.float32)
    if len(data) < 3:
        return out
    row, data = np.repeat(np.arange(len(texts)), np.diff(offsets)), LETTERS[data]
    space = data == 32
    code = (((data[:-2] << 16) | (data[1:-1] << 8) | data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    own = (row[:-2] == row[2:]) & (space[:-2].astype(np.int8) + space[1:-1] + space[2:] < 2)
    counts = np.bincount(row[:-2][own] * DIMS + code[own], minlength=len(texts) * DIMS).reshape(len(texts), DIMS)
    np.log1p(counts, out=out, where=counts > 0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch):
        for k in range(0, part.num_rows, ROWS):
            yield part.slice(k, ROWS)


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids, and each row's cosine with its own."""
    c = x[:1]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = unit(np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, x @ c.T


def fit(docs: DataFrame) -> dict:
    """The model: langs, idf, centroids, the language and the least cosine of each centroid."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    each = F.greatest(F.lit(LEAST_FIT), F.least(F.lit(PER_LANG), F.lit(MAX_FIT // max(n.count(), 1)))) / F.col("_n")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(n, "lang").where(draw < each).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch):
                x = vectors(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "lang", "v"])

    got = sorted((tuple(r) for r in drawn.mapInArrow(run, "doc_id long, lang string, v binary").collect()), key=lambda r: (r[1], r[0] is None, r[0] or 0, r[2]))  # bounded by the sample
    if not got:
        return {"langs": [], "idf": np.ones(DIMS, np.float32), "centroids": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int), "least": np.zeros(0)}
    x = np.stack([np.frombuffer(r[2], np.float16) for r in got]).astype(np.float32)
    lang = np.array([r[1] for r in got])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = unit(x * idf)
    langs, centroids, of, least = sorted(set(lang)), [], [], []
    for k, name in enumerate(langs):
        own = x[lang == name]
        c, cosine = cluster(own, CENTROIDS)
        size = np.bincount(cosine.argmax(1), minlength=len(c))
        c = c[size >= max(LEAST_SHARE * len(own), min(size.max(), 1))]
        cosine = own @ c.T
        for j in range(len(c)):
            mine = cosine[cosine.argmax(1) == j, j]
            centroids.append(c[j])
            of.append(k)
            least.append(float(np.quantile(mine, REJECT)) - MARGIN if len(mine) else 1.0)
    return {"langs": langs, "idf": idf, "centroids": np.stack(centroids).astype(np.float32), "of": np.array(of), "least": np.array(least)}


def predict(docs: DataFrame, model: dict, reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected. With ``reject`` a rejected text
    is ``und``; without it the nearest language stays."""
    langs = [*model["langs"], "und"]
    small_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch):
                n = part.num_rows
                letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                best, cosine, off = np.full(n, len(langs) - 1), np.zeros(n), np.zeros(n, bool)
                if len(langs) > 1:
                    c = unit(vectors(part.column("text")) * model["idf"]) @ model["centroids"].T
                    near = c.argmax(1)
                    cosine = np.where(letter, np.clip(c[np.arange(n), near], 0, 1), 0.0).astype(float)
                    off = letter & (c[np.arange(n), near] < model["least"][near])
                    best = np.where(letter & ~(off & reject), model["of"][near], len(langs) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([langs[k] for k in best], pa.string()), pa.array(cosine), pa.array(off)], ["doc_id", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs, model, reject=False).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
