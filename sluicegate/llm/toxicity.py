"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated modified Kneser-Ney model of the characters of a word, given all of the word before
them. Both classes back off, with one weight, to a model with the shared counts of both, of the same order: an
expression that is rare favours a class by no more than what its discounted count says, what is unknown favours none,
and an unseen word is judged by the beginning that it shares with known ones. Counts are of documents that hold the word, so repetition within a text counts once. A text's
log-likelihood ratio is that of its 2, 4 and 8 most telling distinct words, and the mean of all; a logistic fit weighs
these and normalises them by the logarithm of the number of words, as more words give larger maxima by chance. Its
offset is moved so that ``THRESHOLD`` is where the fitted rows are told apart best (by F1). Words are lower-cased and
taken without punctuation and digits at their ends; one of more than ``LONGEST`` characters is several.

Fitting uses a bounded sample of labelled rows, chosen by a hash of the id: about ``MAX_TOXIC`` toxic and
``MAX_ORDINARY`` ordinary ones. The fit sees each of its texts through models without the counts of that text's third
of the sample, the models in use have all counts. The ratios are sorted hash arrays in the shared folder, mapped by the
workers.

Cases: a null or empty text has no words and gets the score of that; labels that are null or without a document
are ignored, repeated labels count once, and a doc_id with both labels is left out; without labels of both classes
every score is 0 (of both in all thirds, for the fit); equal texts have equal scores; an empty table gives no rows. Only doc_id and text, and doc_id and
toxic of the labels, are read.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import crc_mod, discard, documents, materialise, mix, open_fs, released, shared_dir, slices, small_batches, spread, words
from sluicegate.llm.kn_lm import Arrays, discounts, of_counts, write_arrays

MAX_TOXIC, MAX_ORDINARY = 4000, 8000
STRIP = string.punctuation + string.digits
#: Most telling words that are added up, the score from which a text counts as toxic, and characters of a word.
TELLING, THRESHOLD, LONGEST = (2, 4, 8), 0.7, 64
#: Probability of any next character where no count says anything (the same for both classes).
ANY_CHARACTER = 1 / 64
FEATURES = len(TELLING) + 2
FOLDS = 3
CELLS = [f"{c}{k}" for k in range(FOLDS) for c in "ot"]
ROOT = np.uint64(0x5EED)


def word_sets(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, and (text, word) pairs, each once and in order."""
    flat, at = words(texts, unicode=True)
    coded = flat.dictionary_encode()
    own = [w.strip(STRIP) for w in coded.dictionary.to_pylist()]
    names = {w: k for k, w in enumerate(dict.fromkeys(own))}
    code = np.array([names[w] for w in own], np.int64)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    pairs = np.unique(spread(at) * max(len(names), 1) + code)
    text, word = pairs // max(len(names), 1), pairs % max(len(names), 1)
    full = word != names.get("", -1)
    return pa.array(list(names), pa.string()), text[full], word[full]


def beginnings(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of each word, and an end: the word, the hash of what goes before it, and that with it."""
    ends = pc.binary_join_element_wise(names, "\x03", "")
    size = pc.utf8_length(ends).to_numpy().astype(np.int64)
    chars = np.frombuffer("".join(ends.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = (np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)) % LONGEST
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(LONGEST + 1))
    before, own = np.full(len(chars), ROOT), np.zeros(len(chars), np.uint64)
    for k in range(LONGEST):
        i = order[edges[k] : edges[k + 1]]
        if k:
            before[i] = own[i - 1]
        own[i] = mix(before[i] * np.uint64(0x9E3779B97F4A7C15) + chars[i] + np.uint64(1))
    return np.repeat(np.arange(len(names)), size), before.view(np.int64), own.view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beginnings of words, and how many ordinary (o) and toxic (t) texts of each third have each in a word."""
    for batch in batches:
        for part in slices(batch):
            names, text, word = word_sets(part.column("text"))
            if len(names):
                kind = (part.column("toxic").to_numpy(zero_copy_only=False) + 2 * part.column("fold").to_numpy(zero_copy_only=False))[text]
                at, before, own = beginnings(names)
                n = {c: np.bincount(word[kind == k], minlength=len(names))[at] for k, c in enumerate(CELLS)}
                t = pa.table({"v": before, "w": own, **n}).group_by(["v", "w"]).aggregate([(c, "sum") for c in CELLS])
                yield from t.select(["v", "w", *(f"{c}_sum" for c in CELLS)]).rename_columns(["v", "w", *CELLS]).to_batches()


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic and fold of the labelled rows that are used."""
    labelled = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, MAX_TOXIC / max(n.get(1, 0), 1)).otherwise(MAX_ORDINARY / max(n.get(0, 0), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.broadcast(labelled.where(draw < share))  # about MAX_TOXIC + MAX_ORDINARY rows of two numbers
    return docs.select("doc_id", "text").join(drawn, "doc_id").select("text", "toxic", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def train(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> str:
    """Fits the two models and the logistic weights; returns the folder that holds them."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "toxicity")
    used = materialise(sample(docs, labels), "toxicity-sample")
    n = used.select("fold", "toxic").distinct().count()
    model = {"fitted": n == 2 * FOLDS, "w": [0.0] * (FEATURES + 1)}
    if model["fitted"]:
        counts = used.mapInArrow(_counts, f"v long, w long, {', '.join(f'{c} long' for c in CELLS)}").groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in CELLS])
        counts, rows = materialise(counts, "toxicity-counts"), []
        thirds = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)]
        model["known"] = ratios(counts, [*thirds, list(range(FOLDS))], folder)
        discard(counts)
        _save(folder, model)
        for k in range(FOLDS):
            seen = used.where(F.col("fold") == k).mapInArrow(_features_of(folder, k), "x array<double>, toxic int")
            rows += [tuple(r) for r in seen.collect()]  # bounded by the sample
        x, y = np.array([r[0] for r in rows]).reshape(-1, FEATURES), np.array([r[1] for r in rows], float)
        w = np.array(fit(np.column_stack([x, y])))
        w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(x @ w[:-1] + w[-1], y)
        model["w"] = w.tolist()
    discard(used)
    _save(folder, model)
    return folder


def ratios(counts: DataFrame, models: list[list[int]], folder: str) -> list[dict]:
    """Writes models, each of the counts of its folds, as log-likelihood ratios r0, r1 and so on of all beginnings known
    (0 where a model doesn't know one). One pass serves all models. Gives the shards."""
    numbers = range(len(models))
    summed = lambda c, m: sum((F.col(f"{c}{k}") for k in models[m]), F.lit(0))
    pairs = counts.select("v", "w", *[x for m in numbers for x in (summed("t", m).alias(f"t_{m}"), summed("o", m).alias(f"o_{m}"), (summed("t", m) + summed("o", m)).alias(f"s_{m}"))])
    names = [f"{c}_{m}" for m in numbers for c in "tos"]
    n = pairs.agg(*[x.alias(f"{c}_{k}") for c in names for k, x in enumerate(of_counts(c), 1)]).first()
    d = {c: discounts({f"n{k}": n[f"{c}_{k}"] for k in (1, 2, 3, 4)}) for c in names}
    cut = lambda c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[c][0]).when(F.col(c) == 2, d[c][1]).otherwise(d[c][2])
    contexts = pairs.groupBy("v").agg(*[F.sum(c).alias(f"n{c}") for c in names], *[F.sum(cut(c)).alias(f"g{c}") for c in names])
    joined, out = pairs.join(contexts, "v"), []
    for m in numbers:
        t, o, s = f"t_{m}", f"o_{m}", f"s_{m}"
        # what a model leaves to the one below it, in a context; the same for both classes, so what is unknown favours none
        left = F.col(f"g{s}") / F.col(f"n{s}")
        shared = (F.col(s) - cut(s)) / F.col(f"n{s}") + left * ANY_CHARACTER
        p = lambda c: F.when(F.col(f"n{c}") > F.col(f"g{c}"), (F.col(c) - cut(c)) / (F.col(f"n{c}") - F.col(f"g{c}")) * (1 - left) + left * shared).otherwise(shared)  # noqa: E731, B023
        out.append(F.when(F.col(s) > 0, F.log(p(t)) - F.log(p(o))).otherwise(0.0).alias(f"r{m}"))
    known = materialise(joined.select("w", *out), "toxicity-ratios")
    shards = write_arrays(known, "w", {f"r{m}": "<f8" for m in numbers}, f"{folder}/known")
    discard(known)
    return shards


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which on rows are told to be of class 1 with the largest F1 (between two rows' scores)."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    f = np.where(np.append(s[:-1] > s[1:], True), 2 * hit / (np.arange(1, len(s) + 1) + y.sum()), -1)  # rows with equal scores go together
    k = int(np.argmax(f))
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def _save(folder: str, model: dict) -> None:
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/model.json", compression=None) as out:
        out.write(json.dumps(model).encode())


def fit(rows: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    """Logistic regression by Newton's steps; the last column is the label. The weights come for raw features."""
    if not len(rows) or len(set(rows[:, -1])) < 2:
        return [0.0] * rows.shape[1]
    x, y = rows[:, :-1], rows[:, -1]
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    raw = w[:-1] / sd
    return [*raw.tolist(), float(w[-1] - (raw * mean).sum())]


def features(folder: str, model: int = FOLDS) -> Callable[[pa.Array], np.ndarray]:
    """For texts, by one of the models: the log-likelihood ratios of the most telling words, the mean of all, and the log of their number."""
    fs, top = open_fs(folder)
    with fs.open_input_stream(f"{top}/model.json") as f:
        m = json.loads(f.read())
    column = f"r{model}"
    known = Arrays(f"{folder}/known", m["known"], "w", {column: "<f8"})

    def of(texts: pa.Array) -> np.ndarray:
        names, text, word = word_sets(texts)
        at, _, own = beginnings(names)
        own, place = np.unique(own, return_inverse=True)
        ratio = np.bincount(at, known.get(own)[column][place], len(names))[word]
        order = np.lexsort((-ratio, text))
        text, ratio = text[order], ratio[order]
        n = np.bincount(text, minlength=len(texts))
        rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        sums = [np.bincount(text, np.where(rank < k, ratio, 0), len(texts)) for k in TELLING]
        return np.column_stack([*sums, np.bincount(text, ratio, len(texts)) / np.maximum(n, 1), np.log(np.maximum(n, 1))])

    return of


def _features_of(folder: str, model: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            for part in slices(batch):
                of = of or features(folder, model)
                x = of(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column("toxic").cast(pa.int32())], ["x", "toxic"])

    return run


def score(docs: DataFrame, folder: str) -> DataFrame:
    """The rows with toxic_score (0 to 1). Columns keep their names; one named toxic_score is replaced."""
    fs, top = open_fs(folder)
    with fs.open_input_stream(f"{top}/model.json") as f:
        m = json.loads(f.read())
    docs = docs.drop("toxic_score")
    if not m["fitted"]:
        return docs.withColumn("toxic_score", F.lit(0.0))
    weights = np.array(m["w"])
    small_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                of = of or features(folder)
                s = 1 / (1 + np.exp(-np.clip(of(part.column("text")) @ weights[:-1] + weights[-1], -40, 40)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, "toxic_score"])

    return docs.mapInArrow(run, docs.withColumn("toxic_score", F.lit(0.0)).schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    folder = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    scored = score(docs, folder)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
