"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped hash arrays.

Training makes two passes. The first counts words: a sorted array of 64-bit word hashes with counts, in
range-partitioned shards in the shared folder. Each word has its place in that array as id; unseen words share one
id, which no bigram of the training text has. The second pass counts bigrams as pairs of ids (one 64-bit key). A task
sums those of ``HELD`` tokens and passes them on as one sorted array for each hash bucket; a bucket's arrays are merged
and written as a shard, keys found once apart from those with a count. There is a bucket for every ``BUCKET`` tokens, so
what a task holds doesn't grow with the data. What contexts and words need (distinct successors by count, distinct
predecessors) is pre-aggregated while writing and stored as arrays in the order of ids. Discounts come from counts of
counts; all counts cover the whole corpus.

Workers map the arrays of a ``file:`` folder into memory (pages are shared and dropped at will); of a folder
elsewhere they hold ``CACHE`` bytes of shards at most, those used last. A text is its words (A-Z lower-cased) and an end
token; its first context is a begin token.

p(w | v) = max(c(v w) - D, 0) / c(v) + g(v) p(w), D and g by modified Kneser-Ney; p(w) = max(n(w) - D', 0) / n + g'
/ (V + 1), n(w) the distinct contexts of w; an unseen context leaves p(w), and an unseen word has p(w) = g' / (V + 1).

Cases: a null or empty text is one end token; equal rows count again; without any training text each token has
probability 1; a null doc_id takes part like others. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import crc_mod, discard, documents, hash_words, materialise, mix, open_fs, released, shared_dir, slices, small_batches, words

END, BEGIN = np.uint64(0x5EED000000000001), np.uint64(0x5EED000000000002)
#: Tokens whose bigrams a counting task holds before it passes them on, and tokens of a bucket of bigrams.
HELD, BUCKET = 1_000_000, 2_000_000
#: Bytes of shards that a worker holds where it can't map them.
CACHE = 256 << 20
#: Ids of unseen words and of the begin of a text; the words of the training text follow.
UNSEEN, START, KNOWN = 0, 1, 2


def token_hashes(texts: pa.Array, strip: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words and an end) of all texts, those of their contexts, and the texts' offsets."""
    flat, at = words(texts)
    own, n = hash_words(flat, strip), np.diff(at)
    offsets = at + np.arange(len(at))
    tokens = np.full(len(own) + len(n), END)
    tokens[np.arange(len(own)) + np.repeat(np.arange(len(n)), n)] = own
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[offsets[:-1]] = BEGIN
    return tokens, context, offsets


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w, n = np.unique(token_hashes(part.column("text"))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n.astype(np.int64))], ["w", "n"])


def discounts(row: dict | None) -> tuple[float, float, float]:
    """Modified Kneser-Ney's D1, D2, D3+ from the counts of counts; 0.5, 1, 1.5 where these are zero."""
    n1, n2, n3, n4 = (float((row or {}).get(f"n{k}") or 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def of_counts(col: str) -> list:
    return [F.sum((F.col(col) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]


def write_arrays(rows: DataFrame, key: str, values: dict[str, str], folder: str) -> list[dict]:
    """Writes (key, values) as sorted arrays, a shard for each range; what comes back is a line for each shard."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name, outs, n, first, last = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", {}, 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            for c, kind in {key: "<i8", **values}.items():
                if c not in outs:
                    outs[c] = fs.open_output_stream(f"{top}/{name}.{c}", compression=None)
                outs[c].write(np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False).astype(kind)).tobytes())
            keys = b.column(key).to_numpy()
            first, last, n = keys[0] if first is None else first, keys[-1], n + len(keys)
        for f in outs.values():
            f.close()
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [n], "first": [int(first)], "last": [int(last)]})

    ordered = rows.select(key, *values).repartitionByRange(key).sortWithinPartitions(key)
    return sorted((r.asDict() for r in ordered.mapInArrow(write, "name string, n long, first long, last long").collect()), key=lambda r: r["first"])


class Files:
    """The files of a model as arrays: mapped into memory where the folder is a local or mounted one; of others those
    used last, ``CACHE`` bytes of them (one at least)."""

    def __init__(self, folder: str) -> None:
        self.fs, self.top = open_fs(folder)
        self.mapped, self.held, self.size = folder.startswith("file:"), OrderedDict(), 0

    def get(self, name: str, kind: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        path = f"{self.top}/{name}"
        if self.mapped:
            found = np.memmap(path, kind, "r") if self.fs.get_file_info(path).size else np.zeros(0, kind)
        else:
            with self.fs.open_input_file(path) as f:
                found = np.frombuffer(f.read(), kind)
            self.size += found.nbytes
            while self.held and self.size > CACHE:
                self.size -= self.held.popitem(last=False)[1].nbytes
        self.held[name] = found
        return found


class Arrays:
    """Sorted shards of keys and values."""

    def __init__(self, folder: str, shards: list[dict], key: str, values: dict[str, str]) -> None:
        self.shards, self.key, self.values, self.files = shards, key, values, Files(folder)
        self.firsts = np.array([s["first"] for s in shards], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([s["n"] for s in shards], dtype=np.int64)]).astype(np.int64)

    def _load(self, i: int, c: str, kind: str) -> np.ndarray:
        return self.files.get(f"{self.shards[i]['name']}.{c}", kind)

    def get(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The values at the keys (sorted, distinct), 0 where a key isn't there; ``at``: the key's place in all."""
        out = {c: np.zeros(len(keys), kind) for c, kind in self.values.items()} | {"at": np.zeros(len(keys), np.int64)}
        if not len(self.shards) or not len(keys):
            return out
        edges = np.concatenate([np.searchsorted(keys, self.firsts), [len(keys)]])
        for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if s < e:
                own = self._load(i, self.key, "<i8")
                at = np.minimum(np.searchsorted(own, keys[s:e]), len(own) - 1)
                hit = own[at] == keys[s:e]
                out["at"][s:e][hit] = self.starts[i] + at[hit]
                for c, kind in self.values.items():
                    out[c][s:e][hit] = self._load(i, c, kind)[at[hit]]
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


class Pairs:
    """Counts of bigrams by key, from the shards of the key's bucket."""

    def __init__(self, folder: str, shards: dict[str, str], buckets: int) -> None:
        self.files, self.shards, self.buckets = Files(folder), {int(k): v for k, v in shards.items()}, buckets

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")  # keys stay sorted in each bucket
        present, start = np.unique(bucket[order], return_index=True)
        for b, mine in zip(present.tolist(), np.split(order, start[1:]), strict=False):
            if b in self.shards:
                once, k, n = (self.files.get(f"{self.shards[b]}.{c}", kind) for c, kind in (("once", "<i8"), ("k", "<i8"), ("n", "<i8")))
                wanted = keys[mine]
                for own, value in ((once, None), (k, n)):
                    if len(own):
                        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                        hit = own[at] == wanted
                        out[mine[hit]] = 1 if value is None else value[at[hit]]
        return out


def word_ids(own: Arrays, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and training counts of the distinct words of an array, given back for each of its places."""
    ids, at = np.unique(hashes.view(np.int64), return_inverse=True)
    found = own.get(ids)
    return np.where(found["n"] > 0, found["at"] + KNOWN, UNSEEN)[at], found["n"][at]


def pair_ids(texts: pa.Array, own: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the id of its context, its own id, its count in training; and the texts' offsets."""
    w, _, offsets = token_hashes(texts)
    at, n = word_ids(own, w)
    context = np.empty_like(at)
    context[1:] = at[:-1]
    context[offsets[:-1]] = START
    return context, at, n, offsets


def _pair_counts(words_at: tuple, buckets: int):
    """For runs of tokens and each bucket one row: its pairs that are found once, the others, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own = [], 0, None

        def emit() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = bucket_of(k, buckets)
            order = np.argsort(bucket, kind="stable")
            b, start = np.unique(bucket[order], return_index=True)
            rows = [[], [], []]
            for mine in np.split(order, start[1:]):
                once = n[mine] == 1
                for out, x in zip(rows, (k[mine[once]], k[mine[~once]], n[mine[~once]].astype(np.int64)), strict=True):
                    out.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(b), *(pa.array(x, pa.binary()) for x in rows)], ["b", "once", "k", "n"])

        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                own = own or Arrays(*words_at)
                v, w, _, _ = pair_ids(part.column("text"), own)
                held.append((v << 32) | w)
                size += len(w)
                if size >= HELD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return released(run)


STATS = "context boolean, id long, c long, m1 long, m2 long, m3 long, m4 long"


def _write_pairs(folder: str):
    """Merges the arrays of each bucket (rows come by bucket) and writes them as a shard; emits what contexts and words
    need, a row for each of them and bucket, and a row for each shard (id: the bucket, m1 to m4: pairs found so often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        attempt, bucket, held = uuid.uuid4().hex, None, []
        schema = pa.schema([("context", pa.bool_()), ("id", pa.int64()), *[(c, pa.int64()) for c in ("c", "m1", "m2", "m3", "m4")], ("shard", pa.string())])

        def stats(context: bool, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            u, at = np.unique(ids, return_inverse=True)
            total = lambda x: pa.array(np.bincount(at, x, len(u)).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), context)), pa.array(u), total(n), total(n == 1), total(n == 2), total(n > 2), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.string())], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([np.frombuffer(x[c], np.int64) for x in held]) for c in range(3)]
            held.clear()
            k, n = np.concatenate(columns[:2]), np.concatenate([np.ones(len(columns[0]), np.int64), columns[2]])
            del columns
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, n = k[first], np.add.reduceat(n, first)
            once = n == 1
            for c, x in (("once", k[once]), ("k", k[~once]), ("n", n[~once])):
                with fs.open_output_stream(f"{top}/{bucket}-{attempt}.{c}", compression=None) as f:
                    f.write(x.astype("<i8").tobytes())
            yield stats(True, k >> 32, n)
            yield stats(False, k & 0xFFFFFFFF, n)
            yield pa.RecordBatch.from_pylist([{"id": bucket, **{f"m{c}": int((n == c).sum()) for c in (1, 2, 3, 4)}, "shard": f"{bucket}-{attempt}"}], schema=schema)

        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("b", "once", "k", "n")), strict=True):
                if b != bucket and held:
                    yield from close()
                bucket = b
                held.append(row)
        if held:
            yield from close()

    return released(run)


def train(docs: DataFrame, folder: str | None = None) -> str:
    """Counts words and bigrams of all texts and writes the model; returns its folder."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "kn-model")
    texts = docs.select("text")
    counted = materialise(texts.mapInArrow(_word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "kn-words")
    total = counted.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("v")).first().asDict()
    words_at = (f"{folder}/words", write_arrays(counted, "w", {"n": "<i8"}, f"{folder}/words"), "w", {"n": "<i8"})
    buckets = max(1, -(-int(total["tokens"] or 0) // BUCKET))
    pairs = texts.mapInArrow(_pair_counts(words_at, buckets), "b long, once binary, k binary, n binary").repartition(buckets, "b").sortWithinPartitions("b")
    stats = materialise(pairs.mapInArrow(_write_pairs(f"{folder}/pairs"), f"{STATS}, shard string"), "kn-stats")
    done = stats.where("shard IS NOT NULL").collect()  # a row a bucket
    shards, d = {r["id"]: r["shard"] for r in done}, discounts({f"n{k}": sum(r[f"m{k}"] for r in done) for k in (1, 2, 3, 4)})
    rows = stats.where("shard IS NULL").groupBy("context", "id").agg(*[F.sum(c).alias(c) for c in ("c", "m1", "m2", "m3")])
    contexts, own = rows.where("context"), materialise(rows.where("NOT context").select("id", (F.col("m1") + F.col("m2") + F.col("m3")).alias("n")), "kn-continuations")
    contexts = contexts.select("id", "c", ((d[0] * F.col("m1") + d[1] * F.col("m2") + d[2] * F.col("m3")) / F.col("c")).alias("g"))
    u = own.agg(*of_counts("n"), F.sum("n").alias("types"), F.count(F.lit(1)).alias("v"), F.sum((F.col("n") > 2).cast("long")).alias("m3")).first().asDict()
    e, types, v = discounts(u), float(u["types"] or 0), u["v"] or 0
    rest = (e[0] * u["n1"] + e[1] * u["n2"] + e[2] * u["m3"]) / types / (v + 1) if types else 1.0
    cut = F.when(F.col("n") == 1, e[0]).when(F.col("n") == 2, e[1]).otherwise(e[2])
    model = {
        "d": d, "rest": rest, "train_tokens": int(total["tokens"] or 0), "vocabulary": int(total["v"] or 0),
        "words": words_at[1], "buckets": buckets, "pairs": shards,
        "contexts": write_arrays(contexts, "id", {"c": "<i8", "g": "<f4"}, f"{folder}/contexts"),
        "own": write_arrays(own.select("id", (F.greatest(F.col("n") - cut, F.lit(0.0)) / F.lit(types or 1.0) + F.lit(rest)).alias("p")), "id", {"p": "<f8"}, f"{folder}/own"),
    }
    discard(counted, stats, own)
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/model.json", compression=None) as out:
        out.write(json.dumps(model).encode())
    return folder


def scorer(folder: str) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    """Scores texts from the model in a folder."""
    fs, top = open_fs(folder)
    with fs.open_input_stream(f"{top}/model.json") as f:
        m = json.loads(f.read())
    words_of = Arrays(f"{folder}/words", m["words"], "w", {"n": "<i8"})
    contexts = Arrays(f"{folder}/contexts", m["contexts"], "id", {"c": "<i8", "g": "<f4"})
    own = Arrays(f"{folder}/own", m["own"], "id", {"p": "<f8"})
    pairs = Pairs(f"{folder}/pairs", m["pairs"], m["buckets"])
    d1, d2, d3 = m["d"]
    total, size = m["train_tokens"], m["vocabulary"]

    def spread(values: Arrays, ids: np.ndarray) -> dict[str, np.ndarray]:
        u, at = np.unique(ids, return_inverse=True)
        return {k: x[at] for k, x in values.get(u).items()}

    def score(texts: pa.Array) -> dict[str, np.ndarray]:
        v, w, count, offsets = pair_ids(texts, words_of)
        context, low = spread(contexts, v), spread(own, w)["p"]
        keys, at = np.unique((v << 32) | w, return_inverse=True)
        n = pairs.get(keys)[at].astype(np.float64)
        cut = np.where(n == 1, d1, np.where(n == 2, d2, d3))
        low = np.where(low > 0, low, m["rest"])
        c = context["c"]
        p = np.where(c > 0, np.maximum(n - cut, 0) / np.maximum(c, 1) + context["g"] * low, low)
        base = np.log10((count + 1) / (total + 1 * (size + 1)))
        sums = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return {"n_tokens": np.diff(offsets), "n_known": sums((count > 0).astype(np.int64)), "base_score": sums(base), "score": sums(np.log10(np.maximum(p, 1e-300)))}

    score.train_tokens = total
    return score


def score_documents(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""

    small_batches(docs.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            for part in slices(batch):
                score = score or scorer(folder)
                r = score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(r["n_tokens"]), pa.array(r["n_known"]), pa.array(np.full(part.num_rows, score.train_tokens)), pa.array(r["base_score"]), pa.array(r["score"]), pa.array(10 ** np.minimum(-r["score"] / r["n_tokens"], 300))],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    folder = train(docs.where(crc_mod("doc_id", 7) != 2))
    return score_documents(docs, folder).select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
