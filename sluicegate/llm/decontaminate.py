"""Benchmark decontamination by a BM25 index of the test items.

Items are the indexed side, passages of the training texts the queries. Item impacts are divided by the item's own
score, so a score is the share of an item's BM25 weight that a passage holds, and one threshold fits all items.
Items are ordered by length and cut into blocks with the largest impact per term and block. Every passage is a
query. The block maxima of many passages are first added up at once, which leaves out passages of which no block can
reach the threshold; the others go through the postings item by item with block-max WAND: cursors are ordered by item,
the pivot is where the terms' maxima reach the threshold, a block whose maxima don't is skipped in all lists, and only
pivots that all earlier cursors have reached are scored. All items above the threshold are retrieved. They count as
leaks when enough of their question's and of their answer's word trigrams are in the passage (the bigram or word of a
part that has no more).

Passages are pairs of neighbouring chunks, a chunk being as long as the longest item, so an item inside a text is
inside a passage. Texts are read whole and once. The index goes along with the tasks; that of a benchmark beyond
``PASS_ITEMS`` items is split by a hash of the id into parts in the shared folder, which each run of texts meets one
after another; weights and passages are those of all items.

Cases: null or empty texts and items match nothing; equal items are found each by its id; for equal doc_ids the
largest figures of their rows count; an item without a question mark has its last quarter of words as answer; empty
tables give no rows. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import pickle
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sluicegate.llm.common import documents, ngram_hashes, open_fs, released, shared_dir, slices, small_batches, words

PASS_ITEMS, BLOCK_ITEMS, CHUNK = 2000, 4, 64
K1, B = 1.2, 0.75
#: Share of an item's weight from which it is retrieved, and shares of trigrams from which a leak is certain.
THRESHOLD, QUESTION, ANSWER = 0.5, 0.6, 0.5
#: What maxima in single precision may lack; maxima of chunk terms and blocks that are held at once.
SLACK, HELD_BOUNDS = 1e-5, 4_000_000
STRIP = string.punctuation
LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def plain_words(text: str | None) -> list[str]:
    """The words of an item, cut and lower-cased as those of the training texts."""
    return [x for x in (w.strip(STRIP) for w in words(pa.array([text], pa.string()), unicode=True)[0].to_pylist()) if x]


def trigrams(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The distinct word trigrams of a part of an item, or its only bigram or word if it is shorter; n goes first."""
    n = min(3, max(len(hashes), 1))
    return n, np.unique(ngram_hashes(hashes, n))


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: cut after the last question mark that has words behind it, else before the last
    quarter."""
    head, mark, tail = text.rpartition("?")
    if mark and plain_words(tail) and plain_words(head):
        return plain_words(head), plain_words(tail)
    own = plain_words(text)
    cut = len(own) - max(1, len(own) // 4)
    return own[:cut] or own, own[cut:]


def item_figures(parts: Iterable[list[tuple[int, str]]]) -> tuple[int, float, int, Counter]:
    """Number, mean and largest length of the items of all parts, and how many items hold each word."""
    n, total, longest, df = 0, 0, 0, Counter()
    for items in parts:
        for own in filter(None, (plain_words(t) for _, t in items)):
            n, total, longest = n + 1, total + len(own), max(longest, len(own))
            df.update(set(own))
    return n, total / max(n, 1), longest, df


class ItemIndex:
    """Inverted index of items with normalised BM25 impacts and block maxima; ``figures`` are those of all items."""

    def __init__(self, items: list[tuple[int, str]], figures: tuple[int, float, int, Counter]) -> None:
        texts = sorted(((i, plain_words(t), t) for i, t in items if plain_words(t)), key=lambda x: (len(x[1]), x[0]))
        self.ids = [x[0] for x in texts]
        n, mean, _, found = figures
        self.terms = {w: k for k, w in enumerate(sorted({w for _, own, _ in texts for w in own}))}
        df = np.array([found[w] for w in self.terms], float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.blocks = -(-len(texts) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms), self.blocks), np.float32)
        at, term, impact = [], [], []
        for k, (_, own, _) in enumerate(texts):
            ids, tf = np.unique([self.terms[w] for w in own], return_counts=True)
            w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
            w = w / w.sum()
            np.maximum.at(self.block_max[:, k // BLOCK_ITEMS], ids, w.astype(np.float32))
            at += [k] * len(ids)
            term += ids.tolist()
            impact += w.tolist()
        order = np.lexsort((at, term))
        start = np.searchsorted(np.array(term, np.int64)[order], np.arange(len(self.terms) + 1))
        items, impacts = np.array(at, np.int64)[order].tolist(), np.array(impact)[order].tolist()
        self.postings = [(items[s:e], impacts[s:e]) for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
        self.term_max = self.block_max.max(1, initial=0).tolist()
        hashed = lambda own: np.array([xxh64_intdigest(w) for w in own], np.uint64)
        self.parts = [tuple(trigrams(hashed(p)) for p in split_item(t)) for _, _, t in texts]

    def wand(self, terms: np.ndarray, threshold: float = THRESHOLD, live: np.ndarray | None = None) -> tuple[list[tuple[int, float]], int]:
        """All (item, score) that reach the threshold for distinct terms, by block-max WAND; and the postings read.
        ``live``: the blocks whose maxima are known to reach it, in order; others are skipped without a look."""
        begins = None if live is None else (live * BLOCK_ITEMS).tolist()
        end, low = len(self.ids), threshold - SLACK
        lists = [(*self.postings[t], self.term_max[t], self.block_max[t]) for t in terms.tolist()]
        place, item = [0] * len(lists), [x[0][0] for x in lists]
        order, out, read = sorted(range(len(lists)), key=item.__getitem__), [], 0

        def move(k: int, to: int) -> None:
            place[k] = bisect_left(lists[k][0], to, place[k])
            item[k] = lists[k][0][place[k]] if place[k] < len(lists[k][0]) else end

        while True:
            total, pivot = 0.0, -1
            for n, k in enumerate(order):
                total += lists[k][2]
                if total >= low:
                    pivot = n
                    break
            if pivot < 0 or item[order[pivot]] == end:
                return out, read
            at = item[order[pivot]]
            while pivot + 1 < len(order) and item[order[pivot + 1]] == at:
                pivot += 1
            block = at // BLOCK_ITEMS
            here = order[: pivot + 1]
            if begins is not None:
                n = bisect_right(begins, at) - 1
                if n < 0 or begins[n] != block * BLOCK_ITEMS:
                    if n + 1 == len(begins):
                        return out, read
                    for k in here:
                        move(k, begins[n + 1])
                    order.sort(key=item.__getitem__)
                    continue
            if sum(float(lists[k][3][block]) for k in here) < low:
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(order):
                    to = min(to, item[order[pivot + 1]])
                for k in here:
                    move(k, to)
            elif item[here[0]] == at:
                score = 0.0
                for k in here:
                    score += lists[k][1][place[k]]
                    read += 1
                    move(k, at + 1)
                if score >= threshold:
                    out.append((at, score))
            else:
                for k in here:
                    if item[k] < at:
                        move(k, at)
            order.sort(key=item.__getitem__)


class Passages:
    """The words of a run of texts, cut into chunks; neighbouring chunks of a text are passages."""

    def __init__(self, texts: pa.Array, size: int) -> None:
        flat, at = words(texts, unicode=True)
        coded = flat.dictionary_encode()
        self.names = pc.utf8_trim(coded.dictionary, STRIP)
        code = coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
        full = (pc.binary_length(self.names).to_numpy(zero_copy_only=False) > 0)[code]  # words of punctuation only are none
        self.at = np.concatenate([[0], np.cumsum(full)])[at]
        self.code, self.size = code[full], size
        chunks = -(-np.diff(self.at) // size)  # of each text
        self.first = np.concatenate([[0], np.cumsum(chunks)])
        self.text = np.repeat(np.arange(len(texts)), chunks)
        row = np.repeat(np.arange(len(texts)), np.diff(self.at))
        self.chunk = self.first[row] + (np.arange(len(self.code)) - self.at[row]) // size
        self.hashes = None

    def words_of(self, k: int) -> np.ndarray:
        """Hashes of the words of the passage that begins with chunk k."""
        if self.hashes is None:
            self.hashes = np.array([xxh64_intdigest(w) for w in self.names.to_pylist()], np.uint64)
        r = self.text[k]
        s = self.at[r] + (k - self.first[r]) * self.size
        return self.hashes[self.code[s : min(s + 2 * self.size, self.at[r + 1])]]


def find_leaks(index: ItemIndex, passages: Passages) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of each verified passage."""
    if not len(passages.code) or not index.ids:
        return
    own = pc.index_in(passages.names, value_set=pa.array(list(index.terms), pa.string()))  # terms are numbered in this order
    term = pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64)[passages.code]
    known = term >= 0
    pairs = np.unique(passages.chunk[known] * len(index.terms) + term[known])
    c, t = pairs // len(index.terms), pairs % len(index.terms)
    n, of = int(passages.first[-1]), passages.text
    start = np.searchsorted(c, np.arange(n + 1))
    follows = np.append(of[:-1] == of[1:], False)
    step = max(1, HELD_BOUNDS // index.blocks)  # terms of chunks whose block maxima are held at once
    s = 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(start, start[s] + step, side="right")) - 1)
        last = min(e + 1, n)  # with the chunk behind, the other half of the last passage
        bound = np.zeros((last - s + 1, index.blocks), np.float32)
        has = s + np.flatnonzero(np.diff(start[s : last + 1]))
        if len(has):
            bound[has - s] = np.add.reduceat(index.block_max[t[start[s] : start[last]]], start[has] - start[s], axis=0)
            pair = bound[: e - s] + np.where(follows[s:e, None], bound[1 : e - s + 1], 0)
            enough = pair >= THRESHOLD - SLACK
            for k in s + np.flatnonzero(enough.any(1)):
                for item, score in index.wand(np.unique(t[start[k] : start[k + 2 if follows[k] else k + 1]]), live=np.flatnonzero(enough[k - s]))[0]:
                    here = passages.words_of(k)
                    q, a = (float(np.isin(p, ngram_hashes(here, n)).mean()) if len(p) else 1.0 for n, p in index.parts[item])
                    if q >= QUESTION and a >= ANSWER:
                        yield int(of[k]), index.ids[item], score, q, a
        s = e


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the best figures of each leak."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    parts = max(1, -(-items.count() // PASS_ITEMS))
    part = lambda k: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()]  # noqa: E731, about PASS_ITEMS
    figures = item_figures(map(part, range(parts)))
    folder, only = shared_dir(spark, "item-index"), ItemIndex(part(0), figures) if parts == 1 else None
    if parts > 1:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        for k in range(parts):
            with fs.open_output_stream(f"{top}/{k}", compression=None) as f:
                f.write(pickle.dumps(ItemIndex(part(k), figures)))

    def indexes() -> Iterator[ItemIndex]:
        if only is not None:
            yield only
            return
        fs, top = open_fs(folder)
        for k in range(parts):
            with fs.open_input_stream(f"{top}/{k}", compression=None) as f:
                yield pickle.loads(f.read())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch, limit=(1 << 20) * min(parts, 8)):
                passages = Passages(texts.column("text"), max(CHUNK, figures[2]))
                rows = [r for index in indexes() for r in find_leaks(index, passages)]
                if rows:
                    ids = texts.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[j] for r in rows]) for j in (2, 3, 4))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    found = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
