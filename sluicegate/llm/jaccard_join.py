"""Exact Jaccard self-join of word-shingle sets with a count-vector R-tree, and its components.

A set is the 64-bit hashes of a document's distinct 5-word shingles. Hashed to ``GROUPS`` groups, its counts are a
point; two sets share at most the sum of the coordinate minima. Points are packed into an R-tree whose nodes hold the
largest coordinates and the range of set sizes, so a node or a pair whose bound stays below the overlap that the
threshold needs is dropped. Surviving pairs are bounded once more by count vectors whose groups grow with the set, and
then verified on the sets.

The tree alone can't be spread over a cluster without comparing everything with everything, so the points are dealt
by an exact filter first: with one order of all shingles, linked sets share a shingle among their first
n - ceil(t n) + 1. The order puts shingles that are frequent in a sample last (any order is exact), so common passages
make no large groups. Sets that are equal become one node. What has a shingle in common is a run, and has a tree.

Only components are wanted, so no list of all pairs is ever made:
1. Each set is verified against the one with which it shares most among the first sets of its runs; links give
   components.
2. In runs of ``CROWD`` components or more, points outside of the run's largest component search the tree for the
   likeliest few of its members; this is repeated while it links something. It only saves work in
3. where the points outside of each run's largest component search the tree for all points of other components. A
   point's candidates in one component are one row, verified until the first link, as one joins the whole component.
No link between different components is lost, so components are exact; links inside a component need no listing. A
run's tree has ``RUN_ROWS`` points of its largest component at most: longer runs are cut into blocks, and the points
outside of that component visit each. Candidates in a component meet its members in blocks of ``BLOCK_SIZE`` shingles.

Cases: a null or empty text has no shingle and is linked with nothing (its component is its doc_id); with fewer than 5
words the whole sequence is one shingle; each row has the component of its own text, so rows that share a doc_id may
differ; rows with a null doc_id are linked as others, and a component is named by its smallest doc_id that isn't null
(null if there is none); an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from sluicegate.llm.common import discard, documents, hash_words, materialise, mix, ngram_hashes, release, released, slices, small_batches, words

SHINGLE, PERCENT, GROUPS = 5, 75, 128
#: Texts of the sample that ranks frequent shingles, least count in it, and ranked shingles at most.
SAMPLE, LEAST, RANKED = 8_000, 3, 200_000
#: Children of a node of the tree, and a coordinate that says nothing.
FANOUT, NO_LIMIT = 32, 255
#: The first step verifies pairs that share one in so many of the set's shingles among their first ones.
CLEAR = 20
#: Components of a run from which the second step sees to it, candidates of a point in it, and repetitions.
CROWD, LIKELIEST, REPEATS = 8, 4, 2
#: Points of a block of a run; shingles of a block of a component's members; queries of a verifying group.
RUN_ROWS, BLOCK_SIZE, QUERIES = 8192, 1 << 21, 4096
#: Point pairs held at once while a tree is searched.
HELD_PAIRS = 200_000
#: Rows that are broadcast at most (about 60 bytes each); above it the same join shuffles.
BROADCAST_ROWS = 500_000


def shared_by(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap that sets of n and m need to be linked."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def need(n: int) -> int:
    """The overlap that a set of n needs with any set it is linked with."""
    return -(-PERCENT * n // 100)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, at = words(texts)
    own = hash_words(flat)
    grams = ngram_hashes(own, SHINGLE)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= SHINGLE:
            yield np.unique(grams[s : e - SHINGLE + 1])
        else:
            yield ngram_hashes(own[s:e], int(e - s)) if e > s else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([divmod(xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def count_vector(own: np.ndarray) -> np.ndarray:
    """Counts of the groups in bytes; a count too large for one lifts the whole bound, which stays valid."""
    n = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=GROUPS)
    return np.full(GROUPS, NO_LIMIT, np.uint8) if n.max(initial=0) >= NO_LIMIT else n.astype(np.uint8)


def fine_vector(own: np.ndarray) -> bytes:
    """Counts in bytes of about one group for two shingles, a power of two in number; empty if one is too large."""
    bits = max(7, int(len(own) - 1).bit_length() - 1) if len(own) else 7
    n = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"" if n.max(initial=0) > 255 else n.astype(np.uint8).tobytes()


def folded(fine: np.ndarray, groups: int) -> np.ndarray:
    """A fine vector with its groups added up to so many."""
    return fine.reshape(groups, -1).sum(1, dtype=np.int32) if len(fine) > groups else fine


def bounds(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What sets with such vectors share at most."""
    most = np.minimum(u, v).sum(-1, dtype=np.int64)
    return np.where(most == NO_LIMIT * GROUPS, 1 << 40, most)


def prefix(own: np.ndarray, ranked: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by rank (0 if not ranked), then hash."""
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, own), len(ranked) - 1)
        own = own[np.lexsort((own, np.where(ranked[at] == own, rank[at], 0)))]
    return own[: len(own) - need(len(own)) + 1] if len(own) else own


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, sorted, and their counts. Only the order depends on it."""
    n = docs.count()
    share = min(1.0, SAMPLE / max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                h, c = np.unique(np.concatenate(sets).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int64))], ["h", "c"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    top = drawn.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST).orderBy(F.desc("c"), "h").limit(RANKED).collect()
    h, c = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def describe(docs: DataFrame) -> DataFrame:
    """rid (a number of its own), doc_id, n, signature (s1, s2), count vectors and first shingles of each row."""
    ranked, rank = frequent(docs)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                firsts = [prefix(s, ranked, rank) for s in sets]
                sign = signatures(sets)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in firsts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sign[:, 0]), pa.array(sign[:, 1]), pa.array([count_vector(s).tobytes() for s in sets], pa.binary()), pa.array([fine_vector(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(firsts).view(np.int64)))],
                    ["doc_id", "n", "s1", "s2", "vec", "fine", "first"],
                )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, vec binary, fine binary, first array<long>")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "jaccard-sets")


ROLE = "kind int, node long, c long, block int, ys array<long>"
#: Kinds of rows: a member of a component that is a candidate, a set to verify, its candidates.
MEMBER, QUERY, LIST = 0, 1, 2


class Exact:
    """Verifies on the sets: gives the first member that a query is linked with."""

    schema = "a long, b long"

    def __init__(self, own: bytes) -> None:
        self.own = np.frombuffer(own, np.uint64)

    def links(self, ys: np.ndarray, members: dict[int, bytes]) -> list[int]:
        done, step, own = 0, 4, self.own
        while done < len(ys):
            sets = [np.frombuffer(members[y], np.uint64) for y in ys[done : done + step].tolist()]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            same = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, np.cumsum(size) - size, dtype=np.int64)
            hit = np.flatnonzero(100 * same >= PERCENT * (len(own) + size - same))
            if len(hit):
                return [int(ys[done + hit[0]])]
            done, step = done + step, 64
        return []


class Likely:
    """Verifies on fine count vectors: gives all members that a query may be linked with."""

    schema = "kind int, node long, c long, block int, ys array<long>"

    def __init__(self, own: bytes) -> None:
        self.n, self.fine, self.folds = int.from_bytes(own[:8], "big"), np.frombuffer(own, np.uint8, offset=8), {}

    def links(self, ys: np.ndarray, members: dict[int, bytes]) -> list[int]:
        out, alike = [], defaultdict(list)
        for y in ys.tolist():
            size = len(members[y]) - 8
            if size and len(self.fine):
                alike[size].append(y)
            else:
                out.append(y)  # nothing is known
        for size, some in alike.items():
            groups = min(size, len(self.fine))
            if groups not in self.folds:
                self.folds[groups] = folded(self.fine, groups)
            for s in range(0, len(some), 256):
                part = some[s : s + 256]
                n = np.array([int.from_bytes(members[y][:8], "big") for y in part])
                v = np.frombuffer(b"".join([members[y][8:] for y in part]), np.uint8).reshape(len(part), groups, -1)
                v = v[:, :, 0] if size == groups else v.sum(2, dtype=np.int32)
                same = np.minimum(v, self.folds[groups]).sum(1, dtype=np.int64)
                out += [y for y, k in zip(part, (100 * same >= PERCENT * (self.n + n - same)).tolist(), strict=True) if k]
        return out


def _verify(judge: type):
    """Over rows sorted by group, members first, then each query and its candidates: what the judge says of them. Holds
    the members of one group."""

    def rows(found: list[tuple]) -> pa.RecordBatch:
        if judge is Exact:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[3][0] for f in found], pa.int64())], ["a", "b"])
        lists = [(LIST, x, c, block, ys) for x, c, block, ys in found]
        members = [(MEMBER, y, c, block, None) for y, c, block in dict.fromkeys((y, c, block) for _, c, block, ys in found for y in ys)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lists, *members, strict=True), kinds, strict=True)], ["kind", "node", "c", "block", "ys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, node, query, lists, found = None, {}, None, None, [], []

        def judged() -> None:
            if lists:
                ys, n = np.unique(np.concatenate(lists), return_counts=True)
                hit = query.links(ys[np.argsort(-n, kind="stable")], members)  # those met in most runs first
                if hit:
                    found.append((node, *group[:2], hit))
                lists.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("c", "block", "salt", "kind", "node")]
            for k, (*g, kind, x) in enumerate(zip(*columns, strict=True)):
                if g != group or x != node or kind == MEMBER:
                    judged()
                if g != group:
                    group, members, node = g, {}, None
                if kind == MEMBER:
                    members.setdefault(x, batch.column("own")[k].as_py())
                elif kind == QUERY:
                    if x != node:
                        node, query = x, judge(batch.column("own")[k].as_py())
                else:
                    lists.append(np.asarray(batch.column("ys")[k].values))
            if len(found) >= 1000:
                yield rows(found)
                found = []
        judged()
        if found:
            yield rows(found)

    return released(run)


def dealt(roles: DataFrame, nodes: DataFrame, judge: type, contents) -> DataFrame:
    """What the judge says of the candidates in roles; contents(wanted, within) gives rows of wanted with their
    ``own``: the nodes in roles by group, with what nodes has of them. Groups of many queries are salted."""
    lists = roles.where(F.col("kind") == LIST)
    queries = lists.select("node", "c", "block").distinct()
    salts = materialise(queries.groupBy("c", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts")), "jaccard-salts")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    members = roles.where(F.col("kind") == MEMBER).select("node", "c", "block").distinct().join(salts, ["c", "block"]).select("node", "c", "block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(MEMBER).alias("kind"))
    asked = queries.join(salts, ["c", "block"]).select("node", "c", "block", salt, F.lit(QUERY).alias("kind"))
    wanted = materialise(members.unionByName(asked).join(nodes, "node"), "jaccard-wanted")
    within = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda df: df
    rows = contents(wanted, within).select("c", "block", "salt", "kind", "node", "own", F.lit(None).cast("array<long>").alias("ys"))
    rows = rows.unionByName(lists.join(salts, ["c", "block"]).select("c", "block", salt, "kind", "node", F.lit(None).cast("binary").alias("own"), "ys"))
    ordered = rows.repartition("c", "block", "salt").sortWithinPartitions("c", "block", "salt", F.col("kind") > MEMBER, "node", "kind")
    out = materialise(ordered.mapInArrow(_verify(judge), judge.schema), f"jaccard-{judge.__name__.lower()}")
    discard(salts, wanted)
    release(out.sparkSession)
    return out


def verified(roles: DataFrame, docs: DataFrame, nodes: DataFrame, fines: DataFrame) -> DataFrame:
    """Links (a, b) of query nodes a with members b of the components c that they have candidates in: one at least
    of each query, component and block that has any. Fine vectors are compared first; sets are made again from the
    texts of the nodes that are left, so no table of all sets is needed."""

    @released
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                sign = signatures(sets)
                yield pa.RecordBatch.from_arrays([pa.array(sign[:, 0]), pa.array(sign[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "own"])

    def sets(wanted: DataFrame, within) -> DataFrame:
        ids = wanted.select(F.col("id").alias("_id")).distinct()
        texts = docs.join(within(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        return texts.mapInArrow(make, "s1 long, s2 long, own binary").join(within(wanted.drop("id")), ["s1", "s2"])

    likely = dealt(roles, nodes.select("node"), Likely, lambda wanted, within: fines.join(within(wanted), "node"))
    links = dealt(likely, nodes.select("node", "s1", "s2", "id"), Exact, sets)
    discard(likely)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with, for all nodes in links. Labels spread over links and jump to
    their label's label, so long chains take few rounds; each round is a written table."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = materialise(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old"), "labels")
        discard(labels)
        if not new.where("label <> old").limit(1).count():
            discard(both)
            return new.select("node", "label")
        labels = new.select("node", "label")
        labels.written = new.written


class RTree:
    """A packed tree over count vectors: children sorted by set size, then by the heaviest coordinates."""

    def __init__(self, vec: np.ndarray, n: np.ndarray, comp: np.ndarray) -> None:
        self.order = np.lexsort((vec.argmax(1), n))
        self.levels = [(vec[self.order], n[self.order], n[self.order], comp[self.order], comp[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            top, lo, hi, c_lo, c_hi = self.levels[-1]
            cut = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(c_lo, cut), np.maximum.reduceat(c_hi, cut)))

    def search(self, vec: np.ndarray, n: np.ndarray, comp: np.ndarray, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, point) of different components that may be linked, with their bounds, for queries with the
        given vectors, sizes and components; ``only``: points of this component."""
        q = at = most = None
        for level in range(len(self.levels) - 1, -1, -1):
            top, lo, hi, c_lo, c_hi = self.levels[level]
            if q is None:
                q, at = np.repeat(np.arange(len(n)), len(top)), np.tile(np.arange(len(top)), len(n))
            else:
                q, at = np.repeat(q, FANOUT), (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, at = q[at < len(top)], at[at < len(top)]
            keep = (100 * hi[at] >= PERCENT * n[q]) & (PERCENT * lo[at] <= 100 * n[q]) & ~((c_lo[at] == comp[q]) & (c_hi[at] == comp[q]))
            if only is not None:
                keep &= (c_lo[at] <= only) & (only <= c_hi[at])
            q, at = q[keep], at[keep]
            most = bounds(top[at], vec[q])  # of what any point below can share
            keep = 100 * most >= PERCENT * (n[q] + np.maximum(lo[at], most) - most)
            q, at, most = q[keep], at[keep], most[keep]
        return q, self.order[at], most


@released
def _shared_posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (first, node, pos) rows those whose shingle two or more nodes have, with the smallest node as head.
    Holds one row of a run, however long it is."""
    last = None  # shingle, head, the head's pos, whether the head's own row is out

    for batch in batches:
        if not batch.num_rows:
            continue
        first, node, pos = (batch.column(c).to_numpy() for c in ("first", "node", "pos"))
        start = np.concatenate([[last is None or first[0] != last[0]], first[1:] != first[:-1]])
        head_at = np.maximum.accumulate(np.where(start, np.arange(len(first)), -1))
        head = np.where(head_at >= 0, node[head_at], 0 if last is None else last[1])
        keep = ~start | np.concatenate([~start[1:], [False]])
        out = [first[keep], node[keep], pos[keep], head[keep]]
        if last is not None and not last[3] and not start[0]:
            out = [np.concatenate([[x], y]).astype(y.dtype) for x, y in zip((last[0], last[1], last[2], last[1]), out, strict=True)]
        k = head_at[-1]
        out_already = bool(keep[-1])
        last = (first[-1], head[-1], pos[k] if k >= 0 else last[2], out_already or (k < 0 and last[3]))
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["first", "node", "pos", "head"])


def _search(widely: bool):
    """Candidates across components of each run (shingle and block) of the sorted rows, as roles: all of them, or
    (not ``widely``) the likeliest few in the run's largest component of each point outside of it."""
    names = ("first", "part", "node", "pos", "n", "comp", "main", "blocks", "home")

    def pairs(r: dict, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Surviving pairs of rows, and their bounds."""
        size = np.diff(starts)
        run = np.repeat(np.arange(len(size)), size)
        few = np.flatnonzero((size <= FANOUT)[run])  # a run of one leaf: all its rows at once with their neighbours
        left = r["n"] - r["pos"]  # in the run of the first shingle that two sets share, they share none before it
        for d in range(1, min(FANOUT, int(size[size <= FANOUT].max(initial=1)))):
            a = few[:-d] if d < len(few) else few[:0]
            a = a[run[a] == run[np.minimum(a + d, len(run) - 1)]] if len(a) else a
            a = a[a + d < len(run)]
            b = a + d
            keep = (r["comp"][a] != r["comp"][b]) & (r["home"][a] | r["home"][b]) & (np.minimum(left[a], left[b]) >= shared_by(r["n"][a], r["n"][b]))
            if not widely:
                keep &= (r["comp"][a] == r["main"][a]) | (r["comp"][b] == r["main"][b])
            a, b = a[keep], b[keep]
            most = bounds(r["vec"][a], r["vec"][b])
            keep = 100 * most >= PERCENT * (r["n"][a] + r["n"][b] - most)
            if keep.any():
                yield a[keep], b[keep], most[keep]
        for k in np.flatnonzero(size > FANOUT):
            rows = np.arange(starts[k], starts[k + 1])
            main = int(r["main"][rows[0]])
            home, ask = rows[r["home"][rows]], rows[r["comp"][rows] != main]
            if not len(home) or not len(ask):
                continue
            tree = RTree(r["vec"][home], r["n"][home], r["comp"][home])
            step = max(1, HELD_PAIRS // len(home))
            for s in range(0, len(ask), step):
                own = ask[s : s + step]
                q, at, most = tree.search(r["vec"][own], r["n"][own], r["comp"][own], None if widely else main)
                a, b = own[q], home[at]
                keep = (a != b) & (np.minimum(left[a], left[b]) >= shared_by(r["n"][a], r["n"][b]))
                if keep.any():
                    yield a[keep], b[keep], most[keep]

    def ends(r: dict, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each pair the query, the other node, its component and that one's block, and the bound."""
        a_main, b_main = r["comp"][a] == r["main"][a], r["comp"][b] == r["main"][b]
        turn = (a_main & ~b_main) | ((a_main == b_main) & (r["comp"][a] < r["comp"][b]))  # the query is outside of the largest one, else in the later one
        x, y = np.where(turn, b, a), np.where(turn, a, b)
        return r["node"][x], r["node"][y], r["comp"][y], (mix(r["node"][y].view(np.uint64)) % r["blocks"][y].astype(np.uint64)).astype(np.int32), most

    def roles(x: np.ndarray, y: np.ndarray, c: np.ndarray, block: np.ndarray, most: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not widely:
            order = np.lexsort((-most, x))
            rank = np.arange(len(x)) - np.maximum.accumulate(np.where(np.concatenate([[True], x[order][1:] != x[order][:-1]]), np.arange(len(x)), 0))
            x, y, c, block = (z[order][rank < LIKELIEST] for z in (x, y, c, block))
        order = np.lexsort((y, block, c, x))
        x, y, c, block = x[order], y[order], c[order], block[order]
        once = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (c[1:] != c[:-1])])
        x, y, c, block = x[once], y[once], c[once], block[once]
        cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1]) | (block[1:] != block[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(y)).astype(np.int32)), pa.array(y))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), LIST, np.int32)), pa.array(x[cut]), pa.array(c[cut]), pa.array(block[cut]), lists], ["kind", "node", "c", "block", "ys"])
        _, once = np.unique(y, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), MEMBER, np.int32)), pa.array(y[once]), pa.array(c[once]), pa.array(block[once]), pa.nulls(len(once), pa.list_(pa.int64()))], ["kind", "node", "c", "block", "ys"])

    @released
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, size = None, [], 0

        def found(r: dict, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of many runs are held to list each of them once; the likeliest of a point are of one batch."""
            nonlocal held, size
            for a, b, most in pairs(r, starts):
                held.append(ends(r, a, b, most))
                size += len(a)
                if size >= HELD_PAIRS and widely:
                    yield from roles(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
            if held and not widely:
                yield from roles(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            x["vec"] = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.uint8).reshape(-1, GROUPS)
            rest = x if rest is None else {k: np.concatenate([rest[k], v]) for k, v in x.items()}
            new = (rest["first"][1:] != rest["first"][:-1]) | (rest["part"][1:] != rest["part"][:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            if len(starts) > 1:
                yield from found(rest, starts)
                rest = {k: v[starts[-1] :] for k, v in rest.items()}
        if rest is not None:
            yield from found(rest, np.array([0, len(rest["first"])]))
        if held:
            yield from roles(*map(np.concatenate, zip(*held, strict=True)))

    return search


def candidates(live: DataFrame, comps: DataFrame, sized: DataFrame, widely: bool) -> DataFrame:
    """Roles of the candidates in runs of several components (``widely``) or of many."""
    whole = comps.join(sized.select("node", "n"), "node").groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SIZE).cast("int").alias("blocks"))
    labelled = materialise(comps.join(whole, "label").select("node", "label", "blocks"), "jaccard-labels")
    member = live.select("first", "node", "pos").join(labelled, "node", "left").select("first", "node", "pos", F.coalesce("label", "node").alias("comp"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    runs = member.groupBy("first", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("first").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    mixed = runs.where(F.col("comps") >= (2 if widely else CROWD)).select("first", F.ceil(F.col("rows") / RUN_ROWS).cast("int").alias("parts"), "main")
    points = member.join(mixed, "first").join(sized, "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    visits = F.when((F.col("parts") == 1) | (F.col("comp") == F.col("main")), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = points.select("first", "node", "pos", "n", "vec", "comp", "main", "blocks", own.alias("own"), F.explode(visits).alias("part"))
    spread = spread.select("first", "part", "node", "pos", "n", "comp", "main", "blocks", (F.col("part") == F.col("own")).alias("home"), "vec")
    roles = materialise(spread.repartition("first", "part").sortWithinPartitions("first", "part").mapInArrow(_search(widely), ROLE), "jaccard-roles")
    discard(labelled)
    release(live.sparkSession)
    return roles


def heads(live: DataFrame, sized: DataFrame) -> DataFrame:
    """Roles that give each node the one with which it shares most among the first nodes of its runs."""
    shared = live.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    own = sized.select("node", "n")
    fitting = shared.join(own, "node").join(own.select(F.col("node").alias("head"), F.col("n").alias("head_n")), "head").where((100 * F.col("head_n") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("head_n")) & (CLEAR * F.col("c") >= F.col("n")))
    best = fitting.groupBy("node").agg(F.max(F.struct("c", (-F.col("head")).alias("head"))).alias("b")).select("node", (-F.col("b.head")).alias("head"))
    pairs = materialise(best, "jaccard-heads")
    role = lambda kind, node, ys: pairs.select(F.lit(kind).alias("kind"), F.col(node).alias("node"), F.col("head").alias("c"), F.lit(0).alias("block"), ys.cast("array<long>").alias("ys"))
    return role(LIST, "node", F.array("head")).unionByName(role(MEMBER, "head", F.lit(None)).distinct())


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = describe(docs)
    # equal sets are one node, numbered by the first of their rows
    nodes = materialise(table.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("id")), "jaccard-nodes")
    rep = table.withColumnRenamed("rid", "node").join(nodes.select("node"), "node", "left_semi")
    sized = materialise(rep.select("node", "n", "vec"), "jaccard-points")
    fines = materialise(rep.select("node", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "fine").alias("own")), "jaccard-fine")
    posts = rep.select(F.posexplode("first").alias("pos", "first"), "node").select("first", "node", "pos")
    live = materialise(posts.repartition("first").sortWithinPartitions("first", "node").mapInArrow(_shared_posts, "first long, node long, pos int, head long"), "jaccard-posts")
    rows = materialise(table.select("doc_id", "n", "s1", "s2"), "jaccard-rows")
    discard(table)  # what is read from here on is written by itself
    release(docs.sparkSession)
    comps, more = components(verified(heads(live, sized), docs, nodes, fines)), True
    for widely in [False] * REPEATS + [True]:
        if widely or more:
            roles = candidates(live, comps, sized, widely)
            links = verified(roles, docs, nodes, fines)
            more = not links.isEmpty()
            if more:
                comps = components(comps.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b").unionByName(links))
            discard(roles, links)
    discard(live, sized, fines)
    labelled = nodes.join(comps, "node", "left").select("n", "s1", "s2", "id", F.coalesce("label", "node").alias("label"))
    named = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    final = materialise(labelled.join(named, "label").select("n", "s1", "s2", "component_id"), "jaccard-components")
    return rows.join(final, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir))
