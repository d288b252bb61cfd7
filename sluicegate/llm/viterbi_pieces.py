"""SentencePiece encoding and decoding with a streaming Viterbi.

The vocabulary file gives the pieces (never trained here). It holds ranks, so a piece's log-probability is taken as
Zipf-Mandelbrot in its rank; characters without a piece fall back to byte pieces. The stream is read in chunks. Of each
the encoder finds the pieces that begin at each place (a trie is walked from all places at once) and the boundaries that
no piece reaches across: there all surviving backpointer paths meet, whatever follows, so the ids before are committed
and forgotten. Between two commits scores are pushed forward, in all such windows of a chunk side by side. What lies
behind the last commit waits for the next chunk; should that grow to ``PATIENCE`` characters, the paths of its live ends
are walked back, and what they share is committed too (where they share nothing, as in a run of one character, this is
tried again whenever it has doubled). Ties keep the longer piece.

Spaces become the meta symbol and one is put in front of the text; a meta symbol in the text itself goes through
byte pieces, so decoding gives every text back exactly. No piece holds a meta symbol after another character (this is
checked), so every stream commits in front of each word, and what is committed between two such places depends on the
characters there alone: the distinct ones of a slice of texts are one stream, whose ids are put together for all texts,
and decoded, in arrays.

Cases: a null text has null ids, an empty one none; lone rows, repeated rows and ties need nothing special; an empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sluicegate.llm.common import documents, ragged, released, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Zipf-Mandelbrot's shift, and what a byte piece costs below the rarest piece.
SHIFT, BYTE_COST = 2.7, 10.0
#: Characters of a chunk of the stream, and of a window from which paths are walked back.
CHUNK, PATIENCE = 1 << 15, 1 << 12
#: Scores are whole multiples of one over this, so sums are exact and ties are the same wherever a text is cut.
SCALE = 1 << 20


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values (large_binary, without nulls) in order, and where each one's begin."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


class Pieces:
    """Encodes and decodes by the pieces of a model file's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte_id, self.bytes_of, normal = {}, [b""] * n, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, piece))
                self.bytes_of[i] = piece.replace(META, " ").encode()
        total = sum(1 / (k + SHIFT) for k in range(1, len(normal) + 1))
        self.table: dict[str, tuple[int, int]] = {}
        for k, (i, piece) in enumerate(normal, 1):
            self.table[piece] = (i, round(-SCALE * math.log((k + SHIFT) * total)))
        self.byte_score = round(SCALE * (-math.log((len(normal) + SHIFT) * total) - BYTE_COST))
        self.longest = max((len(p) for _, p in normal), default=1)
        self.splits = not any(a != META and b == META for _, p in normal for a, b in zip(p, p[1:]))
        self.spelled = pa.array(self.bytes_of, pa.binary())
        self._grow([(piece, *self.table[piece]) for _, piece in normal])

    def _grow(self, pieces: list[tuple[str, int, int]]) -> None:
        """The trie as arrays: a number for each character, the node that follows a node by a character (a hash table),
        and each node's piece and score (-1 and 0: none)."""
        letters = sorted({c for p, _, _ in pieces for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes, follow = {"": 0}, {}
        for p, _, _ in pieces:
            for end in range(1, len(p) + 1):
                if p[:end] not in nodes:
                    nodes[p[:end]] = len(nodes)
                    follow[nodes[p[: end - 1]] * (len(letters) + 1) + int(self.number[ord(p[end - 1])])] = nodes[p[:end]]
        self.width, self.piece, self.score = len(letters) + 1, np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int64)
        for p, i, s in pieces:
            self.piece[nodes[p]], self.score[nodes[p]] = i, s
        bits = max(4, (4 * len(follow)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for key, slot in zip(follow, self._slot(np.array(list(follow), np.int64)).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.next[slot] = key, follow[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that follow (-1: none)."""
        key = node * self.width + letter
        slot = self._slot(key)
        out, found = self.next[slot], self.keys[slot]
        lost = np.flatnonzero((found != key) & (found >= 0))
        out[found != key] = -1
        while len(lost):
            slot[lost] = (slot[lost] + 1) % len(self.keys)
            found = self.keys[slot[lost]]
            hit = found == key[lost]
            out[lost[hit]] = self.next[slot[lost[hit]]]
            lost = lost[~hit & (found >= 0)]
        return out

    def _arcs(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each length the node of the piece that begins at each place (-1: none); where the longest one ends. A
        place without a piece of one character has one of length 1 with node -2, which stands for its bytes."""
        n = len(chars)
        arcs, far = np.full((self.longest + 1, n), -1, np.int32), np.arange(1, n + 1)
        letter, active, node = self.number[chars], np.arange(n), np.zeros(n, np.int64)
        for size in range(1, self.longest + 1):
            active, node = active[active + size <= n], node[active + size <= n]
            node = self._step(node, letter[active + size - 1]).astype(np.int64)
            active, node = active[node >= 0], node[node >= 0]
            if not len(active):
                break
            full = self.piece[node] >= 0
            arcs[size, active[full]] = node[full]
            far[active[full]] = active[full] + size
        arcs[1][arcs[1] < 0] = -2
        return arcs, far

    def _push(self, chars: np.ndarray, arcs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over windows side by side; window k has its boundary at offset j in place starts[k] + j + k of the
        arrays. Gives the places of the windows' begins, and each boundary's last piece: its length and node."""
        begin = starts - starts[0] + np.arange(len(starts))
        total = int(ends[-1] - starts[0]) + len(starts)
        best, size, last = np.full(total, -(1 << 62), np.int64), np.zeros(total, np.int32), np.full(total, -1, np.int32)
        best[begin] = 0
        cost = self.byte_score * (1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)).astype(np.int64)
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        live = np.searchsorted((starts - ends)[order], -np.arange(int((ends - starts).max())), side="left")
        for j, k in enumerate(live.tolist()):
            mine = order[:k]
            at, place = starts[mine] + j, begin[mine] + j
            score = best[place]
            for n in range(1, min(self.longest, int((ends - starts)[order[0]]) - j) + 1):
                node = arcs[n, at]
                some = np.flatnonzero(node != -1)
                if not len(some):
                    continue
                node = node[some]
                s = score[some] + np.where(node >= 0, self.score[node], cost[at[some]])
                to = place[some] + n
                up = s > best[to]
                best[to[up]], size[to[up]], last[to[up]] = s[up], n, node[up]
        return begin, size, last

    def _spell(self, chars: np.ndarray, places: np.ndarray, at: np.ndarray, size: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the characters that each takes, of the pieces that end in the given places, in their order; at: the
        text place where each begins."""
        order = np.argsort(places, kind="stable")
        node, taken, at = last[places[order]], size[places[order]].astype(np.int64), at[order]
        ids = np.where(node >= 0, self.piece[node], -1)
        raw = np.flatnonzero(ids < 0)
        if not len(raw):
            return ids, taken
        spelled = [[self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars[at[raw]].tolist()]
        n = np.ones(len(ids), np.int64)
        n[raw] = list(map(len, spelled))
        out, ends = np.repeat(ids, n), np.cumsum(n)
        out[ragged(ends[raw] - n[raw], n[raw])] = [b for part in spelled for b in part]
        used = np.zeros(len(out), np.int64)
        used[ends - 1] = taken
        return out, used

    def commits(self, chunks: Iterable[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Streams normalised text that comes in chunks; gives (commits, ids, characters that each id takes) whenever
        something could be committed."""
        chunks, chars, done, patience = iter(chunks), np.zeros(0, np.uint32), False, PATIENCE
        while not done:
            more = next(chunks, None)
            done = more is None
            if more:
                chars = np.concatenate([chars, np.frombuffer(more.encode("utf-32-le", "surrogatepass"), np.uint32)])
            n = len(chars)
            sure = n if done else n - self.longest  # pieces that begin before it are known
            if sure <= 0:
                continue
            arcs, far = self._arcs(chars)
            far = np.maximum.accumulate(far[:sure])
            cuts = np.flatnonzero(far == np.arange(1, sure + 1)) + 1  # boundaries that no piece reaches across
            if len(cuts):
                starts = np.concatenate([[0], cuts[:-1]])
                yield len(cuts), *self._paths(chars, arcs, starts, cuts)
                chars, patience = chars[cuts[-1] :], PATIENCE
            if len(chars) >= patience and not done:
                at = self._meeting(chars)
                if at:
                    arcs = self._arcs(chars)[0]
                    yield 1, *self._paths(chars, arcs, np.array([0]), np.array([at]))
                    chars = chars[at:]
                patience = max(PATIENCE, 2 * len(chars))

    def _paths(self, chars: np.ndarray, arcs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path through each window."""
        begin, size, last = self._push(chars, arcs, starts, ends)
        here, text_at, places, at = begin + (ends - starts), ends.copy(), [], []
        live = np.arange(len(starts))
        while len(live):
            places.append(here[live])
            step = size[here[live]]
            here[live] -= step
            text_at[live] -= step
            at.append(text_at[live])
            live = live[here[live] > begin[live]]
        return self._spell(chars, np.concatenate(places), np.concatenate(at), size, last)

    def _meeting(self, chars: np.ndarray) -> int:
        """The last boundary that the paths of all live ends share (0: none but the start)."""
        arcs, far = self._arcs(chars)
        sure = len(chars) - self.longest
        arcs[:, sure:] = -1
        _, size, _ = self._push(chars, arcs, np.array([0]), np.array([len(chars)]))
        live = {e for e in range(sure, int(far[:sure].max()) + 1) if size[e]}
        while len(live) > 1:  # the latest end steps back until all are one
            last = max(live)
            live.remove(last)
            live.add(last - int(size[last]))
        return live.pop()

    def _streamed(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised text, and how many characters of it each ends behind."""
        parts = list(self.commits(text[k : k + CHUNK] for k in range(0, len(text), CHUNK)))
        return np.concatenate([p[1] for p in parts]), np.cumsum(np.concatenate([p[2] for p in parts]))

    def _stretches(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of what lies between two places where every stream commits: a pool, and where each one's begin and how
        many they are. Those that begin with a space behind another character are one stream."""
        data, at = _bytes_of(keys)
        together = (data[at[:-1]] == 0x20) & (data[at[1:] - 1] != 0x20) & self.splits
        start, size, pool, used = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        if together.any():
            data, at = _bytes_of(keys.filter(pa.array(together)))
            ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at[1:]]  # in characters
            ids, taken = self._streamed(data.tobytes().decode("utf-8", "surrogatepass").replace(" ", META))
            cut = np.searchsorted(taken, ends, side="right")
            start[together], size[together] = np.concatenate([[0], cut[:-1]]), np.diff(cut, prepend=0)
            pool, used = [ids], len(ids)
        for k in np.flatnonzero(~together).tolist():
            key = keys[k].as_py()
            ids = [self.byte_id[b] for b in key] if key == META.encode() else self._streamed(key.decode("utf-8", "surrogatepass").replace(" ", META))[0]
            start[k], size[k] = used, len(ids)
            pool.append(np.asarray(ids))
            used += len(ids)
        return np.concatenate(pool).astype(np.int32), start, size

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and where each text's ids begin (one entry more than texts)."""
        data, at = _bytes_of(pc.fill_null(texts, "").cast(pa.large_binary()))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        filled = np.diff(at) > 0
        cut = np.zeros(len(data) + 1, bool)
        cut[at[:-1][filled]] = True
        first = cut.copy()
        meta = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        first[meta] = False  # a meta symbol stands alone; the space in front of the text is put before it
        if self.splits:
            space = data == 0x20
            cut[1:-1] |= space[1:] & ~space[:-1]
        cut[meta] = cut[meta + 3] = True
        starts = np.flatnonzero(cut[:-1])
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        code = runs.indices.to_numpy().astype(np.int64) * 2 + first[starts]
        present, code = np.unique(code, return_inverse=True)
        spaces = pa.DictionaryArray.from_arrays(pa.array(present % 2), pa.array([b"", b" "], pa.large_binary())).dictionary_decode()
        pool, begin, size = self._stretches(pc.binary_join_element_wise(spaces, runs.dictionary.take(pa.array(present // 2)), pa.scalar(b"", pa.large_binary())))
        ids = pool[ragged(begin[code], size[code])]
        ends = np.concatenate([[0], np.cumsum(size[code])])
        offsets = ends[np.searchsorted(starts, at)]
        alone = np.isin(at[:-1], meta) & filled  # texts that begin with a meta symbol: their space is a stretch of its own
        if alone.any():
            space = self._stretches(pa.array([b" "], pa.large_binary()))[0]
            ids = np.insert(ids, np.repeat(offsets[:-1][alone], len(space)), np.tile(space, int(alone.sum())))
            offsets = offsets + len(space) * np.concatenate([[0], np.cumsum(alone)])
        return ids, offsets

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of ids (as UTF-8), without the space in front."""
        if not len(ids):
            return pa.array([b""] * (len(offsets) - 1), pa.binary())
        spelled = self.spelled.take(pa.array(ids)).cast(pa.large_binary())
        data = np.frombuffer(spelled.buffers()[2], np.uint8)
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[offsets]
        filled, rest = np.diff(ends) > 0, np.ones(len(data), bool)
        rest[ends[:-1][filled]] = False
        at = ends - np.concatenate([[0], np.cumsum(filled)])
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[rest])])

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join([self.bytes_of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, round_trip (decoding the ids gives the text). The model's bytes go along with the tasks."""
    with open(model_path, "rb") as f:
        model = f.read()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                pieces = pieces or Pieces(model)
                texts = part.column("text")
                ids, offsets = pieces.encode_all(texts)
                same = pc.fill_null(pc.equal(pieces.decode_all(ids, offsets), texts.cast(pa.binary())), True)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(np.diff(offsets)), same], ["doc_id", "ids", "n_ids", "round_trip"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids themselves, their number, and whether they decode to the text."""
    return encode_documents(documents(spark, sf_dir)).select("doc_id", "n_ids", "ids", "round_trip")
