"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (blanks and the word after them) are concatenated and indexed by a suffix
array as deep as the longest piece. Every piece is binary-searched for its range of occurrences;
the occurrences are edges of a lattice, which are sorted by position and relaxed from left to
right. In a byte-pair model a path is right when all neighbours on it are: two pieces may follow
each other if merging their joint text gives those two back. So each position keeps one last
piece, as a shortest-path relaxation does, with that test in place of adding scores.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, slices, table, texts_in

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Distinct chunks after which a worker starts to forget those not met again (some 200 bytes each).
REMEMBERED = 400_000
#: Characters whose chunks are indexed together.
SLICE = 2 << 20
#: Places for pairs of neighbours that a worker remembers.
PAIRS = 1 << 21
START, NONE = -1, -2


def load_model(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, read on the driver."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    kinds = "".join("u" if m.is_unknown(i) else "c" if m.is_control(i) else "b" if m.is_byte(i) else "x" if m.is_unused(i) else "n"
                    for i in range(m.get_piece_size()))
    return {"pieces": [m.id_to_piece(i) for i in range(len(kinds))],
            "scores": [m.get_score(i) for i in range(len(kinds))], "kinds": kinds}


def _chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first blank. The model puts a blank before a text."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
        return [c[1:] for c in CHUNK.findall(BLANK + text.replace(" ", BLANK))]
    return text.split(" ")


def raw_pieces(model: dict) -> list[bytes]:
    """The bytes that each id stands for; controls stand for none."""
    return [bytes([int(p[1:-1], 16)]) if k == "b" else b"" if k in "cu" else p.replace(BLANK, " ").encode()
            for p, k in zip(model["pieces"], model["kinds"])]


def decode_ids(raw: list[bytes], ids) -> str:
    text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodes whole texts; holds the model and the chunks met lately."""

    def __init__(self, model: dict):
        pieces, kinds = model["pieces"], model["kinds"]
        normal = [i for i, k in enumerate(kinds) if k == "n"]
        self.ids = {pieces[i]: i for i in normal}
        self.scores, self.pieces = model["scores"], pieces
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i, k in enumerate(kinds) if k == "b"}
        self.unknown = kinds.index("u")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        letters = sorted({ord(c) for i in normal for c in pieces[i]})
        # Codes of code points: 0 ends a chunk, 1 is in no piece.
        self.code = np.ones(0x110000, np.uint16)
        self.code[letters] = np.arange(2, len(letters) + 2)
        # Longer than any piece, so that a piece and its upper bound differ.
        self.depth = (max(len(pieces[i]) for i in normal) // 4 + 1) * 4
        self.length, self.normal = np.array([len(pieces[i]) for i in normal]), np.array(normal)
        self.patterns = np.zeros((len(normal), self.depth), np.uint16)
        for r, i in enumerate(normal):
            self.patterns[r, :len(pieces[i])] = self.code[[ord(c) for c in pieces[i]]]
        self._grow_trees(normal)
        self._forget_pairs()

    def merge(self, text: str) -> list[int]:
        """Merge neighbours of the best score, the leftmost first; the definition of the model.

        Characters in no piece become the unknown id.
        """
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple] = []
        self.last_merge = None

        def offer(i):
            j = right[i]
            if i >= 0 and j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or parts[j] != b or right[i] != j:
                continue
            self.last_merge = a, b
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [self.ids.get(p, self.unknown) for p in parts if p is not None]

    def _grow_trees(self, normal: list[int]) -> None:
        """Which pieces encode to themselves, the edges of their merge trees, and all merges.

        The right edge of a piece is its last character and every piece that this grows into; the
        left edge begins with its first character.
        """
        n, ids = len(self.pieces), self.ids
        self.alone, self.regular = np.zeros(n, bool), np.ones(n, bool)
        self.right = np.full((n, self.depth + 1), NONE, np.int32)
        self.left = np.full((n, self.depth + 1), NONE, np.int32)
        score = np.full(n + 1, -np.inf)
        score[normal] = [self.scores[i] for i in normal]
        self.score = score  # the last one, for no piece, is below all
        merges = {}
        for i in sorted(normal, key=lambda i: len(self.pieces[i])):
            p = self.pieces[i]
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    merges[a << 32 | b] = i
            self.alone[i] = self.merge(p) == [i]
            if not self.alone[i] or len(p) == 1:
                self.right[i, 0] = self.left[i, 0] = i
                continue
            a, b = (ids[x] for x in self.last_merge)
            for edge, part in ((self.right, b), (self.left, a)):
                k = int((edge[part] != NONE).sum())
                edge[i, :k], edge[i, k] = edge[part, :k], i
            self.regular[i] = all(self.regular[x] and (len(self.pieces[x]) == 1 or score[x] > score[i]) for x in (a, b))
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merge_ids = np.array([merges[k] for k in sorted(merges)], np.int64)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joint text of each two pieces is encoded to these two.

        Along the right edge of one and the left edge of the other, pieces grow in the order of
        their scores; they stay apart unless a merge across the border comes before the next
        growth. Where scores do not fall with growth, the texts are merged instead.
        """
        x, y = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        apart, todo = self.alone[a] & self.alone[b], np.flatnonzero(self.alone[a] & self.alone[b] & self.regular[a] & self.regular[b])
        odd = np.flatnonzero(apart & ~(self.regular[a] & self.regular[b]))
        for k in odd.tolist():
            apart[k] = self.merge(self.pieces[a[k]] + self.pieces[b[k]]) == [a[k], b[k]]
        none = len(self.pieces)
        while len(todo):
            p, q = self.right[a[todo], x[todo]], self.left[b[todo], y[todo]]
            key = p.astype(np.int64) << 32 | q
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            across = self.score[np.where(self.merge_keys[at] == key, self.merge_ids[at], none)]
            nx, ny = self.right[a[todo], x[todo] + 1], self.left[b[todo], y[todo] + 1]
            sx, sy = self.score[np.where(nx == NONE, none, nx)], self.score[np.where(ny == NONE, none, ny)]
            joined = (across > sx) & (across >= sy) & (across > -np.inf)
            apart[todo[joined]] = False
            go = ~joined & ((nx != NONE) | (ny != NONE))
            # Of equal growths the left one comes first, but on both sides they come before the next.
            grow_x = go & (sx >= sy)
            x[todo[grow_x]] += 1
            y[todo[go & ~grow_x]] += 1
            todo = todo[go]
        return apart

    def __getstate__(self):
        """Without what it has remembered, for a broadcast."""
        return self.__dict__ | {"known": {}, "older": {}, "pair_keys": None, "pair_ok": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget_pairs()

    def _forget_pairs(self) -> None:
        self.pair_keys, self.pair_ok = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        mixed = (key ^ key >> 17).astype(np.uint64) * MULT
        return (mixed >> np.uint64(32)).astype(np.int64) & (PAIRS - 1)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_stay_apart``, remembered in a table where a newer pair may replace an older one."""
        key = a << 32 | b
        slot = self._slot(key)
        ok, lost = self.pair_ok[slot], np.flatnonzero(self.pair_keys[slot] != key)
        if len(lost):
            fresh = np.sort(key[lost])
            fresh = fresh[np.concatenate([[True], fresh[1:] != fresh[:-1]])]
            apart = self._stay_apart(fresh >> 32, fresh & 0xFFFFFFFF)
            ok[lost] = apart[np.searchsorted(fresh, key[lost])]
            slot = self._slot(fresh)
            # Of pairs in one slot the last stays, in both arrays.
            self.pair_keys[slot], self.pair_ok[slot] = fresh, apart
        return ok

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces in a text of codes: (end, start, id)."""
        n, depth = len(codes), self.depth
        # Codes of this text alone, in as few bits as hold them; the largest value is above all.
        present = np.union1d(codes, [0, 1])
        small = np.zeros(int(self.code.max()) + 1, np.uint64)
        small[present] = np.arange(len(present))
        bits = len(present).bit_length()
        each = 64 // bits
        shifts = [np.uint64(bits * (each - 1 - j)) for j in range(each)]
        possible = np.flatnonzero(np.isin(self.patterns, present).all(axis=1))
        low = np.zeros((len(possible), -(-depth // each) * each), np.uint64)
        low[:, :depth] = small[self.patterns[possible]]
        high = np.where(np.arange(low.shape[1]) < self.length[possible][:, None], low, np.uint64((1 << bits) - 1))
        packed = lambda m, w: sum(m[:, w * each + j] << shifts[j] for j in range(each))
        low, high = ([packed(m, w) for w in range(m.shape[1] // each)] for m in (low, high))
        # Words of the suffixes, zero from the end of their chunk on.
        padded = np.concatenate([small[codes], np.zeros(len(low) * each, np.uint64)])
        stops = np.append(np.flatnonzero(padded[:n] == 0), n)
        left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        words = [np.zeros(n, np.uint64) for _ in low]
        for w, word in enumerate(words):
            for j in range(each):
                place = w * each + j
                word |= np.where(left > place, padded[place:place + n], np.uint64(0)) << shifts[j]
        suffixes = np.argsort(words[0])
        if len(words) > 1:
            key = words[0][suffixes]
            run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            longer = np.bincount(run, words[1][suffixes] > 0, minlength=n)[run] > 0
            some = suffixes[longer]
            suffixes[longer] = some[np.lexsort([w[some] for w in words[::-1]])]
        keys = [w[suffixes] for w in words]

        def rank(patterns):
            """How many suffixes sort before each pattern."""
            lo, hi = np.zeros(len(patterns[0]), np.int64), np.full(len(patterns[0]), n, np.int64)
            while (lo < hi).any():
                mid = np.minimum((lo + hi) >> 1, n - 1)
                less = np.zeros(len(lo), bool)
                for k, p in zip(keys[::-1], patterns[::-1]):
                    at = k[mid]
                    less = (at < p) | ((at == p) & less)
                lo, hi = np.where((lo < hi) & less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
            return lo

        first, last = rank(low), rank(high)
        times = last - first
        which = np.repeat(np.arange(len(times)), times)
        within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        starts = suffixes[first[which] + within]
        which = possible[which]
        lost = np.flatnonzero(codes == 1)
        starts = np.concatenate([starts, lost])
        ids = np.concatenate([self.normal[which], np.full(len(lost), self.unknown)])
        ends = starts + np.concatenate([self.length[which], np.ones(len(lost), np.int64)])
        return ends, starts, ids

    def _relax(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks; all chunks advance together, one place after the other."""
        text = "\0".join(chunks)
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.array([len(c) for c in chunks])
        begins = np.cumsum(sizes + 1) - sizes - 1
        codes[begins[1:] - 1] = 0
        ends, starts, ids = self.edges(codes)
        place = ends - np.repeat(begins, sizes + 1)[starts]
        order = np.argsort(place.astype(np.uint16) if sizes.max() < 1 << 16 else place, kind="stable")
        ends, starts, ids = ends[order], starts[order], ids[order]
        bounds = np.searchsorted(place[order], np.arange(1, sizes.max() + 2))
        last, came = np.full(len(codes) + 1, NONE), np.zeros(len(codes) + 1, np.int64)
        last[begins] = START
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            before, piece = last[starts[i:j]], ids[i:j]
            open_ = before != NONE
            free = open_ & (piece == self.unknown)
            first = open_ & ~free & ((before == START) | (before == self.unknown))
            inner = np.flatnonzero(open_ & ~free & ~first)
            ok = free | (first & self.alone[piece])
            ok[inner] = self._may_follow(before[inner], piece[inner])
            to = ends[i:j][ok]
            last[to], came[to] = piece[ok], starts[i:j][ok]
        # Walk back from all chunks' ends together.
        at, who, steps = begins + sizes, np.arange(len(chunks)), []
        while len(who):
            steps.append((who, at, last[at]))
            at = came[at]
            more = at > begins[who]
            who, at = who[more], at[more]
        who, at, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(who * (len(codes) + 1) + at)
        flat = ids[order].astype(np.int32).tobytes()
        stops = np.cumsum(np.bincount(who, minlength=len(chunks))).tolist()
        out = [flat[4 * i:4 * j] for i, j in zip([0, *stops[:-1]], stops)]
        for k in np.unique(who[ids == self.unknown]).tolist():
            out[k] = self._spelled(chunks[k], np.frombuffer(out[k], np.int32).tolist())
        return out

    def _spelled(self, text: str, ids: list[int]) -> bytes:
        """Unknown characters become the ids of their bytes."""
        out, at = [], 0
        for i in ids:
            if i == self.unknown:
                out.extend(self.byte_ids.get(x, i) for x in text[at].encode("utf-8", "replace"))
                at += 1
            else:
                out.append(i)
                at += len(self.pieces[i])
        return np.array(out, np.int32).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not met yet. Runs of blanks have equal scores, so these are merged."""
        for c in chunks:
            if c.startswith(BLANK):
                self.known[c] = self._spelled(BLANK + c, self.merge(BLANK + c))
        if rest := [c for c in chunks if not c.startswith(BLANK)]:
            self.known.update(zip(rest, self._relax([BLANK + c for c in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the bytes of 32-bit integers."""
        split = [_chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = set(chain.from_iterable(split)).difference(self.known)
        if again := new.intersection(self.older):
            self.known.update((c, self.older[c]) for c in again)
            new -= again
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

def shared_encoder(spark, path: str):
    """An encoder built once on the driver, of fixed size, as a broadcast.

    A worker keeps its copy, and with it the chunks met, from task to task.
    """
    return spark.sparkContext.broadcast(Encoder(load_model(path)))


def _added(df: DataFrame, name: str, kind) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name != name]
    return [f.name for f in kept], T.StructType([*kept, T.StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", to: str = "ids", model: str = MODEL) -> DataFrame:
    """Add the ids of a text column as ``to`` (a column of that name is replaced).

    NULL and empty texts have no ids. Whole texts are encoded, in slices of some megabytes of
    text; a chunk is encoded once per batch however often it occurs. Rows keep their order.
    """
    shared = shared_encoder(docs.sparkSession, model)
    names, schema = _added(docs, to, T.ArrayType(T.IntegerType(), False))

    def run(batches):
        encoder = shared.value
        for b in batches:
            texts = texts_in(b.column(text))
            for i, j in slices([len(t) for t in texts], SLICE):
                rows = encoder.encode(texts[i:j])
                ends = (np.cumsum([0, *map(len, rows)]) // 4).astype(np.int32)
                values = np.frombuffer(b"".join(rows), np.int32)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                    names=[*names, to])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of an id column as ``to``. NULL and empty lists give the empty text.

    The text is the encoded one, but for U+2581, which the model uses for a blank, and lone
    surrogates, which have no bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(raw_pieces(load_model(model)))
    names, schema = _added(df, to, T.StringType())

    def run(batches):
        raw = shared.value
        for b in batches:
            lists = b.column(ids)
            for i, j in slices((lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * 4).tolist()):
                part = b.slice(i, j - i)
                texts = [decode_ids(raw, x.values.to_numpy().tolist()) if x.is_valid else "" for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, to])

    return df.mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs).select("doc_id", "ids")
    return decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                                  F.sha2("decoded", 256).alias("decoded_sha256"))
