"""Byte-level BPE by merge replay over the distinct words of the corpus.

Texts are cut into words, and go in blocks of about BLOCK_BYTES. Each block sends its distinct words (but those that are
one token anyway) to the words' parts by a hash; so all blocks' copies of a word meet in one part, where it is replayed
once for the whole corpus. Its ids go back to the blocks, whose texts (compressed on their way) are put together from them.

In a replay, words are laid end to end as one linked list of byte tokens. An inverted index leads from each mergeable
token pair, numbered by the rank of what it makes, to the positions where it stands. Ranks are taken in order; a merge
touches its two neighbours only, whose new pairs are entered into the index.

Ranks belong to byte strings, so a merge can bring forth a pair of a lower (or the same) rank. The queue then takes
that one first, and the rest of its word waits: within a word the order is always lowest rank first, then leftmost.
"""

from __future__ import annotations

import base64
import heapq
import math
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, small_batches, tidy

#: Distinct words in each of the two generations that a task remembers, and bytes of words that one replay takes at once.
CACHE = 400_000
REPLAY_BYTES = 1 << 17
#: Bytes of texts in a block, and what a row counts besides its text.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 64
#: Parts of the words: this many times the square root of the corpus in units of PART_BYTES, as a corpus has far fewer
#: distinct words than words. A part of more than 2 * CACHE words replays some of them again.
PARTS, PART_BYTES = 8, 64 << 20


class MergeReplay:
    """Encodes and decodes by the ranks in a file of `base64 rank` lines and a pattern that cuts texts into words."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.token = {r: t for t, r in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.bytepair = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.pair: dict[int, int] = {}
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def join(self, key: int) -> int:
        """The rank of what a pair, numbered left * 2**32 + right, makes; -1 if it can't merge. Kept in `pair`."""
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        r = self.pair[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        single, pair, join = self.single, self.pair.get, self.join
        tok = [single[b] for w in words for b in w]
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        starts, pos = [], 0
        for w in words:
            starts.append(pos)
            pos += len(w)
            if w:
                before[starts[-1]] = after[pos - 1] = -1
        # rank of the pair that begins at a place now; an entry of the index counts only while this is its rank
        now = [-1] * n
        index: defaultdict[int, list[int]] = defaultdict(list)
        bytepair = self.bytepair
        for w, i in zip(words, starts, strict=True):
            a = -1
            for b in w:
                if a >= 0:
                    r = now[i] = bytepair[a << 8 | b]
                    if r >= 0:
                        index[r].append(i)
                    i += 1
                a = b
        queue = list(index)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            r = pop(queue)
            places = index.pop(r)
            if len(places) > 1:
                places.sort()
            waiting: set[int] | None = None  # starts of words in which another merge comes first
            for i in places:
                if now[i] != r:
                    continue  # a neighbour has changed meanwhile
                if waiting and starts[bisect_right(starts, i) - 1] in waiting:
                    at = index[r]
                    if not at:
                        push(queue, r)
                    at.append(i)
                    continue
                j = after[i]
                tok[i], tok[j] = r, -1
                now[j] = -1
                k = after[i] = after[j]
                x = -1
                if k >= 0:
                    before[k] = i
                    key = r << 32 | tok[k]
                    x = pair(key)
                    if x is None:
                        x = join(key)
                    if x >= 0:
                        at = index[x]
                        if not at:
                            push(queue, x)
                        at.append(i)
                now[i] = x
                h = before[i]
                y = -1
                if h >= 0:
                    key = tok[h] << 32 | r
                    y = pair(key)
                    if y is None:
                        y = join(key)
                    now[h] = y
                    if y >= 0:
                        at = index[y]
                        if not at:
                            push(queue, y)
                        at.append(h)
                if 0 <= x <= r or 0 <= y <= r:
                    waiting = waiting or set()
                    waiting.add(starts[bisect_right(starts, i) - 1])
        out, starts = [], [*starts, n]
        for k in range(len(words)):
            out.append([t for t in tok[starts[k] : starts[k + 1]] if t >= 0])
        return out

    def learn(self, new: list[str]) -> None:
        """Replay words that are not yet known, some megabytes at a time."""
        part, size = [], 0
        for w in [*new, None]:
            if w is not None:
                b = w.encode()
                r = self.ranks.get(b)
                if r is not None:  # an entry of the vocabulary is one token
                    self.packed[w] = r.to_bytes(4, "little")
                    continue
                part.append((w, b))
                size += len(b)
            if part and (w is None or size > REPLAY_BYTES):
                for (x, _), ids in zip(part, self.replay([b for _, b in part]), strict=True):
                    self.packed[x] = pack(ids)
                part, size = [], 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cuts = [self.cut(t) if t else [] for t in texts]
        self.recall(w for c in cuts for w in c)
        return [b"".join(map(self.packed.__getitem__, c)) for c in cuts]

    def recall(self, words: Iterable[str]) -> dict[str, bytes]:
        """A table that has, among others, the packed ids of these words; each that is new is replayed."""
        if len(self.packed) > CACHE:
            self.older, self.packed = self.packed, {}
        new = []
        for w in dict.fromkeys(w for w in words if w not in self.packed):
            known = self.older.get(w)
            if known is None:
                new.append(w)
            else:
                self.packed[w] = known
        self.learn(new)
        return self.packed

    def by_part(self, words: Iterable[str], parts: int) -> tuple[dict[str, bytes], dict[int, list[bytes]]]:
        """Distinct words that are one token, with its packed id; and the others' bytes by part, in order."""
        ranks, known, rest = self.ranks, {}, defaultdict(list)
        for w in set(words):
            b = w.encode()
            r = ranks.get(b)
            if r is None:
                rest[zlib.crc32(b) % parts].append(b)
            else:
                known[w] = r.to_bytes(4, "little")
        for x in rest.values():
            x.sort()
        return known, rest

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, unpack(packed)))


def pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4 or array("H", [1]).tobytes() != b"\1\0":
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return a.tobytes()


def unpack(packed: bytes) -> list[int]:
    return [] if not packed else memoryview(packed).cast("I").tolist() if array("H", [1]).tobytes() == b"\1\0" else [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@lru_cache(maxsize=2)
def replayer(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


SEPARATOR = b"\xff"  # is in no UTF-8 text


def name_of(words: bytes) -> bytes:
    return blake2b(words, digest_size=16).digest()


def pack_ids(each: list[bytes]) -> bytes:
    return zlib.compress(np.array([len(x) for x in each], "<u4").tobytes() + b"".join(each), 1)


def unpack_ids(packed: bytes, n: int) -> list[bytes]:
    raw = zlib.decompress(packed)
    ends = (np.frombuffer(raw, "<u4", n).astype(np.int64).cumsum() + 4 * n).tolist()
    return [raw[i:j] for i, j in zip([4 * n, *ends], ends, strict=False)]


class Blocks:
    """Numbers the blocks of one task's texts; a text belongs to the block in which it begins."""

    def __init__(self):
        self.base, self.done = TaskContext.get().partitionId() << 32, 0

    def of(self, texts: pa.Array) -> np.ndarray:
        cost = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
        ends = self.done + cost.cumsum()
        self.done = int(ends[-1]) if len(ends) else self.done
        return self.base + (ends - cost) // BLOCK_BYTES


def words_of_blocks(df: DataFrame, path: str, pattern: str, parts: int) -> DataFrame:
    """Rows (block, part, words) of texts in `df` (one column): a block's distinct words of a part, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, blocks, now, words = replayer(path, pattern), Blocks(), None, set()

        def sent() -> pa.RecordBatch:
            rest = r.by_part(words, parts)[1]
            blobs = [zlib.compress(SEPARATOR.join(x), 1) for x in rest.values()]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(rest), pa.int64()), pa.array(rest.keys(), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part", "words"])

        for b in batches:
            for block, t in zip(blocks.of(b.column(0)).tolist(), b.column(0).to_pylist(), strict=True):
                if block != now:
                    if words:
                        yield sent()
                    now, words = block, set()
                if t:
                    words.update(r.cut(t))
        if words:
            yield sent()
        tidy()

    return df.mapInArrow(run, "block long, part int, words binary")


def replayed(sent: DataFrame, path: str, pattern: str, parts: int) -> DataFrame:
    """Rows (block, part, name, ids) of `words_of_blocks`: all blocks' words of a part meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = MergeReplay(path, pattern)
        for b in batches:
            for i in range(b.num_rows):
                raw = zlib.decompress(b.column(2)[i].as_py())
                words = raw.decode("utf-8", "surrogateescape").split("\udcff")
                table = r.recall(words)
                one = [pa.array([name_of(raw)], pa.binary()), pa.array([pack_ids([table[w] for w in words])], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *one], names=["block", "part", "name", "ids"])
        del r
        tidy()

    return sent.repartition(parts, "part").mapInArrow(run, "block long, part int, name binary, ids binary")


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids", back: str | None = None) -> DataFrame:
    """`df` with a binary column `out`: the ids of `text_col`, packed as little-endian unsigned 32-bit integers. With
    `back`, a binary column of that name has the bytes that these ids decode to.

    Null and empty texts give an empty value. All other columns, their nulls and repeated rows pass through; columns
    that are already called so are replaced. An empty table gives an empty result. Texts of any length are one block at
    most. Should a rerun part texts into other blocks than those whose words were replayed, the names of the words don't
    match, and the block's words are replayed where they are.
    """
    new = [out, back] if back else [out]
    df = small_batches(df.drop(*new))
    at, names, kinds = df.columns.index(text_col), df.columns, [f.dataType.simpleString() for f in df.schema]
    own = [f"_own{i}" for i in range(len(names))]
    df = df.toDF(*own)
    size = df.agg(F.sum(F.octet_length(own[at]).cast("long"))).first()[0] or 0
    parts = PARTS * math.ceil(math.sqrt(max(1, size / PART_BYTES)))
    learned = replayed(words_of_blocks(df.select(own[at]), path, pattern, parts), path, pattern, parts)
    sent = ["binary" if i == at else k for i, k in enumerate(kinds)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for b in batches:
            cols = b.columns
            cols[at] = pa.array([t and zlib.compress(t.encode(), 1) for t in b.column(at).to_pylist()], pa.binary())  # an empty text has no byte
            yield pa.RecordBatch.from_arrays([*cols, pa.array(blocks.of(b.column(at)), pa.int64())], names=[*own, "block"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, now = replayer(path, pattern), None
        ids: dict[int, tuple[bytes, bytes]] = {}
        held: list[pa.RecordBatch] = []

        def made() -> Iterator[pa.RecordBatch]:
            texts = [[t if t is None else zlib.decompress(t).decode() if t else "" for t in b.column(at).to_pylist()] for b in held]
            cuts = [[r.cut(t) if t else [] for t in x] for x in texts]
            table, rest = r.by_part((w for x in cuts for c in x for w in c), parts)
            for part, words in rest.items():
                name, packed = ids.get(part, (None, b""))
                if name == name_of(SEPARATOR.join(words)):
                    table.update(zip((w.decode() for w in words), unpack_ids(packed, len(words)), strict=True))
                else:
                    table.update(zip((w.decode() for w in words), map(pack, r.replay(words)), strict=True))
            for b, t, x in zip(held, texts, cuts, strict=True):
                cols = b.columns[: len(own)]
                cols[at] = pa.array(t, pa.string())
                done = [b"".join(map(table.__getitem__, c)) for c in x]
                both = [done, map(r.decode, done)] if back else [done]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(y, pa.binary()) for y in both)], names=[*names, *new])

        for b in batches:
            block, text = b.column(len(own)).to_numpy(), pc.is_null(b.column(len(own) + 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (text[1:] != text[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
            for i, j in zip(edges, edges[1:], strict=False):
                if block[i] != now:
                    yield from made()
                    now, ids, held = block[i], {}, []
                if text[i]:
                    held.append(b.slice(i, j - i))
                else:
                    cols = (b.column(len(own) + k).slice(i, j - i).to_pylist() for k in (1, 2, 3))
                    ids.update((part, (name, x)) for part, name, x in zip(*cols, strict=True))
        yield from made()
        held.clear()
        tidy()

    texts = df.mapInArrow(number, ", ".join([*(f"{o} {k}" for o, k in zip(own, sent, strict=True)), "block long"])).selectExpr("*", "CAST(NULL AS INT) AS part", "CAST(NULL AS BINARY) AS name", "CAST(NULL AS BINARY) AS ids")
    nothing = [F.lit(None).cast(k).alias(o) for o, k in zip(own, sent, strict=True)]
    both = texts.unionByName(learned.select(*nothing, "block", "part", "name", "ids"))
    # a block's ids stand before its texts
    met = both.repartition("block").sortWithinPartitions("block", F.col("part").asc_nulls_last())
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)) + "".join(f", `{c}` binary" for c in new)
    return met.mapInArrow(assemble, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`df` with a binary column `out`: the bytes that the packed ids in `ids_col` stand for; null ids give empty bytes."""
    df = df.drop(out)
    at = df.columns.index(ids_col)

    def make():
        r = replayer(path, pattern)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array([r.decode(x or b"") for x in b.column(at).to_pylist()], pa.binary())], names=[*b.schema.names, out])

        return batch

    return map_batches(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` binary")


def encode_digest(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the packed ids and of the bytes decoded from them."""
    done = encode(df.select(id_col, "text"), path, pattern, back="decoded")
    return done.select(id_col, (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
