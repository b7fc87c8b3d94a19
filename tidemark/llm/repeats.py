"""Repeated byte strings by bucket-pointer refinement, over documents in chunks.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller
key, or same document, earlier start). Strings are judged on the input.

A global suffix array would sort every position. Here positions are first thinned
without loss: of the Q-grams in a window of LENGTH bytes the one of least hash is its
anchor, which the window's content decides, so equal windows have equal anchors at
equal distances. Buckets then are refined from coarse to fine:

1. initial buckets: anchors of equal Q-grams;
2. refined by the bucket identifiers (hashes, folded into one) of the Q-grams at later offsets, out to the end of
   all windows that the anchor serves. Only the first anchor of such a class can
   hold first occurrences: the windows of the others go;
3. first anchors of initial buckets that split in step 2 are refined window by window:
   q-gram buckets are sorted on pairs (own bucket, bucket at the offset where it
   ends), which doubles the length each time and reuses the buckets just found, until LENGTH.
   Of a bucket that splits into more than HOT classes each chunk doubles the lengths by itself, up to the identifier of
   a whole window, and sends these; so windows of one bucket are compared in as many tasks as there are.

Every chunk first drops what repeats within itself, so that a string which
many documents share is sent once a chunk. Equality is that of 64-bit hashes: bytes are compared nowhere.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import python_on_executors, table, utf8, written
from tidemark.llm.shingles import mix

LENGTH = 100
Q = 32
GRAMS = LENGTH - Q + 1  # Q-grams in a window
#: Initial grams of step 3; twice 25 is 50, twice 50 is LENGTH.
FINE = 25
CHUNK_BYTES = 2 << 20
#: Classes of an initial bucket that are refined together; windows of buckets with more are compared by their own identifiers.
HOT = 64
#: Bytes of texts for each part of an exchange, at most; more text makes more parts.
PART_BYTES = 64 << 20
#: Windows whose anchors are found together; a packed (hash, position) has the position in the low bits.
BLOCK = 1 << 16
PLACES = np.uint64((1 << 18) - 1)
M = 0xD6E8FEB86659FD93
WRAP = (1 << 64) - 1
T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def power(n: int) -> np.uint64:
    return np.uint64(pow(M, n, 1 << 64))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams at every byte; crossing ends of documents is left to the caller."""
    h, n = T[x], 1
    while n < Q:
        new = h[:-n] * power(n)
        new += h[n:]
        h, n = new, 2 * n
    return h


class Anchors:
    """Anchors of a chunk: the windows lo..hi (bytes of the chunk) that each serves, its initial bucket and its refined class."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        empty = np.zeros(0, np.int64)
        self.lo, self.hi, self.at = empty, empty, empty
        self.bucket = self.cls = np.zeros(0, np.uint64)
        if len(x) < LENGTH or not (sizes >= LENGTH).any():
            return
        h = np.empty(len(x) - Q + 1, np.uint64)
        chosen = np.empty(len(x) - LENGTH + 1, np.int32)
        # block by block, so that the arrays stay in cache; a block runs on into the next by a window
        for at in range(0, len(chosen), BLOCK):
            own = gram_hashes(x[at : at + BLOCK + LENGTH - 1])
            h[at : at + len(own)] = own
            low = own ^ (own >> np.uint64(32))
            low *= np.uint64(0xC4CEB9FE1A85EC53)
            low &= ~PLACES
            low |= np.arange(len(low), dtype=np.uint64)
            n = 1
            while 2 * n <= GRAMS:
                low, n = np.minimum(low[:-n], low[n:]), 2 * n
            if n < GRAMS:
                low = np.minimum(low[: len(low) - (GRAMS - n)], low[GRAMS - n :])
            chosen[at : at + len(low)] = (low & PLACES).astype(np.int32) + at
        for s, n in zip(starts.tolist(), sizes.tolist()):  # windows that run over the end of a document
            chosen[max(s, s + n - LENGTH + 1) : s + n] = -1
        turn = np.flatnonzero(np.diff(chosen, prepend=np.int32(-2)))
        ends = np.append(turn[1:], len(chosen)) - 1
        served = chosen[turn] >= 0
        self.lo, self.hi = turn[served], ends[served]
        self.at = chosen[self.lo].astype(np.int64)
        self.bucket = mix(h[self.at])
        # later offsets: Q-grams from the first window's start to the last one's end, the last of them flush with it
        end = self.hi + LENGTH - Q
        c = mix(((self.at - self.lo) * 256 + (self.hi - self.lo)).astype(np.uint64))
        for k in range((LENGTH + GRAMS - 1) // Q + 1):
            c = mix(c * np.uint64(M) + h[np.minimum(self.lo + k * Q, end)])
        self.cls = c

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The first anchor of each class, in the order of (bucket, class), and for every anchor whether it is one."""
        order = np.lexsort((self.at, self.cls, self.bucket))
        b, c = self.bucket[order], self.cls[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return order[new], first


def ranks(v: np.ndarray) -> np.ndarray:
    """Bucket identifiers: equal values, equal numbers."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = np.zeros(len(v), np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(v), np.int64)
    out[order] = np.cumsum(new)
    return out


def refine(context: np.ndarray, used: np.ndarray, col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the windows that begin at (row, col) of a matrix of bytes; used marks bytes that are there."""
    width = context.shape[1]
    h = np.zeros((context.shape[0], width - FINE + 1), np.uint64)
    values = T[context]
    for k in range(FINE):
        h = h * np.uint64(M) + values[:, k : k + h.shape[1]]
    # grams at the offsets that the windows' later buckets need
    need = np.zeros(h.shape, bool)
    for k in range(0, LENGTH, FINE):
        need[row, col + k] = True
    id_ = np.zeros(h.shape, np.int64)
    id_[need] = ranks(h[need])
    n = FINE
    while n < LENGTH:
        step = min(n, LENGTH - n)
        pair = np.zeros((h.shape[0], width - n - step + 1), np.int64)
        need = np.zeros(pair.shape, bool)
        for k in range(0, LENGTH - n - step + 1, n + step):
            need[row, col + k] = True
        r, c = np.nonzero(need)
        pair[r, c] = ranks((id_[r, c].astype(np.uint64) << np.uint64(32)) | id_[r, c + step].astype(np.uint64))
        id_, n = pair, n + step
    return id_[row, col]


# --- messages ------------------------------------------------------------

ENTRY = np.dtype([("bucket", "<u8"), ("cls", "<u8"), ("order", "<i8"), ("tag", "<u8"), ("pos", "<u4")])
SINGLE = np.dtype([("bucket", "<u8"), ("order", "<i8"), ("tag", "<u8"), ("pos", "<u4"), ("lo", "<i4")])
CONTEXT = np.dtype([("bucket", "<u8"), ("order", "<i8"), ("tag", "<u8"), ("pos", "<u4"), ("lo", "<i4"), ("before", "u1"), ("windows", "u1")])
KEEP, GOES, SPLIT, CROWDED = 0, 1, 2, 3


@lru_cache(maxsize=2)
def _zstd():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, ids, sizes, tags, blob): texts of about CHUNK_BYTES together, in the order of their keys; written to the shared folder.

    A null key comes last. Tags put rows in order that repeat a key: by a hash of the text, and rows equal in that at random, as any of them may stand for the others.
    """
    python_on_executors(docs.sparkSession)

    def close(rows):
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        name = uuid.uuid4().int >> 65
        low = np.random.default_rng(name).integers(0, 1 << 32, len(rows)).tolist()
        tags = [xxhash.xxh32_intdigest(r[1]) >> 1 << 32 | x for r, x in zip(rows, low)]
        blob = _zstd()[0].compress(b"".join(r[1] for r in rows))
        cols = [pa.array([name], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[len(r[1]) for r in rows]], pa.list_(pa.int64())), pa.array([tags], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "sizes", "tags", "blob"])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for id_, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((id_, body, len(rows)))
                size += len(body)
                if size >= CHUNK_BYTES or len(rows) >= 20_000:
                    yield close(rows)
                    rows, size = [], 0
        if rows:
            yield close(rows)

    made = docs.select(F.col(f"`{key}`").cast("long").alias("id"), utf8(F.col(f"`{text}`")).alias("body")).mapInArrow(run, "chunk long, ids array<bigint>, sizes array<bigint>, tags array<bigint>, blob binary")
    return written(made, "chunks", "uncompressed")


class Chunk:
    def __init__(self, ids, sizes, tags, blob: bytes):
        self.ids, self.sizes = ids, np.array(sizes, np.int64)
        self.order = np.array([2**63 - 1 if i is None else i for i in ids], np.int64)
        self.tags = np.array(tags, np.int64).astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.x = np.frombuffer(_zstd()[1].decompress(blob, max_output_size=max(1, int(self.sizes.sum()))), np.uint8)

    def anchors(self) -> Anchors:
        return Anchors(self.x, self.starts, self.sizes)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def sliced(self, buckets: np.ndarray, parts: int) -> list[tuple[int, slice]]:
        """Slices of sorted buckets that go to each of the parts."""
        part = part_of(buckets, parts)
        turn = np.flatnonzero(np.diff(part, prepend=-1))
        return [(int(part[a]), slice(a, b)) for a, b in zip(turn, np.append(turn[1:], len(part)))]


def part_of(buckets: np.ndarray, parts: int) -> np.ndarray:
    return ((buckets >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def entries(c: Chunk, a: Anchors, which: np.ndarray) -> np.ndarray:
    out = np.zeros(len(which), ENTRY)
    d = c.doc_of(a.at[which])
    out["bucket"], out["cls"], out["order"], out["tag"] = a.bucket[which], a.cls[which], c.order[d], c.tags[d]
    out["pos"] = a.lo[which] - c.starts[d]
    return out


def judge(e: np.ndarray, hot: int) -> np.ndarray:
    """For each anchor: its windows go (its class came earlier), it is the first of its class, or that and its bucket has other classes, or more than ``hot``."""
    order = np.lexsort((e["pos"], e["tag"], e["order"], e["cls"], e["bucket"]))
    b, c = e["bucket"][order], e["cls"][order]
    first = np.ones(len(e), bool)
    first[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    start = np.ones(len(e), bool)
    start[1:] = b[1:] != b[:-1]
    group = np.cumsum(start) - 1
    classes = np.bincount(group, weights=first, minlength=group[-1] + 1 if len(group) else 0)
    out = np.zeros(len(e), np.uint8)
    out[order] = np.where(~first, GOES, np.where(classes[group] > hot, CROWDED, np.where(classes[group] > 1, SPLIT, KEEP)))
    return out


def contexts(c: Chunk, a: Anchors, which: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    out = np.zeros(len(which), CONTEXT)
    d = c.doc_of(a.at[which])
    out["bucket"], out["order"], out["tag"], out["pos"] = a.bucket[which], c.order[d], c.tags[d], a.lo[which] - c.starts[d]
    out["lo"], out["before"], out["windows"] = a.lo[which], a.at[which] - a.lo[which], a.hi[which] - a.lo[which] + 1
    raw = c.x.tobytes()
    return out, [raw[lo : hi + LENGTH] for lo, hi in zip(a.lo[which].tolist(), a.hi[which].tolist())]


def singles(c: Chunk, a: Anchors, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of these anchors by identifier, the first of each, in order; and where the others begin, which repeat within the chunk."""
    h, n = T[c.x], 1
    while 2 * n <= LENGTH:  # strings of 64 bytes; two of them cover a window
        new = h[:-n] * power(n)
        new += h[n:]
        h, n = new, 2 * n
    count = a.hi[which] - a.lo[which] + 1
    lo = np.repeat(a.lo[which], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    d = c.doc_of(lo)
    out = np.zeros(len(lo), SINGLE)
    out["bucket"] = mix(mix(h[lo]) * np.uint64(M) + h[lo + LENGTH - n])
    out["order"], out["tag"], out["pos"], out["lo"] = c.order[d], c.tags[d], lo - c.starts[d], lo
    out = out[np.lexsort((out["pos"], out["tag"], out["order"], out["bucket"]))]
    new = np.ones(len(out), bool)
    new[1:] = out["bucket"][1:] != out["bucket"][:-1]
    return out[new], out["lo"][~new].astype(np.int64)


def window_firsts(head: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """(index of context, window) pairs of windows that start earlier elsewhere. Contexts of other buckets never match."""
    order = np.lexsort((head["pos"], head["tag"], head["order"]))
    width = GRAMS - 1 + LENGTH
    m, used = np.zeros((len(head), width), np.uint8), np.zeros((len(head), width), bool)
    lens = np.array([len(b) for b in bodies], np.int64)[order]
    left = (GRAMS - 1 - head["before"].astype(np.int64))[order]
    at = np.arange(width)
    used = (at >= left[:, None]) & (at < (left + lens)[:, None])
    m[used] = np.frombuffer(b"".join(bodies[i] for i in order), np.uint8)
    counts = head["windows"].astype(np.int64)[order]
    row = np.repeat(np.arange(len(head)), counts)
    w = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    id_ = refine(m, used, left[row] + w, row)
    # equal windows have their anchor at the same column, and so lie in the same column: rows are in order, the first one stays
    by = np.argsort(id_, kind="stable")
    later = np.zeros(len(by), bool)
    later[by[1:]] = id_[by[1:]] == id_[by[:-1]]
    return np.stack([order[row[later]], w[later]])


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Byte ranges, in order, of the windows lo..hi; ranges that touch become one."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], hi[order] + LENGTH
    if not len(a):
        return np.zeros((0, 2), np.int32)
    top = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    start = np.flatnonzero(new)
    return np.stack([a[start], np.maximum.reduceat(b, start)], axis=1).astype(np.int32)


# --- operator ------------------------------------------------------------

MESSAGE = "chunk long, part int, body binary"


def _rows(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["chunk", "part", "body"])


def _gathered(replies: DataFrame) -> DataFrame:
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("part", "body")).alias("replies")).withColumnRenamed("chunk", "to")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    Null texts are empty; texts under LENGTH bytes lose nothing. Rows that repeat a key
    are documents of their own, in the order of a hash of their texts. Keys are whole numbers. Other columns are left out.
    """
    spark = docs.sparkSession
    table_ = chunks(docs, key, text)
    total = table_.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))

    def send(batches):
        for chunk, *rest in _rows(batches):
            c = Chunk(*rest)
            a = c.anchors()
            which, _ = a.distinct()
            e = entries(c, a, which)
            rows = [(chunk, part, e[s].tobytes()) for part, s in c.sliced(e["bucket"], parts)]
            if rows:
                yield _batch(rows)

    def answer(batches):
        rows = list(_rows(batches))
        if rows:
            got = [np.frombuffer(r[2], ENTRY) for r in rows]
            said = judge(np.concatenate(got), HOT)
            ends = np.cumsum([len(g) for g in got])
            out = [(r[0], r[1], _zstd()[0].compress(said[n - len(g) : n].tobytes())) for r, g, n in zip(rows, got, ends)]
            for k in range(0, len(out), 1000):
                yield _batch(out[k : k + 1000])

    entries_ = table_.select("chunk", "ids", "sizes", "tags", "blob").mapInArrow(send, MESSAGE)
    replies = written(entries_.repartition(parts, "part").mapInArrow(answer, MESSAGE), "repeats")
    known = table_.join(_gathered(replies), F.col("chunk") == F.col("to"), "left").select("chunk", "ids", "sizes", "tags", "blob", "replies")

    def sort_out(batches):
        for chunk, ids, sizes, tags, blob, replies in _rows(batches):
            c = Chunk(ids, sizes, tags, blob)
            a = c.anchors()
            which, first = a.distinct()
            got = {r["part"]: r["body"] for r in replies or []}
            said = np.full(len(which), KEEP, np.uint8)
            for part, s in c.sliced(a.bucket[which], parts):
                said[s] = np.frombuffer(_zstd()[1].decompress(got[part], max_output_size=s.stop - s.start), np.uint8)
            goes = ~first
            goes[which[said == GOES]] = True
            own, again = singles(c, a, which[said == CROWDED])
            rows = [(chunk, -1, merged(np.concatenate([a.lo[goes], again]), np.concatenate([a.hi[goes], again])).tobytes())]
            rows += [(chunk, parts + part, own[s].tobytes()) for part, s in c.sliced(own["bucket"], parts)]
            split = which[said == SPLIT]
            head, bodies = contexts(c, a, split)
            for part, s in c.sliced(head["bucket"], parts):
                n = int(s.stop - s.start)
                rows.append((chunk, part, n.to_bytes(4, "little") + head[s].tobytes() + b"".join(bodies[s])))
            yield _batch(rows)

    def crowded(rows):
        if not rows:
            return
        got = [np.frombuffer(r[2], SINGLE) for r in rows]
        e, owner = np.concatenate(got), np.repeat(np.arange(len(got)), [len(g) for g in got])
        order = np.lexsort((e["pos"], e["tag"], e["order"], e["bucket"]))
        b = e["bucket"][order]
        later = order[1:][b[1:] == b[:-1]]
        for k in np.unique(owner[later]):
            lo = e["lo"][later[owner[later] == k]].astype(np.int64)
            yield _batch([(rows[k][0], -1, merged(lo, lo).tobytes())])

    def second(batches):
        rows = list(_rows(batches))
        yield from crowded([r for r in rows if r[1] >= parts])
        rows = [r for r in rows if r[1] < parts]
        heads, bodies, owner = [], [], []
        for k, (_, _, raw) in enumerate(rows):
            n = int.from_bytes(raw[:4], "little")
            h = np.frombuffer(raw, CONTEXT, n, 4)
            at = 4 + n * CONTEXT.itemsize
            for size in (h["windows"].astype(int) + LENGTH - 1).tolist():
                bodies.append(raw[at : at + size])
                at += size
            heads.append(h)
            owner.append(np.full(n, k))
        if not rows:
            return
        head, owner = np.concatenate(heads), np.concatenate(owner)
        # whole buckets at a time, so that the matrices stay small
        order = np.argsort(head["bucket"], kind="stable")
        b = head["bucket"][order]
        ends = np.append(np.flatnonzero(b[1:] != b[:-1]) + 1, len(b))
        found, at = [], 0
        while at < len(b):
            end = int(ends[min(np.searchsorted(ends, at + 8_000), len(ends) - 1)])
            part = order[at:end]
            i, w = window_firsts(head[part], [bodies[j] for j in part])
            found.append((part[i], w))
            at = end
        index, w = (np.concatenate(x) for x in zip(*found))
        lo = head["lo"][index].astype(np.int64) + w
        for k in np.unique(owner[index]):
            mine = owner[index] == k
            yield _batch([(rows[k][0], -1, merged(lo[mine], lo[mine]).tobytes())])

    sorted_ = written(known.mapInArrow(sort_out, MESSAGE), "repeats")
    fine = sorted_.filter("part >= 0").repartition(parts, "part").mapInArrow(second, MESSAGE)
    ranges = sorted_.filter("part < 0").unionByName(fine)
    final = table_.join(_gathered(ranges), F.col("chunk") == F.col("to"), "left").select("ids", "sizes", "tags", "blob", "replies")

    def cut(batches):
        for ids, sizes, tags, blob, replies in _rows(batches):
            c = Chunk(ids, sizes, tags, blob)
            edge = np.zeros(len(c.x) + 1, np.int32)
            for r in replies or []:
                span = np.frombuffer(r["body"], np.int32).reshape(-1, 2)
                np.add.at(edge, span[:, 0], 1)
                np.add.at(edge, span[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows = []
            for id_, s, n in zip(c.ids, c.starts, c.sizes):
                g, x = gone[s : s + n], c.x[s : s + n]
                removed = int(g.sum())
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
                rows.append((id_, int(n), removed, spans, hashlib.sha256((x[~g] if removed else x).tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return final.mapInArrow(cut, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_repeats": op9_repeats}
ORACLES: dict[str, str] = {}
