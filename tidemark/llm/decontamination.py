"""Benchmark decontamination by edit distance in words.

The CGK embedding walks along a string: each step emits the current word and moves on
or stays as a random function of step and word says, so strings at a small edit
distance mostly fall into step again and their embeddings have a small Hamming distance.
Bit-sampling LSH keeps a few of the embedding's symbols as a key; with enough
independent walks a match shares a key with the recall that is asked for, whatever its length. Every
candidate then is verified by an exact alignment.

Windows have the size of their item. A match with at most d edits in n words leaves one of
d + 1 pieces intact, so only windows around an intact piece of that length are embedded: that loses nothing.
Items of fewer than LEAST_WORDS words allow no edit: each is its own piece, and is found by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, LongType

from tidemark.llm.common import python_on_executors, table, utf8
from tidemark.llm.shingles import MULT, hashes_of, mix

#: Edits for each word of the item.
EDITS = 0.2
#: Items with fewer words match without edits only.
LEAST_WORDS = 5
#: Symbols of an embedding that make a key; and from the kind with 32 edits (160 words) on, as the walks of longer strings fall out of step more often.
SAMPLED, LONG_SAMPLED, LONG_KIND = 2, 1, 20
#: Symbols are sampled from so many steps for each word. Walks leave a string after two steps a word: behind that all strings look alike.
SPAN = 1.2
RECALL = 0.99
#: Items and bytes of items that a worker holds at once; more items are searched in further blocks.
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 4 << 20
#: Words of windows, and of segments to align, that are held together.
CELLS = 1 << 19
#: Texts that are searched for one block before the next block is loaded.
TEXT_BYTES = 32 << 20
#: UTF-8 of characters of scripts that are written without spaces: Thai, Lao, Myanmar, Khmer, kana, bopomofo, and Han with its extensions.
SPACELESS = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80\x81\x9e\x9f][\x80-\xbf]|\xe1\x82[\x80-\x9f]|\xe3(?:\x80[\x85-\x87]|[\x81-\x83\x86][\x80-\xbf]|\x84[\x80-\xaf]|\x87[\xb0-\xbf]|[\x90-\xbf][\x80-\xbf])|[\xe4-\xe9][\x80-\xbf][\x80-\xbf]|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf][\x80-\xbf]")
#: Bits of the filter that most words fail.
FILTER_BITS = 22


def units(bodies: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of texts; each character of a script without spaces is a word."""
    return hashes_of([b if b.isascii() else SPACELESS.sub(rb" \g<0> ", b) for b in bodies])


def allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def piece_of(n: int) -> int:
    """Words of the pieces by which an item of n words is found: one of them is intact in every match."""
    return n if n < LEAST_WORDS else min(3, n // (allowed(n) + 1))


def kind_of(n: np.ndarray) -> np.ndarray:
    """Strings of a kind have as many walks: those of one number of edits, and beyond 4 edits within a quarter of an octave."""
    d = (EDITS * n + 1e-9).astype(np.int64)
    return np.where(d <= 4, d, (4 * np.log2(np.maximum(d, 1))).astype(np.int64))


def walk(x: np.ndarray, n: np.ndarray, walks: int, seed: int) -> np.ndarray:
    """Keys of strings of one kind (rows of x, of n words of the item, padded with at least one 0 behind) for each walk: (walks, rows).

    A string's keys don't depend on the other rows: places and steps come from the walk alone. Only the sampled symbols are kept.
    """
    rows, flat = np.arange(len(x)), walks * len(x)
    at_share = np.stack([np.random.default_rng((seed, r)).random(SAMPLED) for r in range(walks)])
    symbols = LONG_SAMPLED if len(n) and kind_of(n)[0] >= LONG_KIND else SAMPLED
    place = (at_share.T[:symbols, :, None] * (SPAN * n)[None, None, :]).astype(np.int64).reshape(-1)
    order = np.argsort(place, kind="stable")
    turns = np.searchsorted(place[order], np.arange(int(place.max(initial=-1)) + 2))
    out = np.zeros(len(place), np.uint64)
    i = np.zeros((walks, len(x)), np.int64)
    salt = mix(np.arange(walks, dtype=np.uint64) * MULT + np.uint64(seed))
    for k in range(len(turns) - 1):
        odd = mix(salt + np.uint64(k)) | np.uint64(1)
        word = x[rows[None, :], i]
        now = order[turns[k] : turns[k + 1]]
        out[now] = word.reshape(-1)[now % flat]
        i += ((word * odd[:, None]) >> np.uint64(63)).astype(np.int64)  # 0, behind the end, stays
    key = np.broadcast_to(n.astype(np.uint64), (walks, len(x)))
    for s in range(symbols):
        key = mix(key * MULT + out[s * flat : (s + 1) * flat].reshape(walks, len(x)))
    return mix(key + np.arange(walks, dtype=np.uint64)[:, None])


def padded(strings: list[np.ndarray], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows with at least one 0 behind each, and their lengths."""
    n = np.array([len(s) for s in strings], np.int64)
    x = np.zeros((len(strings), max(least, int(n.max(initial=0))) + 1), np.uint64)
    for row, s in zip(x, strings):
        row[: len(s)] = s
    return x, n


def align(item: np.ndarray, n: np.ndarray, seg: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least edits between each item (row, n words) and any part of its segment (row, m words)."""
    width = seg.shape[1]
    j = np.arange(width + 1)
    d = np.zeros((len(item), width + 1), np.int32)
    best = np.where(n == 0, 0, 1 << 30)
    for i in range(int(n.max(initial=0))):
        new = d + 1
        np.minimum(new[:, 1:], d[:, :-1] + (seg != item[:, i : i + 1]), out=new[:, 1:])
        d = np.minimum.accumulate(new - j, axis=1) + j
        done = n == i + 1
        if done.any():
            ends = np.where(j[None, :] <= m[done, None], d[done], 1 << 30)
            best[done] = ends.min(axis=1)
    return best


class Kind:
    """Items of like length: their keys under as many walks as the recall needs."""

    def __init__(self, items: np.ndarray, strings: list[np.ndarray], recall: float):
        items = items[np.argsort([len(strings[i]) for i in items], kind="stable")]
        self.walks = walks_for([strings[i] for i in items], recall)
        keys = []
        for part in batches_of(np.array([len(strings[i]) for i in items])):
            x, n = padded([strings[i] for i in items[part]])
            keys.append(walk(x, n, self.walks, 7))
        keys = np.concatenate(keys, axis=1)
        order = np.argsort(keys, axis=1, kind="stable")
        self.items, self.keys = items[order].astype(np.int32), np.take_along_axis(keys, order, axis=1)


def batches_of(words: np.ndarray, most: int = 256):
    """Slices of strings in order of length, so that one padded batch has at most CELLS words, or one string."""
    at = 0
    while at < len(words):
        end = at + 1
        while end < len(words) and end - at < most and (end + 1 - at) * int(words[end] + 1) <= CELLS:
            end += 1
        yield slice(at, end)
        at = end


class Items:
    """A block of items of at least ``shortest`` words: their pieces, and their keys."""

    def __init__(self, rows: list[tuple[int | None, bytes]], recall: float = RECALL, shortest: int = LEAST_WORDS):
        held = [(k, w) for (k, _), w in zip(rows, units([t for _, t in rows])) if len(w) >= max(1, shortest)]
        self.ids = [k for k, _ in held]
        self.strings = [w for _, w in held]
        self.n = np.array([len(w) for w in self.strings], np.int64)
        pieces: dict[int, list[int]] = {}
        for j, n in enumerate(self.n.tolist()):
            pieces.setdefault(piece_of(n), []).append(j)
        self.tables = {size: self._table(size, members) for size, members in sorted(pieces.items())}
        kinds, long = kind_of(self.n), self.n >= LEAST_WORDS
        self.kinds = {int(k): Kind(np.flatnonzero(long & (kinds == k)), self.strings, recall) for k in np.unique(kinds[long])}

    def _table(self, size: int, members: list[int]):
        """(grams in order, their items, their places, filter) of the items that are found by pieces of this size."""
        grams = [grams_of(self.strings[j], size) for j in members]
        gram = np.concatenate(grams)
        item = np.repeat(np.array(members, np.int64), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(gram, kind="stable")
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return gram[order], item[order], at[order], np.packbits(bits)

    def hits(self, w: np.ndarray):
        """Parts of (items, starts) of windows around intact pieces of a text; a start may lie before it. No part has many more than CELLS."""
        for size, (gram, item, at, bits) in self.tables.items():
            g = grams_of(w, size)
            slot = g >> np.uint64(64 - FILTER_BITS)
            near = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1)
            lo, hi = np.searchsorted(gram, g[near], "left"), np.searchsorted(gram, g[near], "right")
            near, lo, count = near[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(near):
                continue
            part = np.cumsum(count) // CELLS
            for p in np.unique(part):
                mine = part == p
                c = count[mine]
                place = np.repeat(near[mine], c)
                k = np.repeat(lo[mine], c) + np.arange(len(place)) - np.repeat(np.cumsum(c) - c, c)
                yield item[k], place - at[k]

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item's index, edits, first word) of verified matches, the best of each text and item; the word is where the first window of that match begins."""
        best: dict = {}
        waiting: list[np.ndarray] = []
        size = 0

        def close() -> None:
            for t, item, edits, at in self._verified(texts, np.unique(np.concatenate(waiting), axis=0)):
                best[t, item] = min(best.get((t, item), (edits, at)), (edits, at))
            waiting.clear()

        for t, w in enumerate(texts):
            for item, start in self.hits(w):
                n = self.n[item]
                for j, at in zip(*(x.tolist() for x in firsts(item[n < LEAST_WORDS], start[n < LEAST_WORDS]))):
                    best[t, j] = min(best.get((t, j), (0, at)), (0, at))
                item, start, n = item[n >= LEAST_WORDS], start[n >= LEAST_WORDS], n[n >= LEAST_WORDS]
                if len(item):
                    waiting.append(np.unique(np.stack([kind_of(n), n, np.full(len(n), t), start], axis=1), axis=0))
                    size += len(waiting[-1])
                    if size >= CELLS // 16:
                        close()
                        size = 0
        if waiting:
            close()
        return [(t, item, *v) for (t, item), v in sorted(best.items())]

    def _verified(self, texts, windows: np.ndarray) -> list:
        """windows: rows (kind, words, text, start) in order."""
        pairs = []
        for k in np.unique(windows[:, 0]):
            kind = self.kinds[int(k)]
            mine = windows[windows[:, 0] == k]
            for part in batches_of(mine[:, 1]):
                _, n, owner, start = mine[part].T
                x, _ = padded([texts[t][max(0, s) : max(0, s + m)] for t, s, m in zip(owner, start, n)], int(n.max()))
                keys = walk(x, n, kind.walks, 7)
                found = []
                for r in range(kind.walks):
                    lo, hi = np.searchsorted(kind.keys[r], keys[r], "left"), np.searchsorted(kind.keys[r], keys[r], "right")
                    c = hi - lo
                    if c.any():
                        at = np.repeat(lo, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                        found.append(np.stack([owner.repeat(c), kind.items[r][at], start.repeat(c)], axis=1))
                if found:
                    pairs.append(np.unique(np.concatenate(found), axis=0))
        if not pairs:
            return []
        # candidates of one text and item whose segments overlap are aligned at once
        t, j, start = np.unique(np.concatenate(pairs), axis=0).T
        d = (EDITS * self.n[j] + 1e-9).astype(np.int64)
        lo, hi = np.maximum(0, start - d), start + self.n[j] + d
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (j[1:] != j[:-1]) | (lo[1:] > hi[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t)) - 1
        t, j, d, lo, hi, start = t[first], j[first], d[first], lo[first], hi[last], np.maximum(0, start[first])
        order = np.argsort(hi - lo, kind="stable")
        out = []
        for part in batches_of((hi - lo)[order]):
            at = order[part]
            item, n = padded([self.strings[k] for k in j[at]])
            seg, m = padded([texts[a][b:c] for a, b, c in zip(t[at], lo[at], hi[at])])
            edits = align(item, n, seg, m)
            out += [(int(t[a]), int(j[a]), int(e), int(start[a])) for a, e in zip(at, edits) if e <= d[a]]
        return out


def firsts(item: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item once, with its first place."""
    order = np.lexsort((at, item))
    turn = np.flatnonzero(np.diff(item[order], prepend=-1))
    return item[order][turn], at[order][turn]


def grams_of(w: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        h = h * MULT + w[j : j + len(h)]
        h ^= h >> np.uint64(31)
    return mix(h)


def simulated(strings: list[np.ndarray], rows: int, piece: int, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, window) pairs as rows, and where each trial's rows begin: items of one length with the largest allowed number of random edits, in a text of other words, and the windows (up to ``most``) around their intact pieces."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64).tolist()
    one, two, turns = [], [], []
    for r in range(rows):
        item, w = strings[r % len(strings)], strings[r % len(strings)].tolist()
        n = len(item)
        for _ in range(allowed(n)):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind != 1)] = fresh(1) if kind != 2 else []
        text = np.array([*fresh(n), *w, *fresh(n)], np.uint64)
        own, other = grams_of(item, piece), grams_of(text, piece)
        order = np.argsort(own, kind="stable")
        lo = np.searchsorted(own[order], other)
        place = np.flatnonzero(own[order][np.minimum(lo, len(own) - 1)] == other)
        starts = np.unique(place - order[lo[place]])
        starts = rng.permutation(starts[(starts >= 0) & (starts + n <= len(text))])[:most]
        turns.append(len(one))
        one += [item] * max(1, len(starts))
        two += [text[s : s + n] for s in starts] or [text[:n]]
    return padded(one)[0], padded(two)[0], np.array(turns)


def walks_for(strings: list[np.ndarray], recall: float) -> int:
    """How many of the walks find items of any of these lengths with this recall, at the largest allowed distance.

    Measured by simulated edits at the shortest length, the longest and two between; these may miss half as many, and half as many walks again are taken.
    """
    by: dict[int, list] = {}
    for s in strings:
        by.setdefault(len(s), []).append(s)
    lengths = sorted(by)
    trials = [(n, simulated(by[n], int(np.clip(25_000 // n, 8, 250)), piece_of(n), 16 if n < 500 else 4)) for n in sorted({lengths[round(k * (len(lengths) - 1) / 3)] for k in range(4)})]
    walks = 16
    while True:
        shares = []
        for n, (x, y, turns) in trials:
            same = [walk(x[p], np.full(len(x[p]), n), walks, 7) == walk(y[p], np.full(len(x[p]), n), walks, 7) for p in batches_of(np.full(len(x), n))]
            of_trial = np.logical_or.reduceat(np.concatenate(same, axis=1), turns, axis=1)
            shares.append(np.logical_or.accumulate(of_trial, axis=0).mean(axis=1))
        enough = np.flatnonzero(np.min(shares, axis=0) >= (1 + recall) / 2)
        if len(enough):
            return (int(enough[0]) + 1) * 3 // 2
        walks *= 2


def id_type(items: DataFrame, item: str) -> DataType:
    """Whole numbers are given as long, other ids as they are."""
    kind = items.select(F.col(f"`{item}`")).schema[0].dataType
    return LongType() if isinstance(kind, IntegralType) else kind


def item_blocks(items: DataFrame, item: str, item_text: str, shortest: int):
    """The items, in blocks of about BLOCK_ITEMS and BLOCK_BYTES, each ready to be searched for. Those that repeat an id share a block; those without one are dealt by text."""
    rows = items.select(F.col(f"`{item}`").cast(id_type(items, item)).alias("i"), utf8(F.col(f"`{item_text}`")).alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    for b in range(blocks):
        dealt = F.pmod(F.when(F.col("i").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("i")), F.lit(blocks))
        held = [(r["i"], bytes(r["t"])) for r in rows.filter(dealt == b).toLocalIterator()]
        yield Items(sorted(held, key=lambda r: (False, r[1]) if r[0] is None else (True, *r)), shortest=shortest)


def searched(batches, blocks, at: int):
    """(batches, matches): Arrow batches of about TEXT_BYTES of texts (column ``at``), and for each text the matches (block, item, edits, first word).

    A worker that has several blocks to search loads one after the other, so each text is read and cut into words once.
    """

    def close(group):
        texts = units([x.encode() if isinstance(x, str) else x or b"" for b in group for x in b.column(at).to_pylist()])
        found: list[list] = [[] for _ in texts]
        for block in blocks:
            it = block.value
            for t, j, e, first in it.matches(texts):
                found[t].append((it, j, e, first))
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # it is loaded again from the worker's disk
        return found

    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= TEXT_BYTES or len(blocks) == 1:
            yield group, close(group)
            group, size = [], 0
    if group:
        yield group, close(group)


def without_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", shortest: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; see ``contaminated``. Rows without text stay. Nothing is shuffled."""
    spark = docs.sparkSession
    python_on_executors(spark)
    at = docs.columns.index(text)
    held = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item, item_text, shortest)]

    def run(batches):
        for group, found in searched(batches, blocks, at):
            for batch in group:
                clean, found = [not f for f in found[: batch.num_rows]], found[batch.num_rows :]
                yield batch if all(clean) else batch.filter(pa.array(clean, pa.bool_()))

    return held.mapInArrow(run, held.schema).toDF(*docs.columns)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shortest: int = LEAST_WORDS) -> DataFrame:
    """(key, item_id, edits, item_words, similarity, first_word): documents that hold a benchmark item with at most EDITS of its words edited.

    Words as everywhere here: A-Z in lower case, separated by white space; besides, each
    character of a script without spaces is one. One row for each
    row of documents and item, the match of least edits (then the first). Null or empty texts and
    items of fewer than ``shortest`` words match nothing; items below LEAST_WORDS match word for word. Items that repeat an id count
    as one; items with a null id count each for itself. Rows that repeat a key are documents of their own; a key of any type, null too, is
    carried along. Other columns are left out. Nothing is shuffled: items are searched in blocks that each worker loads in turn.
    """
    spark = docs.sparkSession
    python_on_executors(spark)
    schema = docs.select(F.col(f"`{key}`").alias("key")).schema
    of_item = id_type(items, item)
    for name, kind in (("item_id", of_item), ("edits", "integer"), ("item_words", "integer"), ("similarity", "double"), ("first_word", "long")):
        schema = schema.add(name, kind)
    kinds = (to_arrow_type(of_item), pa.int32(), pa.int32(), pa.float64(), pa.int64())
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item, item_text, shortest)]

    def run(batches):
        for group, found in searched(batches, blocks, 1):
            for batch in group:
                rows, places = [], []
                for place, matches in enumerate(found[: batch.num_rows]):
                    got: dict = {}
                    for it, j, e, at in matches:
                        k = (it.ids[j], id(it) if it.ids[j] is None else 0, j if it.ids[j] is None else -1)
                        got[k] = min(got.get(k, (1 << 30,)), (e, at, int(it.n[j])))
                    rows += [(i, e, n, round(1 - e / n, 6), at) for (i, _, _), (e, at, n) in got.items()]
                    places += [place] * len(got)
                found = found[batch.num_rows :]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], schema.names)

    texts = docs.select(F.col(f"`{key}`").alias("key"), utf8(F.col(f"`{text}`")).alias("body"))
    return texts.mapInArrow(run, schema).withColumnRenamed("key", key)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of any length in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
