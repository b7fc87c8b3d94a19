"""A gated recurrent language model that scores whole documents.

Words are grouped in UNITS units: the end of a text, the most frequent words (one a
unit), and the rest by their last two bytes. A GRU over units, in numpy, predicts the
next one through an output that is factored into classes of members: P(class) times
P(member given class). Within a unit a word has its smoothed share of the unit's
training tokens, so that every text has a probability. Training is truncated
back-propagation over windows; states run on through the windows of a document, in
training and in scoring, and begin anew with each document. In training a very long
document counts as several, so that the lanes of a batch end together.

Documents are dealt to chunks of about CHUNK_BYTES by a hash of key and text, in the order of their keys, so that a chunk
does not depend on how the input is laid out. Counts cover every training document. They are found by exchange: each chunk sends
the hashes of its distinct words to the parts that count them, and gets back their
totals, so that no vocabulary is ever held in one place. One replica of the network trains
on each chunk. Every training document is used in one of a few rounds, which each take a share of
the documents of every chunk; after a round the replicas are averaged, and the next begins from their mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from tidemark.llm.common import checkpointed, for_join, python_on_executors, table, utf8, written
from tidemark.llm.repeats import part_of
from tidemark.llm.shingles import mix, words_of

HIDDEN = 24
CLASSES = MEMBERS = 24
UNITS = CLASSES * MEMBERS
#: Units of single words, and of word endings; the others are the end (0) and the rest (the last).
HEAD = ENDINGS = (UNITS - 2) // 2
WINDOW = 32
SMOOTH = 0.1
CHUNK_BYTES = 8 << 20
#: Bytes of texts for each part of an exchange, at most; more text makes more parts.
PART_BYTES = 32 << 20
#: Rounds of training: a round's share of the documents of each chunk in sixteenths, and its rate.
ROUNDS = ((2, 1.5e-2), (3, 1.2e-2), (4, 1e-2), (7, 6e-3))
#: Documents that are trained on side by side: as many lanes as give LANE_WINDOWS windows, at most.
LANES, LANE_WINDOWS = 256, 8
#: In training (not in scoring) the state begins anew after so many tokens of a document.
PIECE = 32 * WINDOW
ENTRY = np.dtype([("word", "<u8"), ("count", "<u4"), ("ending", "<u2")])


# --- network -------------------------------------------------------------


def initial() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    s = lambda *shape, k: rng.normal(0, k, shape).astype(np.float32)
    return {"x": s(UNITS, 3 * HIDDEN, k=0.1), "u": s(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), "wc": s(HIDDEN, CLASSES, k=0.1), "bc": np.zeros(CLASSES, np.float32), "wm": s(CLASSES, HIDDEN, MEMBERS, k=0.1), "bm": np.zeros((CLASSES, MEMBERS), np.float32)}


def sigmoid(a: np.ndarray) -> np.ndarray:
    np.negative(a, out=a)
    np.exp(np.minimum(a, 30, out=a), out=a)
    a += 1
    return np.reciprocal(a, out=a)


ONES = {n: np.ones((n, 1), np.float32) for n in (CLASSES, MEMBERS)}


def softmax(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(a) and its sums over rows, by a product: reductions over short rows are slow. Logits are small; beyond 60 they are cut."""
    e = np.exp(np.minimum(a, 60, out=a))
    return e, e @ ONES[a.shape[1]]


def states(p: dict, units: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
    """Run a window (steps, lanes): states before each prediction, the last state, and what back-propagation needs.

    units are the inputs (the token before the predicted one); where first is set, a document begins and the state is zero.
    Within, lanes run along the last axis, so that every step works on whole rows.
    """
    steps, lanes = units.shape
    n_ = HIDDEN
    xs = np.ascontiguousarray(p["x"][units].transpose(0, 2, 1))
    u = np.ascontiguousarray(p["u"].T)
    out = np.empty((steps, n_, lanes), np.float32)
    held = [] if keep else None
    begins = first.any(axis=1)
    h = np.ascontiguousarray(h.T, np.float32)
    for t in range(steps):
        if begins[t]:
            h = h * ~first[t]
        a, x = u @ h, xs[t]
        gates = sigmoid(x[: 2 * n_] + a[: 2 * n_])
        z, r = gates[:n_], gates[n_:]
        n = r * a[2 * n_ :]
        n += x[2 * n_ :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if keep:
            held.append((h, a[2 * n_ :], z, r, n))
        out[t] = h = new
    return np.ascontiguousarray(out.transpose(0, 2, 1)), h.T, held


def predict(p: dict, hs: np.ndarray, target: np.ndarray, grad: bool):
    """Natural log probabilities of target units for states (rows), and the gradients of their negative sum."""
    cls, member = target // MEMBERS, target % MEMBERS
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    rows = np.arange(len(hs))
    logit = hs @ p["wc"] + p["bc"]
    e, total = softmax(logit)
    score = logit[rows, cls] - np.log(total[:, 0])
    g = None
    if grad:
        e /= total
        e[rows, cls] -= 1
        g = {"wc": hs.T @ e, "bc": (np.ones((1, len(e)), np.float32) @ e)[0], "wm": np.zeros_like(p["wm"]), "bm": np.zeros_like(p["bm"])}
        dh = e @ p["wc"].T
    for c in range(CLASSES):
        idx = order[ends[c] : ends[c + 1]]
        if not len(idx):
            continue
        own, place, m = hs[idx], np.arange(len(idx)), member[idx]
        logit = own @ p["wm"][c] + p["bm"][c]
        e, total = softmax(logit)
        score[idx] += logit[place, m] - np.log(total[:, 0])
        if grad:
            e /= total
            e[place, m] -= 1
            g["wm"][c], g["bm"][c] = own.T @ e, (np.ones((1, len(e)), np.float32) @ e)[0]
            dh[idx] += e @ p["wm"][c].T
    return (score, g, dh) if grad else (score, None, None)


def gradients(p: dict, inputs: np.ndarray, target: np.ndarray, first: np.ndarray, used: np.ndarray, h: np.ndarray):
    """Mean gradients over the used tokens of a window, the last state, and the summed log probability."""
    steps, lanes = inputs.shape
    n_ = HIDDEN
    hs, last, held = states(p, inputs, first, h, True)
    flat = used.reshape(-1)
    score, g, dflat = predict(p, hs.reshape(-1, n_)[flat], target.reshape(-1)[flat], True)
    dh_out = np.zeros((steps * lanes, n_), np.float32)
    dh_out[flat] = dflat
    dh_out = np.ascontiguousarray(dh_out.reshape(steps, lanes, n_).transpose(0, 2, 1))
    da = np.empty((steps, 3 * n_, lanes), np.float32)
    dx = np.empty_like(da)
    begins = first.any(axis=1)
    dh, one = np.zeros((n_, lanes), np.float32), np.float32(1)
    for t in range(steps - 1, -1, -1):
        hp, an, z, r, n = held[t]
        dh += dh_out[t]
        dz, dr, dn = dx[t, :n_], dx[t, n_ : 2 * n_], dx[t, 2 * n_ :]
        rest = one - z
        np.multiply(dh, rest, out=dn)
        np.subtract(hp, n, out=dz)
        dz *= dn
        dz *= z
        dn *= one - n * n
        np.multiply(dn, an, out=dr)
        dr *= r
        dr *= one - r
        da[t, : 2 * n_] = dx[t, : 2 * n_]
        np.multiply(dn, r, out=da[t, 2 * n_ :])
        dh *= z
        dh += p["u"] @ da[t]
        if begins[t]:
            dh *= ~first[t]
    before = np.stack([x[0] for x in held])
    g["u"] = np.matmul(before, da.transpose(0, 2, 1)).sum(axis=0)
    g["x"] = np.zeros_like(p["x"])
    ids = inputs.reshape(-1)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    s = ids[order]
    turn = np.flatnonzero(np.diff(s, prepend=-1))
    g["x"][s[turn]] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * n_)[order], turn, axis=0)
    n = max(1, int(flat.sum()))
    return {k: v / n for k, v in g.items()}, last, float(score.sum(dtype=np.float64))


class Adam:
    def __init__(self, p: dict):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        rate = rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in g.items():
            x = x * np.float32(clip)
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.01) * (x * x - self.v[k])
            p[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))


class Lanes:
    """Documents laid end to end in lanes, longest first to the shortest lane; lanes in order of length.

    With ``piece``, documents are cut into pieces of so many tokens, which begin with no state, so that lanes end together.
    """

    def __init__(self, units: np.ndarray, sizes: np.ndarray, lanes: int, piece: int | None = None):
        begins = np.cumsum(sizes) - sizes
        whole = begins[sizes > 0]
        if piece:
            count = -(-sizes // piece)
            rest = sizes - (count - 1) * piece
            sizes = np.full(int(count.sum()), piece, np.int64)
            sizes[np.cumsum(count)[count > 0] - 1] = rest[count > 0]
        order = np.argsort(-sizes, kind="stable")
        k = max(1, min(lanes, len(sizes)))
        held: list[list[int]] = [[] for _ in range(k)]
        load = np.zeros(k, np.int64)
        for at in range(0, len(order), k):  # a round deals one document to each lane, long ones to short lanes
            batch = order[at : at + k]
            to = np.argsort(load, kind="stable")[: len(batch)]
            for lane, d in zip(to, batch):
                held[lane].append(int(d))
                load[lane] += sizes[d]
        by = np.argsort(-load, kind="stable")
        self.docs = [held[i] for i in by]
        self.load = load[by]
        self.length = int(self.load.max(initial=0))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.places = [np.concatenate([np.arange(starts[d], starts[d] + sizes[d]) for d in ds]) if ds else np.zeros(0, np.int64) for ds in self.docs]
        self.first = np.zeros(len(units), bool)
        self.first[starts[sizes > 0]] = True
        self.units = units
        self.inputs = np.concatenate([[0], units[:-1]]).astype(np.int64)
        self.inputs[whole] = 0

    def windows(self):
        """(places, used, active lanes) of each window: (steps, lanes) places in units."""
        for at in range(0, self.length, WINDOW):
            active = int((self.load > at).sum())
            steps = min(WINDOW, self.length - at)
            place, used = np.zeros((steps, active), np.int64), np.zeros((steps, active), bool)
            for j in range(active):
                part = self.places[j][at : at + steps]
                place[: len(part), j], used[: len(part), j] = part, True
            yield place, used, active


def train(p: dict, opt: Adam, units: np.ndarray, sizes: np.ndarray, rate: float) -> float:
    lanes = Lanes(units, sizes, int(np.clip(len(units) // (WINDOW * LANE_WINDOWS), 8, LANES)), PIECE)
    h, total = np.zeros((len(lanes.docs), HIDDEN), np.float32), 0.0
    for place, used, active in lanes.windows():
        g, h, s = gradients(p, lanes.inputs[place], lanes.units[place], lanes.first[place] & used, used, h[:active])
        opt.step(p, g, rate)
        total += s
    return total


def score(p: dict, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each token's unit."""
    lanes = Lanes(units, sizes, 384)
    out, h = np.zeros(len(units)), np.zeros((len(lanes.docs), HIDDEN), np.float32)
    for place, used, active in lanes.windows():
        hs, h, _ = states(p, lanes.inputs[place], lanes.first[place] & used, h[:active], False)
        flat = used.reshape(-1)
        at = place.reshape(-1)[flat]
        out[at] = predict(p, hs.reshape(-1, HIDDEN)[flat], lanes.units[at], False)[0]
    return out / np.log(10)


# --- chunks and counts ---------------------------------------------------


MESSAGE = "chunk long, part int, body binary, kind int, k long, a long, b long"
REPLY, TOTAL, ENDING, WORD = 0, 1, 2, 3


def compressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def expanded(raw: bytes, kind, n: int) -> np.ndarray:
    """The inverse of ``compressed``, which lays the bytes of like weight together."""
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw, max_output_size=n * size), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def dealt(docs: DataFrame, key: str, text: str, held: Column) -> tuple[DataFrame, int]:
    """(chunk, id, held, body) of all rows, and how many parts their texts fill. Rows of one key and text that fill a chunk by themselves are spread over all chunks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("id"), held.alias("held"), utf8(F.col(f"`{text}`")).alias("body")).withColumn("print", F.xxhash64("body"))
    same = checkpointed(rows.groupBy("id", "print").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")))
    total = same.agg(F.sum("bytes")).first()[0] or 0
    count = max(1, -(-total // CHUNK_BYTES))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    chunk = F.pmod(F.xxhash64("id", "print"), F.lit(count))
    hot = same.filter((F.col("n") > 1) & (F.col("bytes") > CHUNK_BYTES)).select(F.col("id").alias("hot_id"), F.col("print").alias("hot_print"))
    if (n := hot.count()) > 0:
        rows = rows.join(for_join(hot, n), F.col("id").eqNullSafe(F.col("hot_id")) & (F.col("print") == F.col("hot_print")), "left")
        chunk = F.when(F.col("hot_print").isNull(), chunk).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    return rows.withColumn("chunk", chunk).repartitionById(parts, F.pmod("chunk", F.lit(parts)).cast("int")).sortWithinPartitions("chunk", "id", "print").select("chunk", "id", "held", "body"), parts


def chunks(docs: DataFrame, key: str, text: str, held: Column) -> tuple[DataFrame, int]:
    """Chunks of documents, their tokens as numbers in a list of the chunk's distinct words (hash, count in training documents, ending); and the number of parts for exchanges."""
    python_on_executors(docs.sparkSession)
    rows, parts = dealt(docs, key, text, held)
    schema = StructType().add("chunk", "long").add("ids", ArrayType(rows.schema["id"].dataType)).add("held", ArrayType(BooleanType())).add("sizes", ArrayType(IntegerType())).add("tokens", "binary").add("words", "binary")
    kinds = (pa.int64(), pa.list_(to_arrow_type(rows.schema["id"].dataType)), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())

    def close(chunk, ids, held_, found):
        sizes = np.array([len(h) for h, _ in found], np.int32)
        every = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]])
        tails = np.concatenate([np.zeros(0, np.uint16), *[t for _, t in found]])
        # words in the order of their hashes: parts get slices
        distinct, first, tokens = np.unique(every, return_index=True, return_inverse=True)
        words = np.zeros(len(distinct), ENTRY)
        words["word"], words["ending"] = distinct, tails[first]
        teach = np.repeat(~np.array(held_, bool), sizes)
        words["count"] = np.bincount(tokens[teach], minlength=len(distinct))
        row = (chunk, ids, held_, sizes.tolist(), compressed(tokens.astype(np.int32)), words.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], schema.names)

    def run(batches):
        now, ids, held_, found, size, more = None, [], [], [], 0, 0
        for b in batches:
            of = b.column(0).to_numpy()
            turns = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(turns[:-1], turns[1:]):
                if lo == hi:
                    continue
                # a chunk that rows of one key have filled several times over goes on as another
                if ids and (of[lo] != now or size > 4 * CHUNK_BYTES):
                    yield close(now if not more else -1 - (now << 20 | more), ids, held_, found)
                    more = more + 1 if of[lo] == now else 0
                    ids, held_, found, size = [], [], [], 0
                now = int(of[lo])
                part = b.slice(lo, hi - lo)
                bodies = part.column(3).to_pylist()
                ids += part.column(1).to_pylist()
                held_ += [bool(x) for x in part.column(2).to_pylist()]
                found += words_of(bodies)
                size += sum(map(len, bodies))
        if ids:
            yield close(now if not more else -1 - (now << 20 | more), ids, held_, found)

    return written(rows.mapInArrow(run, schema), "tokens"), parts


def _rows(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def slices(words: np.ndarray, parts: int):
    part = part_of(words, parts)
    turn = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(turn, np.append(turn[1:], len(part)))]


def counts(table_: DataFrame, parts: int) -> DataFrame:
    """Totals of every word to the chunks that have it (REPLY), and for the driver: distinct words and tokens, of each ending too, and the most frequent words."""

    def send(batches):
        for chunk, raw in _rows(batches):
            words = np.frombuffer(raw, ENTRY)
            rows = [(chunk, part, words[s].tobytes()) for part, s in slices(words["word"], parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["chunk", "part", "body"])

    def add(batches):
        rows = list(_rows(batches))
        if not rows:
            return
        got = [np.frombuffer(r[2], ENTRY) for r in rows]
        e = np.concatenate(got)
        order = np.argsort(e["word"], kind="stable")
        w = e["word"][order]
        turn = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        total = np.add.reduceat(e["count"][order].astype(np.int64), turn)
        each = np.empty(len(e), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(turn, len(w))))
        ends = np.cumsum([len(g) for g in got])
        out = [(r[0], r[1], compressed(each[n - len(g) : n].astype(np.uint32)), REPLY, 0, 0, 0) for r, g, n in zip(rows, got, ends)]
        ending, known = e["ending"][order][turn], total > 0
        a, b = np.bincount(ending, weights=total, minlength=1 << 16), np.bincount(ending, weights=known, minlength=1 << 16)
        out.append((0, 0, b"", TOTAL, 0, int(total.sum()), int(known.sum())))
        out += [(0, 0, b"", ENDING, int(k), int(a[k]), int(b[k])) for k in np.flatnonzero(a)]
        top = np.lexsort((w[turn], -total))[:HEAD]
        out += [(0, 0, b"", WORD, int(np.int64(w[turn[i]])), int(total[i]), int(ending[i])) for i in top if total[i]]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for k in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 2000]), kinds)], ["chunk", "part", "body", "kind", "k", "a", "b"])

    sent = table_.select("chunk", "words").mapInArrow(send, "chunk long, part int, body binary")
    return written(sent.repartition(parts, "part").mapInArrow(add, MESSAGE), "counts")


class Units:
    """Which unit each word has, and the shares within units. Its size does not hang on the corpus."""

    def __init__(self, head: list[tuple[int, int, int]], endings: list[tuple[int, int, int]], tokens: int, distinct: int, ends: int):
        self.N, self.V, self.ends = tokens + ends, distinct + (ends > 0), ends
        left = {k: [a, b] for k, a, b in endings}
        for _, a, e in head:
            left[e][0] -= a
            left[e][1] -= 1
        top = sorted((k for k in left if left[k][0] > 0), key=lambda k: (-left[k][0], k))[:ENDINGS]
        count = np.zeros(UNITS, np.int64)
        known = np.zeros(UNITS, np.int64)
        self.ending = np.full(1 << 16, UNITS - 1, np.int64)
        count[0] = ends
        for i, (_, a, _) in enumerate(head):
            count[1 + i] = a
        for i, k in enumerate(top):
            self.ending[k] = 1 + HEAD + i
        for k, (a, b) in left.items():
            count[self.ending[k]] += a
            known[self.ending[k]] += b
        # classes of like frequency; unit 0 stays the end, which starts texts too
        order = [0, *[int(i) for i in np.argsort(-count[1:], kind="stable") + 1]]
        place = np.empty(UNITS, np.int64)
        place[order] = np.arange(UNITS)
        self.ending = place[self.ending]
        words = np.array([k for k, _, _ in head], np.int64).astype(np.uint64)
        by = np.argsort(words, kind="stable")
        self.head, self.head_unit = words[by], place[1 + np.arange(len(head))][by]
        self.count, self.known = count[order], known[order]

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of words, and whether each is a unit of its own."""
        unit = self.ending[words["ending"]]
        at = np.minimum(np.searchsorted(self.head, words["word"]), max(0, len(self.head) - 1))
        own = self.head[at] == words["word"] if len(self.head) else np.zeros(len(words), bool)
        unit[own] = self.head_unit[at[own]]
        return unit, own

    def share(self, unit: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its unit; all unseen words of a unit share one smoothing mass."""
        s = np.log10((c + SMOOTH) / (self.count[unit] + SMOOTH * (self.known[unit] + 1)))
        s[own] = 0.0
        return s

    def base(self, c):
        return np.log10((c + SMOOTH) / (self.N + SMOOTH * (self.V + 1)))


def sequence(tokens: np.ndarray, sizes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of documents with their ends, sizes with ends, and the places of the words in it."""
    full = sizes.astype(np.int64) + 1
    out = np.zeros(int(full.sum()), np.int64)
    word = np.ones(len(out), bool)
    word[np.cumsum(full) - 1] = False
    out[word] = unit[tokens]
    return out, full, np.flatnonzero(word)


def pack(p: dict) -> bytes:
    return np.concatenate([p[k].astype(np.float64).reshape(-1) for k in sorted(p)]).tobytes()


def unpack(raw: np.ndarray) -> dict:
    p, at = initial(), 0
    for k in sorted(p):
        n = p[k].size
        p[k] = raw[at : at + n].reshape(p[k].shape).astype(np.float32)
        at += n
    return p


def fit(table_: DataFrame, units: Units) -> dict:
    """Weights from all training documents, in rounds of one replica a chunk. Chunks are about as large, and their replicas count alike: a chunk that holds one endless text must not outweigh the others."""
    rows = table_.select("held", "sizes", "tokens", "words")
    shares = np.cumsum([share for share, _ in ROUNDS])

    def replicas(start: dict, k: int):
        def run(batches):
            total, n = None, 0
            for held, sizes, raw, words in _rows(batches):
                words, sizes = np.frombuffer(words, ENTRY), np.array(sizes, np.int64)
                round_of = np.searchsorted(shares, mix(np.arange(1, len(sizes) + 1, dtype=np.uint64)) % np.uint64(shares[-1]), side="right")
                keep = ~np.array(held, bool) & (round_of == k)
                if not keep.any():
                    continue
                tokens = expanded(raw, np.int32, int(sizes.sum()))
                seq, full, _ = sequence(tokens[np.repeat(keep, sizes)], sizes[keep], units.of(words)[0])
                p = {name: v.copy() for name, v in start.items()}
                train(p, Adam(p), seq, full, ROUNDS[k][1])
                total, n = np.frombuffer(pack(p)) + (0 if total is None else total), n + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["w", "n"])

        return run

    def added(batches):
        w, n = None, 0
        for raw, k in _rows(batches):
            w, n = np.frombuffer(raw) + (0 if w is None else w), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["w", "n"])

    p = initial()
    for b in range(CLASSES):  # outputs start from the frequencies of the units
        part = units.count[b * MEMBERS : (b + 1) * MEMBERS]
        p["bm"][b], p["bc"][b] = np.log(part + 1.0), np.log(part.sum() + 1.0)
    for k in range(len(ROUNDS)):
        sums = written(rows.mapInArrow(replicas(p, k), "w binary, n long"), "replicas")
        for width in (64, 8):
            if sums.count() > width:
                sums = written(sums.repartition(width).mapInArrow(added, "w binary, n long"), "replicas")
        got = sums.collect()
        if n := sum(r["n"] for r in got):
            p = unpack(sum(np.frombuffer(r["w"]) for r in got) / n)
    return p


def scored(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Rows for which ``held`` is true or null teach nothing. A null text is empty and
    is one token, its end. Without training documents every count is 0. Rows that
    repeat a key are documents of their own; a key may have any type that can be ordered; other columns are left out. Words are
    told apart by 64-bit hashes. Scores do not depend on the layout of the input, but for rounding and for rows that repeat key and text more often
    than a chunk holds.
    """
    spark = docs.sparkSession
    table_, parts = chunks(docs, key, text, F.coalesce(held, F.lit(True)))
    found = counts(table_, parts)
    sums = found.filter(F.col("kind") == TOTAL).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    ends = table_.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    endings = [(r["k"], r["a"], r["b"]) for r in found.filter(F.col("kind") == ENDING).groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("k").collect()]
    head = [(r["k"], r["a"], r["b"]) for r in found.filter(F.col("kind") == WORD).orderBy(F.desc("a"), "k").limit(HEAD).collect()]
    units = Units(head, endings, sums["a"] or 0, sums["b"] or 0, ends)
    model = spark.sparkContext.broadcast((fit(table_, units), units))
    replies = found.filter(F.col("kind") == REPLY).groupBy("chunk").agg(F.collect_list(F.struct("part", "body")).alias("replies")).withColumnRenamed("chunk", "to")
    of_key = table_.schema["ids"].dataType.elementType
    schema = StructType().add("key", of_key)
    for name, kind in (("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    kinds = (to_arrow_type(of_key), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches):
        p, u = model.value
        for ids, held_, sizes, raw, words, replies_ in _rows(batches):
            words, sizes = np.frombuffer(words, ENTRY), np.array(sizes, np.int64)
            tokens = expanded(raw, np.int32, int(sizes.sum()))
            got, c = {r["part"]: r["body"] for r in replies_ or []}, np.zeros(len(words), np.int64)
            for part, s in slices(words["word"], parts):
                c[s] = expanded(got[part], np.uint32, s.stop - s.start)
            unit, own = u.of(words)
            seq, full, place = sequence(tokens, sizes, unit)
            model_score = score(p, seq, full)
            model_score[place] += u.share(unit, own, c)[tokens]
            base, known = np.full(len(seq), u.base(u.ends)), np.full(len(seq), u.ends > 0)
            base[place], known[place] = u.base(c)[tokens], (c > 0)[tokens]
            at = np.cumsum(full) - full
            cols = (ids, held_, full, np.add.reduceat(known.astype(np.int64), at), np.full(len(ids), u.N), np.add.reduceat(base, at), np.round(np.add.reduceat(model_score, at), 4))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], schema.names)

    joined = table_.join(replies, F.col("chunk") == F.col("to"), "left").select("ids", "held", "sizes", "tokens", "words", "replies")
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose remainder is not 0."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return scored(table(spark, sf_dir, "documents"), held)


QUERIES = {"op5_gru_lm": op5_gru_lm}
ORACLES: dict[str, str] = {}
