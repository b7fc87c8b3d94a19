"""Language identification with error-correcting output codes.

Each language has a codeword of bits; one binary classifier a bit, on hashed byte
n-grams, gives a margin. Decoding weighs each bit's logistic loss by how well that
classifier separates its two sides, and takes the codeword of least loss.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import python_on_executors, table, utf8

#: The bound of the sample that is fitted: documents of all languages together, or LEAST_DOCS of each where there are very many languages.
FIT_DOCS, LEAST_DOCS = 2048, 16
DIMS = 4096
#: Two codewords closer than this (in probability) leave the language open.
TIE = 0.02
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: A-Z to a-z, digits and ASCII punctuation to space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(body: bytes) -> bool:
    """Whether a text has a character of one of the Unicode categories of letters (numbers such as a half sign are none)."""
    if ASCII_LETTER.search(body):
        return True
    return not body.isascii() and any(map(str.isalpha, body.decode("utf-8", "replace")))


def codewords(n: int) -> np.ndarray:
    """An n by bits matrix of +1 and -1: for up to 7 languages every split in two, beyond that random splits far apart."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 7:
        rows = [[1] + [1 if k >> j & 1 else -1 for j in range(n - 1)] for k in range((1 << (n - 1)) - 1)]
        return np.array(rows, np.float32).T
    rng, best, far = np.random.default_rng(n), None, -1.0
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = (m.shape[1] - m @ m.T) / 2
        np.fill_diagonal(apart, np.inf)
        if apart.min() > far:
            best, far = m, apart.min()
    return best


def features(body: bytes) -> np.ndarray:
    """Square roots of counts of hashed byte bigrams and trigrams, of length 1."""
    x = np.frombuffer(b" " + body.translate(FOLD) + b" ", np.uint8)
    blank = x == 32
    x = x[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(DIMS, np.float32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    h = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(32 - 12)
    v = np.sqrt(np.bincount(h, minlength=DIMS)).astype(np.float32)
    return v / np.float32(np.sqrt(v @ v))


def fit(x: np.ndarray, y: np.ndarray, n: int) -> dict:
    """Logistic classifiers for the bits, by accelerated gradient descent, and the bits' weights."""
    code = codewords(n)
    target = code[y]
    side = np.stack([1 / np.maximum(1, np.bincount(y, minlength=n))[y]], axis=1).astype(np.float32)
    side = side / side.sum()  # languages count alike
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    vw, vb, rate, l2 = w.copy(), b.copy(), np.float32(8.0), np.float32(1e-4)
    for k in range(80):
        pull = -target * side / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30)))
        nw, nb = vw - rate * (x.T @ pull + l2 * vw), vb - rate * pull.sum(axis=0)
        m = np.float32(k / (k + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    right = ((x @ w + b) * target > 0).astype(np.float32)
    trust = np.maximum(0.02, 2 * (right * side).sum(axis=0) - 1)
    return {"w": w, "b": b, "code": code, "trust": (trust / trust.sum()).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> np.ndarray:
    """The languages' probabilities for rows of features: a softmax of minus the weighted losses times the number of bits."""
    margin = 4 * (x @ model["w"] + model["b"])
    loss = np.stack([(np.logaddexp(0, -margin * c) * model["trust"]).sum(axis=1) for c in model["code"]], axis=1)
    z = -loss * model["code"].shape[1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> dict | None:
    """Fit on a bounded sample of labelled rows: about ``fit_docs`` in all, as many of each language, those of least hash of the key.

    Rows with null text or label teach nothing. None if no row is labelled.
    """
    python_on_executors(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), utf8(F.col(f"`{text}`")).alias("body"), F.col(f"`{lang}`").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (F.octet_length("body") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    quota = max(LEAST_DOCS, fit_docs // len(langs))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, int(min(1.0, quota / counts[k]) * 2**32))])
    picked = rows.filter(F.pmod(F.xxhash64("k"), F.lit(2**32)) <= share[F.col("lang")]).select("k", "lang", "body")

    def vectors(batches):
        for b in batches:
            v = [features(x).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary())], ["k", "lang", "v"])

    got = picked.mapInArrow(vectors, "k string, lang string, v binary").toPandas().sort_values(["lang", "k"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float32) for v in got["v"]])
    y = np.array([langs.index(v) for v in got["lang"]])
    model = fit(x, y, len(langs))
    return model | {"langs": langs}


def predict(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., lang_pred, score, ambiguous) of each row.

    A text that is null or has no letter, and any text if nothing was learned, is
    ``und`` with score 0. The score is the probability of the language that was chosen;
    ``ambiguous`` says that the second is less than TIE below it. Ties go to the
    language that sorts first.
    """
    spark = df.sparkSession
    python_on_executors(spark)
    cols = [key, *carry]
    schema = df.select(*cols).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            bodies = b.column(len(cols)).to_pylist()
            seen = [bool(m and x and has_letter(x)) for x in bodies]
            at = np.flatnonzero(seen)
            pred, score, open_ = [UNKNOWN] * len(bodies), np.zeros(len(bodies)), np.zeros(len(bodies), bool)
            for part in np.array_split(at, max(1, len(at) // 250)):
                if len(part):
                    p = decode(m, np.stack([features(bodies[i]) for i in part]))
                    top = p.argmax(axis=1)
                    score[part] = np.round(p[np.arange(len(part)), top].astype(float), 6)
                    if p.shape[1] > 1:
                        q = np.sort(p, axis=1)
                        open_[part] = q[:, -1] - q[:, -2] < TIE
                    for i, k in zip(part, top):
                        pred[i] = m["langs"][k]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(cols))], pa.array(pred, pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(open_)], schema.names)

    return df.select(*cols, utf8(F.col(f"`{text}`")).alias("__body")).mapInArrow(run, schema)


def remainder(key: str, n: int):
    """CRC-32 of the key as text (null: of no bytes) modulo n."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % n


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(remainder("doc_id", 4) != 2))
    held = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return predict(held, model, carry=("held_out",))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
