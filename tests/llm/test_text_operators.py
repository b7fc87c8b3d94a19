"""Language ID, language model, decontamination, near-duplicates, repeats: brute force and edge cases."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, gru_lm, language_id, near_dup, repeats
from tidemark.llm import shingles as S
from tidemark.llm.components import components

DOC = "doc_id long, text string"


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


# --- language ID ---


def test_held_out_accuracy(spark, sf):
    r = language_id.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert held and sum(x["lang"] == x["lang_pred"] for x in held) / len(held) >= 0.97
    assert all(0 <= x["score"] <= 1 for x in r)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)


def test_languages_of_odd_texts(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (i % 5 + 1), "en" if i % 2 else "de") for i in range(80)]
    model = language_id.learn(spark.createDataFrame(rows + [(99, None, "fr"), (98, "", "fr"), (97, "x", None)], "doc_id long, text string, lang string"))
    assert model["langs"] == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 ,.! \n"), (4, "the dog"), (None, "die katze"), (4, "the dog"), (5, "ü"), (6, "the cat " * 100_000), (7, "1" * 300 + " katze und hund")]
    got = language_id.predict(spark.createDataFrame(odd, DOC).withColumn("keep", F.lit(1)), model, carry=("keep",)).collect()
    pred = [r["lang_pred"] for r in got]
    assert pred[:4] == ["und", "und", "und", "en"] and pred[4] == "de" and pred[5] == "en" and pred[6] != "und" and pred[7] == "en" and pred[8] == "de"
    assert got[0]["score"] == 0 and len(got) == 9
    none = language_id.predict(spark.createDataFrame([(1, "text")], DOC), None).first()
    assert none["lang_pred"] == "und"


def test_letters_are_those_of_unicode():
    assert not any(language_id.has_letter(x.encode()) for x in ("", "½", "²", "①", "Ⅷ1", "_ 12", "一"[:0], "👍", "٣"))
    assert all(language_id.has_letter(x.encode()) for x in ("a", "½é", "ª", "一", "1 ж", "ǅ", "ʰ"))


def test_predictions_against_brute_force(spark, sf):
    """Features by a dictionary of n-grams, margins by sums, and the codeword of least weighted loss, in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(language_id.remainder("doc_id", 4) != 2))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for id_, text in sorted(rows, key=lambda r: (len(r[1] or ""), r[0]))[:60]:
        if not text or not any(c.isalpha() for c in text):
            assert got[id_] == ("und", 0.0)
            continue
        folded = "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text)
        b = (" " + " ".join(folded.split(" ")) + " ").encode()
        while b"  " in b:
            b = b.replace(b"  ", b" ")
        n = Counter()
        for k in range(len(b) - 1):
            two = b[k] * 257 + b[k + 1]
            n[two * 2654435761 % 2**32 >> 20] += 1
            if k + 2 < len(b):
                n[(two * 263 + b[k + 2]) * 2246822519 % 2**32 >> 20] += 1
        norm = math.sqrt(sum(n.values()))
        loss = []
        margins = [4 * (sum(math.sqrt(v) / norm * float(model["w"][h, j]) for h, v in n.items()) + float(model["b"][j])) for j in range(model["code"].shape[1])]
        for word in model["code"]:
            loss.append(sum(float(t) * math.log1p(math.exp(-m * float(c))) for m, c, t in zip(margins, word, model["trust"])))
        p = [math.exp(-x * len(margins)) for x in loss]
        best = max(range(len(p)), key=lambda k: (p[k], -k))
        assert got[id_][0] == model["langs"][best] and got[id_][1] == pytest.approx(p[best] / sum(p), abs=1e-3)


def test_codewords_lie_apart():
    for n in (2, 3, 4, 7, 12, 30):
        c = language_id.codewords(n)
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 1 and (n < 4 or min(apart) >= 3)
    assert language_id.codewords(1).shape == (1, 1)


# --- language model ---


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    p = gru_lm.initial()
    inp, tgt = rng.integers(0, 256, (5, 3)), rng.integers(0, 256, (5, 3))
    first, used = rng.random((5, 3)) < 0.2, np.ones((5, 3), bool)
    h = rng.normal(0, 1, (3, gru_lm.HIDDEN)).astype(np.float32)

    def loss(q):
        hs, _, _ = gru_lm.states(q, inp, first, h, False)
        return -gru_lm.predict(q, hs.reshape(-1, gru_lm.HIDDEN), tgt.reshape(-1), False)[0].sum() / 15

    g, _, _ = gru_lm.gradients(p, inp, tgt, first, used, h)
    for k in p:
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
            i = (int(inp[1, 1]), i[1]) if k == "x" else i
            q = {n: v.astype(np.float64) for n, v in p.items()}
            q[k][i] += 1e-2
            up = loss(q)
            q[k][i] -= 2e-2
            assert g[k][i] == pytest.approx((up - loss(q)) / 2e-2, abs=2e-4)


def test_states_run_on_through_windows():
    """A document's score is that of one pass over it, wherever windows and lanes cut."""
    rng = np.random.default_rng(1)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru_lm.initial().items()}
    sizes = np.array([150, 1, 33, 32, 64, 7])
    units = rng.integers(0, 256, int(sizes.sum()))
    got = gru_lm.score(p, units, sizes)
    at = 0
    for n in sizes:
        seq = units[at : at + n]
        h, want = np.zeros((1, gru_lm.HIDDEN), np.float32), []
        for a, b in zip([0, *seq[:-1]], seq):
            hs, h, _ = gru_lm.states(p, np.array([[a]]), np.zeros((1, 1), bool), h, False)
            want.append(gru_lm.predict(p, hs[0], np.array([b]), False)[0][0] / math.log(10))
        assert got[at : at + n] == pytest.approx(np.array(want), abs=1e-4)
        at += n


def lm_fixture(spark):
    rng = random.Random(3)
    rows = [(i, (prose(rng, rng.randint(1, 60), 60) + " The End.") if i % 2 else " ".join(f"x{rng.randint(0, 5)}y" for _ in range(30))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "never seen Äh WORDS"), (None, "w1 w2"), (5, "w3 w3"), (304, "w1 " * 60_000)]
    return rows, spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash"))


def test_base_scores_and_learning(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 6000)
    rows, d = lm_fixture(spark)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(i, [w for w in (t or "").encode().lower().split()] + [None]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, ws in toks:
        want[i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)] += 1
    h = F.when(F.col("doc_id").isNull(), True).otherwise(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    got = gru_lm.scored(d, h).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"] and r["n_tokens"] > 10]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] <= 0 for r in got)


def test_scores_do_not_hang_on_the_layout(spark, monkeypatch):
    """More than ten chunks, laid out in two ways, one of them backwards; and keys that are text."""
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 3000)
    rng = random.Random(9)
    rows = [(f"k{i}" if i % 9 else None, prose(rng, rng.randint(1, 60), 60) + f" The End {i}.") for i in range(400)]
    held = F.crc32(F.coalesce(F.col("doc_id"), F.lit("")).cast("binary")) % 10 == 0
    score = lambda r, n: {(x["doc_id"], x["n_tokens"], round(x["base_score"], 6)): x["score"] for x in gru_lm.scored(spark.createDataFrame(r, "doc_id string, text string").repartition(n), held).collect()}
    one, two = score(rows, 2), score(rows[::-1], 9)
    assert one.keys() == two.keys() and len(one) > 390
    assert all(abs(one[k] - two[k]) <= 1e-3 * abs(one[k]) for k in one) and abs(sum(one.values()) - sum(two.values())) <= 1e-3 * abs(sum(one.values()))


def test_rows_that_repeat_key_and_text_are_spread(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "CHUNK_BYTES", 2000)
    rows = [(7, "the same words again and again")] * 500 + [(i, f"word{i} and others") for i in range(300)]
    got = gru_lm.scored(spark.createDataFrame(rows, DOC), F.col("doc_id") % 10 == 0).collect()
    assert len(got) == 800 and len({round(r["base_score"], 9) for r in got if r["doc_id"] == 7 and r["n_tokens"] == 7}) == 1
    table_, _ = gru_lm.chunks(spark.createDataFrame(rows, DOC), "doc_id", "text", F.lit(False))
    sizes = [len(r["ids"]) for r in table_.select("ids").collect()]
    assert sum(sizes) == 800 and max(sizes) < 300


def test_gain_over_the_base_on_held_out_text(spark, sf):
    got = [r for r in gru_lm.op5_gru_lm(spark, sf).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    gain = sum(r["score"] - r["base_score"] for r in got) / tokens / math.log10(2)
    assert gain > 0.5, gain  # bits a token


def test_probabilities_of_a_unit_sum_to_one():
    words = np.zeros(40, gru_lm.ENTRY)
    words["word"], words["count"], words["ending"] = np.arange(1, 41), np.arange(40), np.arange(40) % 3
    head = [(40, 39, 0)]
    e = [(k, int(words["count"][words["ending"] == k].sum()), int((words["count"][words["ending"] == k] > 0).sum())) for k in range(3)]
    u = gru_lm.Units(head, e, int(words["count"].sum()), 39, 5)
    unit, own = u.of(words)
    assert own.sum() == 1
    known = words["count"] > 0
    for k in set(unit[~own]):
        mine = (unit == k) & ~own & known
        unseen = u.share(np.array([k]), np.array([False]), np.zeros(1))
        assert (10 ** u.share(unit[mine], own[mine], words["count"][mine].astype(float))).sum() + 10 ** unseen[0] == pytest.approx(1)


def test_model_without_training_documents(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    got = {r["doc_id"]: r for r in gru_lm.scored(d, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and got[2]["n_tokens"] == 1
    assert gru_lm.scored(d.limit(0), F.lit(False)).count() == 0


# --- decontamination ---


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind != 1)] = [f"new{rng.randrange(10**6)}"] if kind != 2 else []
    return w


def levenshtein_in(item, words):
    """Least edits of the item against any part of the words."""
    d = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, d[0] = d[0], i
        for j, b in enumerate(words, 1):
            last, d[j] = d[j], min(last + (a != b), d[j] + 1, d[j - 1] + 1)
    return min(d)


def test_edited_items_are_found(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(8, 50), 3000)) for k in range(30)] + [(77, None), (78, "w1 w2"), (3, "again of another text for id three")]
    docs, want = [], set()
    for i in range(300):
        words = prose(rng, rng.randint(0, 120), 3000).split()
        if i % 3 == 0:
            k, t = items[rng.randrange(30)]
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, t.split(), rng.randint(0, decontamination.allowed(len(t.split())) + 2))
        docs.append((i, " ".join(words).upper() if i % 2 else "\n".join(words)))
    for i, t in docs:
        w = t.lower().split()
        for k, b in items[:30]:
            b = b.split()
            if (e := levenshtein_in(b, w)) <= decontamination.allowed(len(b)):
                want.add((i, k, e))
    docs += [(900, None), (901, ""), (902, "w1 w2")]
    d = spark.createDataFrame(docs, DOC).withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(d, b).collect()}
    assert len(want) > 60 and got <= want | {(i, 3, 0) for i in range(300)}
    assert len(got & want) >= 0.99 * len(want)
    clean = {r["doc_id"] for r in decontamination.without_contamination(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _, _ in got}


def test_items_of_many_lengths(spark):
    """Several hundred items, one much longer than the rest: the keys of an item do not depend on the items it is keyed with."""
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(6, 30), 3000)) for k in range(450)] + [(450, prose(rng, 150, 3000))]
    docs = []
    for k, t in items:
        w = t.split()
        for copy, edits in enumerate((0, decontamination.allowed(len(w)))):
            docs.append((2 * k + copy, " ".join([*prose(rng, rng.randint(0, 20), 3000).split(), *edited(rng, w, edits), *prose(rng, 5, 3000).split()])))
    want = set()
    for i, t in docs:
        w = t.split()
        for k, b in items:
            b = b.split()
            if len(set(b) & set(w)) > len(b) // 2 and (e := levenshtein_in(b, w)) <= decontamination.allowed(len(b)):
                want.add((i, k, e))
    assert {(2 * k, k, 0) for k, _ in items} <= want
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(d, b).collect()}
    assert {(2 * k, k, 0) for k, _ in items} <= got <= want
    assert len(got) >= 0.99 * len(want)
    clean = {r["doc_id"] for r in decontamination.without_contamination(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _, _ in got}


def test_items_without_ids_or_spaces(spark, monkeypatch):
    chinese, thai = "水在标准大气压下的沸点是多少摄氏度", "เมืองหลวงของประเทศไทยคือเมืองอะไร"
    items = [(None, "one question that has no id at all"), (None, "another question without any id to it"), ("zh-1", chinese), ("th-1", thai)]
    docs = [(1, "so one question that has no id at all here"), (2, "another question without any id to it and one question that has no id at all"), (3, "我们问：" + chinese.replace("标准", "一般") + "？答案很简单"), (4, "ก่อน" + thai), (5, "这是另一段完全不同的文字，没有任何题目"), (6, "none of them")]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id string, text string")
    want = [(1, "None", 0), (2, "None", 0), (2, "None", 0), (3, "zh-1", 2), (4, "th-1", 0)]
    for size in (5_000, 2):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", size)
        assert sorted((r["doc_id"], str(r["item_id"]), r["edits"]) for r in decontamination.contaminated(d, b).collect()) == want
        assert sorted(r["doc_id"] for r in decontamination.without_contamination(d, b).collect()) == [5, 6]


def test_short_items_match_word_for_word(spark):
    items = [(1, "Zyx"), (2, "quite rare"), (3, "one two three"), (4, "four words of it"), (5, None), (6, ""), (None, "no id")]
    docs = [(1, "a zyx b Zyx"), (2, "quite very rare"), (3, "so quite\nRARE"), (4, "one two three four words of it"), (5, None), (6, ""), (7, "four words of"), (None, "has no id"), (8, "zyxw no idea")]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in decontamination.contaminated(d, b, shortest=1).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0, 1), (3, 2, 0, 1), (4, 3, 0, 0), (4, 4, 0, 3), (None, None, 0, 1)], key=str)
    assert sorted(r["doc_id"] for r in decontamination.without_contamination(d, b, shortest=1).collect()) == [2, 5, 6, 7, 8]
    assert decontamination.contaminated(d, b).count() == 0


def test_columns_with_odd_names_are_kept(spark):
    d = spark.createDataFrame([(1, "an item that has some words", 5, "x")], "doc_id long, text string, `a.b` long, item_id string")
    b = spark.createDataFrame([(1, "an item that has some words"), (2, None)], "item_id long, text string")
    assert decontamination.without_contamination(d, b.filter("item_id = 2")).collect() == d.collect()
    assert decontamination.without_contamination(d, b).columns == d.columns and decontamination.without_contamination(d, b).isEmpty()


@pytest.mark.parametrize("n", [5, 6, 9, 10, 15, 25, 60, 155, 165, 300])
def test_recall_at_each_length(n):
    """Items with as many random edits as are allowed, within other words."""
    rng, size = random.Random(n), 200 if n < 100 else 60
    items = [(k, prose(rng, n, 3000).encode()) for k in range(size)]
    texts = [" ".join([*prose(rng, 20, 3000).split(), *edited(rng, t.decode().split(), decontamination.allowed(n)), *prose(rng, 20, 3000).split()]).encode() for _, t in items]
    got = {(t, j) for t, j, _, _ in decontamination.Items(items).matches(decontamination.units(texts))}
    assert sum((k, k) in got for k in range(size)) >= 0.98 * size


def test_memory_of_a_very_long_item():
    rng = random.Random(2)
    words = prose(rng, 20_000, 3000)
    items = [(0, words.encode()), *[(k, prose(rng, 30, 3000).encode()) for k in range(1, 100)]]
    tracemalloc.start()
    found = decontamination.Items(items).matches(decontamination.units([f"before {words} and after".encode(), words[:60_000].encode(), items[7][1]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, j, e) for t, j, e, _ in found] == [(0, 0, 0), (2, 7, 0)] and peak < 300e6


def test_words_are_those_of_split():
    rng = random.Random(1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "SEGMENT", 50)  # texts are cut into pieces between words
        for _ in range(100):
            bodies = [bytes(rng.choice(b"ABab \t\n\x0b\x0c\r\xc3\xa9z\x00") for _ in range(rng.choice([0, 1, 49, 50, 51, 400]))) + b"q" * rng.choice([0, 0, 70, 200]) for _ in range(6)]
            seen: dict = {}
            for body, (h, tail) in zip(bodies, S.words_of(bodies)):
                words = body.lower().split()
                assert len(words) == len(h) and [int.from_bytes(w[-2:], "little") for w in words] == tail.tolist()
                assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
            assert len(set(seen.values())) == len(seen)


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == one and one
    assert decontamination.without_contamination(docs, items).count() == docs.count() - len({r[0] for r in one})


# --- near-duplicates ---


def shingle_set(t):
    w = [x.decode("utf-8") for x in (t or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, num, den):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}


def near_fixture():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(3, 150), 2000).split()
        for _ in range(rng.randint(1, 30)):
            rows.append((len(rows) * 7 % 1009, " ".join(edited(rng, base, rng.randint(0, 4)))))
    rows += [(2000, None), (2001, ""), (2002, "One Two"), (2003, "one  two"), (2004, "one two three"), (2005, " \n ")]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # small blocks take the way of large components
    rows = near_fixture()
    want = brute_components(rows, 85, 100)
    d = spark.createDataFrame(rows, DOC).withColumns({"node": F.lit("clash"), "kept": F.lit(0)})
    got = near_dup.near_duplicates(d).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(shingle_set(t)) for k, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_repeated_and_null_keys(spark):
    t = "a b c d e f g h i j k"
    rows = [(5, t), (5, t), (5, "quite another text than that one"), (None, t), (None, "alone here"), (3, t.upper()), (9, "x " * 50_000)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("5", "3", False), ("5", "3", False), ("5", "5", True), ("None", "3", False), ("None", "None", True), ("3", "3", True), ("9", "9", True)])


def test_estimates_are_corrected_for_collisions():
    rng = np.random.default_rng(2)
    for s in (0.0, 0.3, 0.6, 0.9, 1.0):
        est = []
        for _ in range(30):
            both = rng.integers(1, 2**63, int(400 * s), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(1, 2**63, (400 - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
            x, y = (np.frombuffer(S.pack(S.minima(v)), np.uint8) for v in (a, b))
            est.append(S.estimate(S.matches(x, y[None, :])[0]))
            true = len(both) / (len(a) + len(b) - len(both))
        assert np.mean(est) == pytest.approx(true, abs=0.04)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "node long, hub long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


# --- repeats ---


def brute_repeats(rows):
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size, hot", [(2 << 20, 64), (700, 64), (700, 1)])
def test_repeats_against_brute_force(spark, monkeypatch, size, hot):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 256)
    rng = random.Random(6)
    shared = [prose(rng, n, 5000) for n in (18, 25, 40, 90, 300)]
    rows = []
    for i in range(120):
        t = prose(rng, rng.randint(0, 60), 5000)
        for _ in range(rng.randint(0, 3)):
            s = shared[rng.randrange(5)]
            a = rng.randint(0, len(s) // 2)
            t += s[a : a + rng.randint(50, len(s))] + prose(rng, rng.randint(0, 9))
        rows.append((i * 31 % 127, t))
    rows += [(500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 101), (505, "é" * 500), (506, rows[3][1]), (507, rows[3][1] + "x"), (None, shared[4])]
    d = spark.createDataFrame(rows, DOC).repartition(5).withColumn("n_bytes", F.lit("clash"))
    got = sorted((tuple(r) for r in repeats.remove_repeats(d).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == brute_repeats(rows)


def test_a_passage_in_very_many_surroundings(spark, monkeypatch):
    """Strings of 40, 90 and 140 bytes that hundreds of documents share, each among other words: no bucket is refined whole."""
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    rng = random.Random(11)
    shared = [prose(rng, 100, 5000)[:n] for n in (40, 90, 140)]
    rows = [(i, prose(rng, 12, 5000) + shared[i % 3] + prose(rng, 12, 5000)) for i in range(400)]
    got = sorted((tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOC).repartition(3)).collect()))
    assert got == brute_repeats(rows)


def test_very_long_texts_and_order_of_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 50_000)
    rng = random.Random(13)
    text, other = prose(rng, 60_000, 5000), prose(rng, 200, 5000)
    rows = [(1, text), (2, text[5000:] + other), (3, other + "x"), (3, "y" + other), (3, other[:400])]
    runs = [sorted(tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOC).repartition(n)).collect()) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert [r[2] for r in runs[0]][:2] == [r[2] for r in brute_repeats(rows[:2])]


def test_repeated_keys_keep_one_copy(spark):
    t = prose(random.Random(1), 100, 5000)
    got = repeats.remove_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], DOC).repartition(3)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(t), len(t)] and {r["doc_id"]: r["n_removed"] for r in got}[2] == len(t)
