"""Each stage of the pipeline against a brute-force version of what it keeps; and life without this subpackage."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, levenshtein_in, prose

import corpus_pipeline as P
from tidemark.llm import decontamination, sharding

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "123 !!", "en", "src1", 6), (9004, prose(rng, 200), "en", None, 1)]
    return d.unionByName(spark.createDataFrame(odd, SCHEMA)).withColumns({c: F.lit("extra") for c in ("score", "target", "copies", "weighted", "node", "shard0", "__id", "__scores", "a.b")})


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_stage_drops_only_what_has_no_language(spark, docs, sf):
    out = P.language_id(spark, docs, sf)
    assert out.columns == docs.columns
    gone = set(ids(docs)) - set(ids(out))
    assert {9001, 9002, 9003} <= gone and len(gone - {9004}) == 3


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, sf):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(rows, 80, 100)
    out = P.near_dedup(spark, docs.union(docs.filter("doc_id < 5")), sf)
    assert ids(out) == sorted(set(want.values())) and out.columns == docs.columns


def test_near_duplicate_stage_goes_by_rows(spark, sf):
    """Ids that repeat with equal and other texts, rows that differ in other columns only, null ids and empty texts, against brute force."""
    rng = random.Random(12)
    base = [prose(rng, 80) for _ in range(6)]
    rows = []
    for i in range(60):
        t = base[i % 6].split()
        t[rng.randrange(80)] = f"other{i}"
        rows.append((rng.choice([None, 1, 2, 3, i, i]), " ".join(t) if i % 3 else base[i % 6], "en", f"src{i % 4}", i % 5))
    rows += [rows[0], rows[1], rows[1], (7, None, "en", "a", 0), (7, None, "en", "b", 0), (8, "", "en", "a", 0), (5, base[0].upper(), "en", "a", 0), (5, base[1], "de", "x1", 1), (5, base[1], "de", "x2", 2)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("__id", "a.b", "first", "k", "p", "all")})
    out = P.near_dedup(spark, d, sf)
    assert out.columns == d.columns
    got = [tuple(r)[:5] for r in out.collect()]
    assert not set(got) - set(rows)
    groups = brute_components([(k, r[1]) for k, r in enumerate(rows)], 80, 100)
    for root in set(groups.values()):
        mine = [rows[k] for k, g in groups.items() if g == root]
        left = [r for r in got if r in mine]
        if (mine[0][1] or "").split():
            assert len(left) == 1 and left[0][0] == min((r[0] for r in mine if r[0] is not None), default=None)
        else:
            assert len(left) == len(got) - len([r for r in got if r not in mine]) >= 1
    empty = [r for r in rows if not (r[1] or "").split()]
    assert sorted(map(str, [r for r in got if not (r[1] or "").split()])) == sorted(map(str, empty))
    again = [tuple(r)[:5] for r in P.near_dedup(spark, d.repartition(7), sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_stages_on_repeats_nulls_and_clashes(spark, docs, sf, tmp_path):
    """Every stage on rows that repeat, on rows of nulls, on no rows, and on columns of any name."""
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "some words", None, None, None), (4, None, None, "src1", None)], SCHEMA)
    d = docs.limit(80).unionByName(docs.filter("doc_id < 9")).unionByName(nulls, allowMissingColumns=True)
    d.write.parquet(f"{tmp_path}/odd")
    d = spark.read.schema(d.schema).parquet(f"{tmp_path}/odd")
    n = d.count()
    for name, stage in P.STAGES:
        out = stage(spark, d, sf)
        assert [c for c in out.columns if c != "shard"] == d.columns and {"__id", "__scores", "a.b"} <= set(out.columns), name
        rows = out.collect()
        assert len(rows) <= (3 * n if name == "mix" else n) and rows, name
        if name == "shard":
            assert len(rows) == n and all(r["shard"] is not None for r in rows)
        assert stage(spark, d.limit(0), sf).count() == 0, name


def test_decontamination_stage(spark, docs, sf):
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = [b for b in items if len(b) >= decontamination.LEAST_WORDS]
    want = []
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().decode().split()
        if not any(len(set(b) & set(w)) > len(b) // 2 and levenshtein_in(b, w) <= decontamination.allowed(len(b)) for b in items):
            want.append(r["doc_id"])
    out = P.decontaminate(spark, docs, sf)
    assert ids(out) == sorted(want) and len(want) < docs.count() and out.columns == docs.columns


def test_mix_and_shard_stages(spark, docs, sf):
    out = P.mix(spark, docs, sf)
    n = Counter(ids(out))
    assert out.columns == docs.columns and max(n.values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect())
    words = lambda i: len((texts[i] or "").split())
    total = sum(words(i) for i in texts)
    assert abs(sum(k * words(i) for i, k in n.items()) - total) < 0.1 * total
    s = P.shard(spark, out, sf)
    assert s.columns == [*docs.columns, "shard"] and ids(s) == ids(out)
    assert s.groupBy("doc_id").agg(F.countDistinct("shard").alias("k")).filter("k > 1").count() == 0
    assert s.agg(F.min("shard"), F.max("shard")).first()[1] < sharding.SHARDS


def test_run_is_all_stages(spark, sf):
    out = P.run(spark, sf)
    got = out.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in P.STAGES:
        docs = f(spark, docs, sf)
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect())) and got
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]


@pytest.mark.parametrize("missing", [("tidemark.llm", "corpus_pipeline"), ()])
def test_entry_without_this_subpackage(missing, tmp_path):
    """A copy of the repository without these folders still has its other queries."""
    import shutil

    for p in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / p
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / p)
    if missing:
        shutil.rmtree(tmp_path / "tidemark" / "llm")
        (tmp_path / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q)); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == (["False", "False"] if missing else ["True", "True"])


def test_other_import_errors_are_not_swallowed(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
