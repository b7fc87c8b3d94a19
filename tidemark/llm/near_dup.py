"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes a set of word shingles; its minima give band keys and a packed
   signature of their low bits. Texts of equal sets are one node.
2. Nodes of a band all are candidates of its smallest node, their hub; so two nodes that
   share a band are in one hub's group.
3. Within a group pairs whose collision-corrected estimate is not clearly too
   low are compared on their full sets, unless links already connect them.
   Groups of more than BLOCK nodes are compared in blocks: first each block with
   itself and the hub, then the nodes that are not connected to the hub with all.
4. Components of the confirmed links give each document the smallest key it can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import shingles as S
from tidemark.llm.common import checkpointed, for_join, join_by_frequency, python_on_executors, table, utf8, written
from tidemark.llm.components import components

#: Nodes that are compared all with all in one task.
BLOCK = 256


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, n_shingles, node, bands, sig) of each row; node is a hash of the whole set, null for an empty set; print tells the texts of a repeated key apart."""
    python_on_executors(docs.sparkSession)
    schema = docs.select(F.col(f"`{key}`").alias("key")).schema.add("print", "long").add("n_shingles", "long").add("node", "long").add("bands", T.ArrayType(T.LongType())).add("sig", "binary")

    def run(batches):
        for b in batches:
            size, node, bands, sig = [], [], [], []
            for words in S.hashes_of(b.column(2).to_pylist()):
                sh = S.shingles(words)
                size.append(len(sh))
                m = S.minima(sh) if len(sh) else None
                node.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(sh.tobytes())))) if len(sh) else None)
                bands.append(S.band_keys(m) if len(sh) else None)
                sig.append(S.pack(m) if len(sh) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema.names)

    body = utf8(F.col(f"`{text}`"))
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("print"), body.alias("body")).mapInArrow(run, schema)


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, hub): nodes of a band, each with the smallest of that band. Never all pairs."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = checkpointed(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1"))
    total = nodes.count() * S.BANDS
    return join_by_frequency(banded, hubs, "band", "n", total).filter("node <> hub").select("node", "hub").distinct()


def compare(keys: list[int], active: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, sets, num: int, den: int) -> list[tuple[int, int]]:
    """Links (node, root) that connect what the pairs (active, any) of a block connect; a forest, not all pairs."""
    n, root = len(keys), np.arange(len(keys))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs, bar = [], num / den - S.slack(num / den)
    for i in np.flatnonzero(active):
        est = S.estimate(S.matches(sigs[i], sigs))
        fit = (est >= bar) & (np.minimum(sizes, sizes[i]) * den >= np.maximum(sizes, sizes[i]) * num)
        fit[i] = False
        if active[:i].any():
            fit[:i] &= ~active[:i]
        pairs += [(-est[j], i, j) for j in np.flatnonzero(fit)]
    for _, i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a != b:
            x, y = sets(i), sets(j)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if den * common >= num * (len(x) + len(y) - common):
                root[max(a, b)] = min(a, b)
    return [(keys[i], keys[find(i)]) for i in range(n) if find(i) != i]


def verify(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (node, hub) confirmed in tasks (task, active, node, n_shingles, sig, body): rows of a task are compared if one of them is active."""
    python_on_executors(tasks.sparkSession)
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(rows: list):
        kept: dict[int, np.ndarray] = {}

        def sets(i: int) -> np.ndarray:
            if i not in kept:
                kept[i] = S.shingles(S.hashes_of([rows[i][4]])[0])
            return kept[i]

        rows.sort(key=lambda r: (r[1], not r[0]))
        rows = [r for i, r in enumerate(rows) if i == 0 or r[1] != rows[i - 1][1]]  # a node may be there twice, as active and not
        sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        return compare([r[1] for r in rows], np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), sigs, sets, num, den)

    def run(batches):
        task, rows = None, []
        for b in batches:
            out = []
            for t, *row in zip(*[c.to_pylist() for c in b.columns]):
                if t != task:
                    out += block(rows) if len(rows) > 1 else []
                    task, rows = t, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "hub"])
        if len(rows) > 1 and (out := block(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "hub"])

    dealt = tasks.select("task", "active", "node", "n_shingles", "sig", "body").repartition(parts, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "node long, hub long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 85, den: int = 100) -> DataFrame:
    """(key, print, n_shingles, component, first) of each row: documents are linked if den * common >= num * union.

    print is a hash of the text, component the smallest key that links can reach; first marks the rows of that key and of its
    smallest print, which stand for the component: more than one only if rows repeat key and text. Null and empty texts have no
    shingles and stand alone, each row for itself. A null key is never the smallest of a component that has another. Other columns are left out.
    """
    sig = checkpointed(signatures(docs, key, text))
    full = sig.filter("node is not null")
    nodes = checkpointed(full.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "print")).alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    near = checkpointed(candidates(nodes))
    sizes = checkpointed(near.groupBy(F.col("hub").alias("label")).agg((F.count("*") + 1).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    members = near.select("node", F.col("hub").alias("label")).union(sizes.select("label", "label"))
    parted = join_by_frequency(members, sizes, "label", "n", max(1, near.count()))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks")).otherwise(0).cast("int")
    placed = checkpointed(parted.withColumn("block", block))
    body = utf8(F.col(f"`{text}`"))
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("print"), body.alias("body"))
    info = nodes.select("node", F.col("rep.key").alias("rep"), F.col("rep.print").alias("own"), "n_shingles", "sig")

    # the texts of candidates are fetched once, by a join on keys, and kept in the shared folder
    wanted = checkpointed(placed.select("node").distinct().join(info, "node"))
    asked = for_join(wanted.select(F.col("node").alias("n"), "rep", "own"), wanted.count())
    bodies = texts.join(asked, F.col("rep").eqNullSafe(F.col("key")) & (F.col("own") == F.col("print"))).select("n", "body")
    if not full.groupBy("key", "print").count().filter("count > 1").isEmpty():
        bodies = bodies.groupBy("n").agg(F.first("body").alias("body"))  # rows that repeat key and text
    bodies = written(bodies.join(wanted, F.col("n") == F.col("node")).select("node", "n_shingles", "sig", "body"), "candidates")

    def tasks(rows: DataFrame) -> DataFrame:
        """Rows (task, active, node) with signature and text."""
        return rows.join(bodies, "node")

    name = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    own = placed.select(name(F.col("label"), F.col("block")).alias("task"), F.lit(True).alias("active"), "node")
    # the hub of a group that has several blocks goes to each of them
    hubs = placed.filter((F.col("blocks") > 1) & (F.col("node") == F.col("label"))).select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "label", "node", "block").filter("b <> block")
    hubs = hubs.select(name(F.col("label"), F.col("b")).alias("task"), F.lit(True).alias("active"), "node")
    links = checkpointed(verify(tasks(own.union(hubs)), num, den))
    found = checkpointed(components(links))
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        joined = checkpointed(large.join(found.withColumnRenamed("label", "root"), "node", "left").select("node", "label", "blocks", "block", F.coalesce("root", "node").alias("root")))
        hub_root = joined.filter("node = label").select(F.col("label").alias("hl"), F.col("root").alias("hub_root"), F.lit(1).alias("one"))
        with_hub = join_by_frequency(joined, joined.groupBy("label").agg(F.count("*").alias("n")).join(hub_root, F.col("label") == F.col("hl")).select("label", "n", "hub_root"), "label", "n", max(1, joined.count()))
        apart = checkpointed(with_hub.filter("root <> hub_root"))
        if not apart.isEmpty():
            counts = apart.groupBy("label").agg(F.count("*").alias("m")).select("label", F.ceil(F.col("m") / BLOCK).cast("int").alias("rows"))
            spread = apart.join(counts, "label").withColumn("row", F.pmod(F.xxhash64(F.lit("row"), "node"), F.col("rows")).cast("int"))
            left = spread.select("node", "label", "row", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
            right = joined.join(counts, "label").select("node", "label", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.col("block").alias("b"))
            task = name(F.col("label"), F.col("row"), F.col("b"))
            second = left.select(task.alias("task"), F.lit(True).alias("active"), "node").union(right.select(task.alias("task"), F.lit(False).alias("active"), "node"))
            more = checkpointed(verify(tasks(second), num, den))
            if not more.isEmpty():
                found = checkpointed(components(links.union(more)))
    least = nodes.join(found, "node", "left").select("node", "copies", "rep", F.coalesce("label", "node").alias("label"))
    tops = least.groupBy("label").agg(F.min("rep").alias("top"), F.count("*").alias("n"))
    named = join_by_frequency(least, checkpointed(tops), "label", "n", max(1, nodes.count())).select("node", "copies", "top")
    out = join_by_frequency(sig.select("key", "print", "n_shingles", "node"), checkpointed(named), "node", "copies", max(1, sig.count()))
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("top.key"))
    first = F.col("node").isNull() | (F.col("key").eqNullSafe(F.col("top.key")) & (F.col("print") == F.col("top.print")))
    return out.select("key", "print", "n_shingles", component.alias("component"), first.alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 85, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; see ``near_groups``.

    Rows that repeat a key and text are in one component, and all of them are kept if that key is the smallest.
    """
    out = near_groups(docs, key, text, num, den)
    return out.select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, key: str, text: str, num: int = 85, den: int = 100) -> DataFrame:
    """One row of each component, with all its columns, and every row whose text is null or empty of words.

    It is a row of the smallest key, then of the smallest hash of the text, then of the smallest hash of all columns.
    """
    held = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    key, text = (held.columns[docs.columns.index(c)] for c in (key, text))
    groups = checkpointed(near_groups(held, key, text, num, den))
    pairs = groups.filter("n_shingles > 0").groupBy("key", "print").agg(F.first("first").alias("first"), F.count("*").alias("rows"))
    # what goes, and what is there more than once; both are few beside the documents
    moot = checkpointed(pairs.filter("not first or rows > 1").select(F.col("key").alias("k"), F.col("print").alias("p"), "first"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.xxhash64(utf8(F.col(text))) == F.col("p"))
    clear = held.join(for_join(moot, moot.count()), same, "left_anti")
    repeated = moot.filter("first")
    if (n := repeated.count()) > 0:
        rows = held.join(for_join(repeated, n), same).withColumn("all", F.struct(*held.columns))
        one = rows.groupBy("k", "p").agg(F.min_by("all", F.xxhash64(*held.columns)).alias("one"))
        clear = clear.unionByName(one.select("one.*"))
    return clear.toDF(*docs.columns)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN c ON c.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
QUERIES = {"op10_near_dup": op10_near_dup}
ORACLES = {"op10_near_dup": OP10_SQL}
