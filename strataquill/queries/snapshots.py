"""Queries that compare and merge snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import diffs
from strataquill.functions import objects as O
from strataquill.operators import similarity, store, trees
from strataquill.queries import query

_CHANGES = """
SELECT coalesce(a.path, b.path) AS path, a.oid AS a, b.oid AS b, a.mode AS am, b.mode AS bm FROM base a FULL OUTER JOIN {new} b ON a.path = b.path
"""


@query(f"""
WITH j AS ({_CHANGES.format(new='theirs')}), k AS (SELECT *, CASE WHEN a IS NULL THEN ['add'] WHEN b IS NULL THEN ['delete'] WHEN a = b AND am = bm THEN ['unchanged']
  WHEN am // 4096 <> bm // 4096 THEN ['delete', 'add'] ELSE ['modify'] END AS kinds FROM j), x AS (SELECT *, unnest(kinds) AS change_type FROM k)
SELECT change_type, CASE WHEN change_type <> 'add' THEN path END AS old_path, CASE WHEN change_type <> 'add' THEN a END AS old_oid,
  CASE WHEN change_type <> 'delete' THEN path END AS new_path, CASE WHEN change_type <> 'delete' THEN b END AS new_oid FROM x
""")
def tree_changes(v):
    """Every path of two snapshots with its change, type changes as deletion and addition."""
    return trees.tree_changes(v.snapshot("base"), v.snapshot("theirs"), want_unchanged=True).select("change_type", "old_path", "old_oid", "new_path", "new_oid")


@query(f"""
WITH j AS ({_CHANGES.format(new='ours')}) SELECT CASE WHEN a IS NULL THEN 'add' WHEN b IS NULL THEN 'delete' WHEN a = b AND am = bm THEN 'unchanged' ELSE 'modify' END AS change_type,
  count(*) AS n FROM j GROUP BY 1
""")
def tree_change_counts(v):
    """Number of changes of each kind between two snapshots."""
    return trees.tree_changes(v.snapshot("base"), v.snapshot("ours"), want_unchanged=True, change_type_same=True).groupBy("change_type").agg(F.count("*").alias("n"))


@query("""
SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM (SELECT coalesce(a.path, b.path) AS path, a.oid AS a, b.oid AS b, a.mode AS am, b.mode AS bm
FROM base a FULL OUTER JOIN ours b ON a.path = b.path) WHERE (a IS DISTINCT FROM b OR am IS DISTINCT FROM bm) AND (path LIKE 'src0/%' OR path LIKE 'new/%') GROUP BY 1
""")
def tree_changes_below_paths(v):
    """Changes below two folders, by folder; the path filter reaches both scans."""
    c = trees.tree_changes(v.snapshot("base"), v.snapshot("ours"), change_type_same=True, paths=["src0", "new"])
    return c.groupBy(F.substring_index(F.coalesce("new_path", "old_path"), "/", 1).alias("folder")).agg(F.count("*").alias("n"))


@query("""
WITH j AS (SELECT coalesce(b.path, o.path, t.path) AS path, b.oid AS b, o.oid AS o, t.oid AS t, b.mode AS bm, o.mode AS om, t.mode AS tm
  FROM base b FULL OUTER JOIN ours o ON o.path = b.path FULL OUTER JOIN theirs t ON t.path = coalesce(b.path, o.path)),
r AS (SELECT path, CASE WHEN o IS NULL AND t IS NULL THEN 'drop' WHEN b IS NULL AND o = t AND om = tm THEN 'ours' WHEN b IS NULL AND t IS NULL THEN 'ours' WHEN b IS NULL AND o IS NULL THEN 'theirs'
  WHEN b IS NULL THEN 'conflict' WHEN o IS NOT NULL AND t IS NOT NULL AND om <> tm THEN 'conflict' WHEN o = t THEN 'ours' WHEN o = b AND t IS NOT NULL THEN 'theirs' WHEN t = b AND o IS NOT NULL THEN 'ours'
  WHEN o IS NULL THEN CASE WHEN t = b THEN 'drop' ELSE 'none' END WHEN t IS NULL THEN CASE WHEN o = b THEN 'drop' ELSE 'conflict' END ELSE 'merge' END AS k, o, t FROM j)
SELECT path, CASE k WHEN 'theirs' THEN t WHEN 'none' THEN NULL ELSE o END AS oid, CASE WHEN k IN ('ours', 'theirs') THEN 'clean' WHEN k = 'merge' THEN 'merge' ELSE 'conflict' END AS outcome FROM r WHERE k <> 'drop'
""")
def merge_trees(v):
    """Three-way merge of whole snapshots."""
    return trees.merge3(v.snapshot("base"), v.snapshot("ours"), v.snapshot("theirs")).select("path", "oid", "outcome")


@query("""
WITH c1 AS (SELECT coalesce(a.path, b.path) AS path, b.oid AS n FROM base a FULL OUTER JOIN theirs b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode),
c2 AS (SELECT coalesce(a.path, b.path) AS path FROM ours a FULL OUTER JOIN theirs b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode)
SELECT c1.path FROM c1 JOIN c2 ON c1.path = c2.path WHERE c1.n IS NOT NULL
""")
def merge_conflict_paths(v):
    """Paths in which a merge result differs from both parents."""
    return trees.changes_for_merge([v.snapshot("base"), v.snapshot("ours")], v.snapshot("theirs")).select("path")


@query("""
SELECT 'staged' AS section, CASE WHEN a.oid IS NULL THEN 'add' WHEN b.oid IS NULL THEN 'delete' ELSE 'modify' END AS change_type, coalesce(a.path, b.path) AS path FROM base a FULL OUTER JOIN ours b ON a.path = b.path
  WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode
UNION ALL SELECT 'unstaged', CASE WHEN b.oid IS NULL THEN 'delete' ELSE 'modify' END, a.path FROM ours a LEFT JOIN theirs b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.mode IS DISTINCT FROM b.mode
UNION ALL SELECT 'untracked', 'add', path FROM theirs WHERE path NOT IN (SELECT path FROM ours)
""")
def status(v):
    """Staged, unstaged and untracked paths of three snapshots."""
    return trees.status(v.snapshot("base"), v.snapshot("ours"), v.snapshot("theirs"))


@query("""
WITH a AS (SELECT path, oid, mode, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM moved m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = m.path)),
d AS (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM base b WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE b.path = m.path)),
r AS (SELECT 'rename' AS change_type, d.path AS old_path, a.path AS new_path FROM a JOIN d ON a.oid = d.oid AND a.n = d.n)
SELECT * FROM r UNION ALL SELECT 'copy', d.path, a.path FROM a JOIN d ON a.oid = d.oid AND d.n = 1 WHERE a.path NOT IN (SELECT new_path FROM r)
""")
def exact_renames(v):
    """Renames and copies of unchanged contents, paired by order within one id."""
    changes = trees.tree_changes(v.snapshot("base"), v.moved())
    gone = changes.where("change_type = 'delete'").select("old_path", "old_oid", "old_mode", F.lit(True).alias("moved"))
    return similarity.exact_pairs(gone, changes.where("change_type = 'add'").select("new_path", "new_oid", "new_mode")).select("change_type", "old_path", "new_path")


def _edited(v):
    """Every blob, and the same with two lines appended; copies come as often as there are."""
    text = F.concat(F.col("data"), F.lit("\nedited\nagain\n"))
    return v.blobs.select("oid", "data"), v.blobs.select(O.blob_id(text).alias("oid"), text.alias("data"))


_BLOCKS = """
b1 AS (SELECT oid, any_value(size) AS size, any_value(data) AS data FROM blobs GROUP BY oid),
b2 AS (SELECT sha1('blob ' || strlen(t) || chr(0) || t) AS oid, any_value(strlen(t)) AS size, any_value(t) AS data FROM (SELECT data || chr(10) || 'edited' || chr(10) || 'again' || chr(10) AS t FROM blobs) GROUP BY 1),
c1 AS (SELECT oid, block, sum(strlen(block) // 2) AS n FROM (SELECT oid, unnest(regexp_extract_all(hex(encode(data)), '(?:0[0-9B-F]|[1-9A-F][0-9A-F]){0,63}0A|(?:0[0-9B-F]|[1-9A-F][0-9A-F]){1,64}')) AS block FROM b1) GROUP BY ALL),
c2 AS (SELECT oid, block, sum(strlen(block) // 2) AS n FROM (SELECT oid, unnest(regexp_extract_all(hex(encode(data)), '(?:0[0-9B-F]|[1-9A-F][0-9A-F]){0,63}0A|(?:0[0-9B-F]|[1-9A-F][0-9A-F]){1,64}')) AS block FROM b2) GROUP BY ALL),
s AS (SELECT c1.oid AS left_oid, c2.oid AS right_oid, CAST(floor(sum(least(c1.n, c2.n)) * 100 / greatest(any_value(b1.size), any_value(b2.size))) AS INTEGER) AS score
  FROM c1 JOIN c2 ON c1.block = c2.block JOIN b1 ON b1.oid = c1.oid JOIN b2 ON b2.oid = c2.oid GROUP BY 1, 2)
"""


@query("SELECT oid, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT oid, block, sum(strlen(block) // 2) AS n FROM (SELECT oid, unnest(regexp_extract_all(hex(encode(data)), '(?:0[0-9B-F]|[1-9A-F][0-9A-F]){0,63}0A|(?:0[0-9B-F]|[1-9A-F][0-9A-F]){1,64}')) AS block FROM (SELECT DISTINCT oid, data FROM blobs)) GROUP BY ALL) GROUP BY oid")
def block_counts(v):
    """Distinct blocks and bytes of every blob."""
    return similarity.count_blocks(v.blobs.select("oid", "data").dropDuplicates(["oid"])).groupBy("oid").agg(F.count("*").alias("n_blocks"), F.sum("bytes").cast("long").alias("bytes"))


@query(f"WITH {_BLOCKS} SELECT * FROM s WHERE score > 60")
def similar_blobs(v):
    """Pairs of blobs of two versions with a similarity over 60."""
    return similarity.similarity(*_edited(v), threshold=60)


@query(f"""
WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY right_oid ORDER BY score DESC, left_oid) AS k FROM s WHERE score > 60),
c AS (SELECT *, row_number() OVER (PARTITION BY left_oid ORDER BY score DESC, right_oid) AS n FROM r WHERE k = 1)
SELECT CASE WHEN n = 1 THEN 'rename' ELSE 'copy' END AS change_type, left_oid AS old_path, right_oid AS new_path FROM c
""")
def content_renames(v):
    """The source of each new content: the most similar old one, a copy where the source is used already."""
    scores = similarity.similarity(*_edited(v), threshold=60)
    none = F.lit(0o100644)
    pairs = scores.select(F.col("left_oid").alias("old_path"), F.col("left_oid").alias("old_oid"), none.alias("old_mode"), F.lit(True).alias("moved"), F.col("right_oid").alias("new_path"), F.col("right_oid").alias("new_oid"), none.alias("new_mode"), "score")
    return similarity.greedy(pairs).select("change_type", "old_path", "new_path")


@query("""
SELECT a.path AS old_path, upper(b.path) AS new_path FROM base a JOIN base b ON a.path = b.path
""")
def case_only_renames(v):
    """Paths that differ in case only."""
    old = v.snapshot("base")
    new = old.select(F.upper("path").alias("path"), "oid", "mode")
    return trees.case_only_renames(trees.tree_changes(old, new))


@query("SELECT path, oid, CAST(mode AS BIGINT) AS mode, CAST(depth AS BIGINT) AS depth FROM flat")
def tree_contents(v):
    """Every folder and file below one root, by joins level by level."""
    roots = v.spark.createDataFrame([("root",)], "root string")
    return trees.flatten(v.tree_entries, roots, include_trees=True).select("path", "oid", F.col("mode").cast("long").alias("mode"), F.col("depth").cast("long").alias("depth"))


@query("SELECT path[8:] AS path, oid FROM flat WHERE path LIKE 'EUROPE/%' AND depth = 4")
def extract_subtree(v):
    """Files below one folder, by paths relative to it."""
    roots = v.spark.createDataFrame([("root",)], "root string")
    return trees.extract_subtree(trees.flatten(v.tree_entries, roots), "EUROPE").select("path", "oid")


@query("""
SELECT path, oid, mode FROM base WHERE path NOT IN (SELECT path FROM ours) UNION ALL SELECT path, oid, mode FROM ours WHERE path NOT IN (SELECT path FROM theirs WHERE path LIKE 'new/%')
""")
def applied_changes(v):
    """A snapshot after upserts and deletions."""
    gone = v.snapshot("theirs").where(F.col("path").startswith("new/"))
    out = trees.apply_changes(v.snapshot("base"), v.snapshot("ours"), v.spark.createDataFrame([], "path string"))
    return trees.apply_changes(out, out.limit(0), gone)


@query("SELECT doc_id, sha1('top' || chr(10) || data || chr(10) || 'end' || chr(10)) AS text_sha1, false AS conflict FROM blobs")
def merged_texts(v):
    """Line merge of every document that both sides edited."""
    t = F.concat("data", F.lit("\n"))
    rows = v.blobs.select("doc_id", diffs.merge_texts(t, F.concat(F.lit("top\n"), t), F.concat(t, F.lit("end\n"))).alias("m"))
    return rows.select("doc_id", F.sha1(F.col("m.text")).alias("text_sha1"), "m.conflict")


@query("""
SELECT oid, path FROM (SELECT oid, path, row_number() OVER (PARTITION BY oid ORDER BY p, path) AS k FROM (SELECT oid, path, 0 AS p FROM ours UNION ALL SELECT oid, path, 1 FROM base)) WHERE k = 1
""")
def overlaid_store(v):
    """Objects of two stores, the first store's first."""
    one = lambda s: v.snapshot(s).groupBy("oid").agg(F.min("path").alias("path"))
    return store.overlay([one("ours"), one("base")])


@query("SELECT DISTINCT oid FROM theirs WHERE oid NOT IN (SELECT oid FROM base)")
def new_objects(v):
    """Objects that a store lacks."""
    return store.add_objects(v.snapshot("base"), v.snapshot("theirs")).select("oid")
