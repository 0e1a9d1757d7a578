"""Queries over stores and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.operators import history, similarity, store
from strataquill.queries import query


@query("SELECT count(*) FILTER (loose) AS loose, CAST(sum(size) FILTER (loose) AS BIGINT) AS loose_bytes, count(*) FILTER (NOT loose) AS packed, count(DISTINCT lang) FILTER (NOT loose) AS packs, CAST(sum(size) FILTER (NOT loose) AS BIGINT) AS packed_bytes, (SELECT count(*) FROM (SELECT oid FROM blobs b JOIN documents d USING (doc_id) WHERE d.source = 'src0' AND oid IN (SELECT oid FROM blobs JOIN documents USING (doc_id) WHERE documents.source <> 'src0'))) AS prune_packable FROM (SELECT b.*, d.lang, d.source = 'src0' AS loose FROM blobs b JOIN documents d USING (doc_id))")
def count_objects(v):
    """Counts and bytes of loose and packed objects."""
    rows = v.blobs.join(v.table("documents").select("doc_id", "lang", "source"), "doc_id")
    return store.count_objects(rows.where("source = 'src0'"), rows.where("source <> 'src0'").withColumn("pack", F.col("lang")))


@query("SELECT oid, any_value(size) AS size FROM blobs WHERE oid LIKE 'a%' GROUP BY oid")
def objects_by_prefix(v):
    """Objects whose ids start with a character."""
    return store.prefix(v.blobs.select("oid", "size").withColumn("type", F.lit("blob")), "a", "blob").select("oid", "size")


@query("SELECT DISTINCT oid FROM base WHERE oid IN (SELECT oid FROM theirs)")
def object_subset(v):
    """Objects of one store that another names."""
    return store.subset(v.snapshot("base"), v.snapshot("theirs")).select("oid").distinct()


@query("SELECT oid FROM base WHERE oid NOT IN (SELECT oid FROM theirs) GROUP BY oid")
def repacked_objects(v):
    """All objects as one pack without those of another store."""
    return store.repack(v.snapshot("base").select("oid"), v.snapshot("theirs")).select("oid")


@query("SELECT p_partkey, list(k) OVER (PARTITION BY p_type ORDER BY p_name, p_size DESC, k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS k FROM part)".replace("SELECT p_partkey, list(k) OVER", "SELECT p_partkey, array_to_string(list(k) OVER").replace("1 PRECEDING) AS c", "1 PRECEDING), ',') AS candidates"))
def delta_candidates(v):
    """Up to ten candidates for every part's delta base."""
    rows = v.table("part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("oid"), F.col("p_type").alias("type"), F.col("p_name").alias("path"), F.col("p_size").alias("size"))
    found = similarity.delta_bases(rows)
    return found.select("p_partkey", F.when(F.size("candidates") > 0, F.array_join("candidates", ",")).alias("candidates"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_name, p_size DESC, lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS place FROM part")
def delta_order(v):
    """Every part's place in delta order."""
    rows = v.table("part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("oid"), F.col("p_type").alias("type"), F.col("p_name").alias("path"), F.col("p_size").alias("size"))
    return similarity.delta_order(rows).select("p_partkey", F.col("position").cast("long").alias("place"))


@query("SELECT DISTINCT l_orderkey || '-' || l_linenumber AS oid, 'b' || (l_partkey % 50) AS delta_base FROM lineitem WHERE l_partkey % 50 < 20 AND l_linenumber <= 2")
def reusable_deltas(v):
    """Stored deltas that may be sent as they are."""
    e = v.table("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("oid"), F.concat(F.lit("b"), (F.col("l_partkey") % 50).cast("string")).alias("delta_base"), "l_linenumber")
    known = v.spark.range(20).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("oid"))
    return similarity.reusable_deltas(e, e.where("l_linenumber <= 2").select("oid").distinct(), known).select("oid", "delta_base").distinct()


@query("SELECT l_orderkey || '-' || l_linenumber AS oid FROM lineitem GROUP BY 1 UNION ALL SELECT DISTINCT 'b' || (l_partkey % 50) FROM lineitem")
def completed_thin_pack(v):
    """A thin pack with the bases that its deltas need."""
    e = v.table("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("oid"), F.concat(F.lit("b"), (F.col("l_partkey") % 50).cast("string")).alias("delta_base")).dropDuplicates(["oid", "delta_base"])
    bases = v.spark.range(60).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("oid"))
    return store.complete_thin(e, bases).select("oid").distinct()


@query("SELECT oid AS object, lpad(CAST(doc_id AS VARCHAR), 40, '0') AS note FROM (SELECT oid, min(doc_id) AS doc_id FROM blobs GROUP BY oid)")
def listed_notes(v):
    """Notes by object from a fanned-out tree."""
    rows = v.blobs.groupBy("oid").agg(F.min("doc_id").alias("d"))
    return store.list_notes(rows.select(O.note_path(F.col("oid"), 1).alias("path"), F.lpad(F.col("d").cast("string"), 40, "0").alias("oid")))


@query("SELECT CASE WHEN n < 256 THEN oid WHEN n < 65536 THEN oid[1:2] || '/' || oid[3:] ELSE oid[1:2] || '/' || oid[3:4] || '/' || oid[5:] END AS path FROM (SELECT oid, count(*) OVER () AS n FROM (SELECT DISTINCT oid FROM blobs))")
def rebalanced_notes(v):
    """Notes at the fan-out that their number asks for."""
    rows = v.blobs.select("oid").distinct()
    return store.rebalance_notes(rows.select(O.note_path(F.col("oid"), 0).alias("path"), "oid")).select("path")


@query("SELECT 'f' || doc_id AS path, count(*) FILTER (l LIKE 'Th%') AS added, count(*) FILTER (l NOT LIKE 'Th%') AS deleted FROM (SELECT doc_id, unnest(string_split(data, chr(10))) AS l FROM blobs) GROUP BY doc_id")
def diffstat(v):
    """Added and deleted lines of patches made of all documents."""
    body = v.blobs.select("doc_id", F.posexplode(F.split("data", "\n")).alias("n", "t")).select("doc_id", (F.col("n") + 2).alias("n"), F.concat(F.when(F.col("t").startswith("Th"), "+").otherwise("-"), "t").alias("line"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    head = v.blobs.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name).alias("line")), F.struct(F.lit(1).alias("n"), F.lit("@@ -1 +1 @@").alias("line")))).alias("x")).select("doc_id", "x.n", "x.line")
    lines = head.unionByName(body).select(F.col("doc_id").alias("diff"), F.col("n").alias("line_no"), "line")
    return history.diffstat(lines).select("path", F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"))


@query("SELECT DISTINCT lang AS filter FROM documents WHERE lang = 'en'")
def matching_bundles(v):
    """Bundles of the filter asked for."""
    return store.matching_bundles(v.table("documents").select(F.col("lang").alias("filter")).distinct(), "en")
