"""The driver's tables as commits, parents, refs, blobs, snapshots and trees, in Spark and in SQL.

Residues of ids stand for edits: they decide which path a version lacks or changes, never which rows a query reads.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions.dates import epoch_seconds

REG, EXE, LINK, DIR = 0o100644, 0o100755, 0o120000, 0o040000


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def blobs(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select("doc_id", path.alias("path"), text.alias("data"), O.blob_id(text).alias("oid"), F.octet_length(text).cast("long").alias("size"))

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("commit"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("committer"), epoch_seconds(F.col("ts")).alias("commit_time"), F.col("event_type").alias("message"))

    @cached_property
    def parents(self) -> DataFrame:
        e = self.table("events").select(F.col("event_id").alias("commit"))
        first = e.where("commit > 1").select("commit", F.lit(1).alias("parent_no"), F.expr("commit div 2").alias("parent"))
        second = e.where("commit >= 3 and commit % 3 = 0").select("commit", F.lit(2).alias("parent_no"), F.expr("commit div 3").alias("parent"))
        return first.unionByName(second)

    @cached_property
    def branches(self) -> DataFrame:
        return self.table("events").groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("branch")).agg(F.max("event_id").alias("node"))

    @cached_property
    def tags(self) -> DataFrame:
        e = self.table("events").where("event_id % 500 = 0")
        return e.select(F.concat(F.lit("refs/tags/v"), F.expr("event_id div 500").cast("string")).alias("name"), F.col("event_id").alias("oid"))

    def ids(self, *numbers: int) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in numbers], "node long")

    def chunked(self, df: DataFrame, column: str, rows: int = 1000) -> DataFrame:
        """``df`` with chunk: groups of about ``rows`` rows, as many as the table asks for."""
        n = max(1, df.count() // rows)
        return df.withColumn("chunk", F.expr(f"pmod(xxhash64({column}), {n})"))

    def snapshot(self, version: str) -> DataFrame:
        """(path, oid, mode) of base, ours or theirs."""
        b = self.blobs
        gone, edited, odd = {"base": (-1, -1, -1), "ours": (0, 2, 4), "theirs": (1, 3, 4)}[version]
        r = F.col("doc_id") % 10
        data = F.when(r == edited, F.concat("data", F.lit(version))).otherwise(F.col("data"))
        mode = F.when((r == odd) & F.lit(version == "ours"), EXE).when((r == 5) & F.lit(version == "theirs"), LINK).otherwise(REG)
        rows = b.where(r != gone).select("path", O.blob_id(data).alias("oid"), mode.cast("int").alias("mode"))
        extra = b.where(r == 6).select(F.concat(F.lit("new/"), F.col("path")).alias("path"), O.blob_id(F.concat("data", F.lit("new" if version == "theirs" else "NEW"))).alias("oid"), F.lit(REG).alias("mode"))
        return rows if version == "base" else rows.unionByName(extra)

    def moved(self) -> DataFrame:
        """The base snapshot with the paths of one source moved and copies of another."""
        b = self.snapshot("base")
        move = F.when(F.col("path").startswith("src1/"), F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
        copies = b.where(F.col("path").startswith("src2/")).select(F.concat(F.lit("copies/"), F.col("path")).alias("path"), "oid", "mode")
        return b.select(move.alias("path"), "oid", "mode").unionByName(copies)

    @cached_property
    def tree_entries(self) -> DataFrame:
        """(tree, name, mode, oid) of region, nation, customer and order as folders and files."""
        d, f = F.lit(DIR), F.lit(REG)
        s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        root = self.table("region").select(F.lit("root").alias("tree"), F.col("r_name").alias("name"), d.alias("mode"), s("r", "r_regionkey").alias("oid"))
        nation = self.table("nation").select(s("r", "n_regionkey").alias("tree"), F.col("n_name").alias("name"), d.alias("mode"), s("n", "n_nationkey").alias("oid"))
        customer = self.table("customer").select(s("n", "c_nationkey").alias("tree"), F.col("c_name").alias("name"), d.alias("mode"), s("c", "c_custkey").alias("oid"))
        order = self.table("orders").select(s("c", "o_custkey").alias("tree"), F.col("o_orderkey").cast("string").alias("name"), f.alias("mode"), s("o", "o_orderkey").alias("oid"))
        return root.unionByName(nation).unionByName(customer).unionByName(order)

    @cached_property
    def reflog(self) -> DataFrame:
        """(ref, seq, old, new, ts): each user's branch moves to each of its events."""
        e = self.commits
        from pyspark.sql import Window

        order = Window.partitionBy("author").orderBy("commit")
        return e.select(F.col("author").alias("ref"), F.col("commit").alias("seq"), F.coalesce(F.lag("commit").over(order), F.lit(-1)).alias("old"), F.col("commit").alias("new"), F.col("commit_time").alias("ts"))


def _snapshot_sql(version: str) -> str:
    gone, edited, odd = {"base": (-1, -1, -1), "ours": (0, 2, 4), "theirs": (1, 3, 4)}[version]
    oid = lambda t: f"sha1('blob ' || strlen({t}) || chr(0) || {t})"
    data = f"CASE WHEN doc_id % 10 = {edited} THEN data || '{version}' ELSE data END"
    mode = f"CASE WHEN doc_id % 10 = {odd} AND '{version}' = 'ours' THEN {EXE} WHEN doc_id % 10 = 5 AND '{version}' = 'theirs' THEN {LINK} ELSE {REG} END"
    out = f"SELECT path, {oid('(' + data + ')')} AS oid, {mode} AS mode FROM blobs WHERE doc_id % 10 <> {gone}"
    if version != "base":
        new = "data || 'new'" if version == "theirs" else "data || 'NEW'"
        out += f" UNION ALL SELECT 'new/' || path, {oid('(' + new + ')')}, {REG} FROM blobs WHERE doc_id % 10 = 6"
    return out


SQL_VIEWS = {
    "blobs": "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS data, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS oid, strlen(coalesce(text, '')) AS size FROM documents",
    "commits": "SELECT event_id AS id, 'user' || user_id AS author, CAST(floor(epoch(ts)) AS BIGINT) AS commit_time, event_type AS message FROM events",
    "parents": "SELECT event_id AS id, 1 AS parent_no, event_id // 2 AS parent FROM events WHERE event_id > 1 UNION ALL SELECT event_id, 2, event_id // 3 FROM events WHERE event_id >= 3 AND event_id % 3 = 0",
    "branches": "SELECT 'user' || user_id AS branch, max(event_id) AS node FROM events GROUP BY user_id",
    "tags": "SELECT 'refs/tags/v' || (event_id // 500) AS name, event_id AS oid FROM events WHERE event_id % 500 = 0",
    "base": _snapshot_sql("base"),
    "ours": _snapshot_sql("ours"),
    "theirs": _snapshot_sql("theirs"),
    "moved": "SELECT CASE WHEN path LIKE 'src1/%' THEN 'moved/' || path ELSE path END AS path, oid, mode FROM base UNION ALL SELECT 'copies/' || path, oid, mode FROM base WHERE path LIKE 'src2/%'",
    "flat": "SELECT r_name AS path, 16384 AS mode, 'r' || r_regionkey AS oid, 1 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, 16384, 'n' || n_nationkey, 2 FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, 16384, 'c' || c_custkey, 3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey, 33188, 'o' || o_orderkey, 4 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    "reflog": "SELECT author AS ref, id AS seq, coalesce(lag(id) OVER (PARTITION BY author ORDER BY id), -1) AS old, id AS new, commit_time AS ts FROM commits",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views that it names, directly or through others."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in SQL_VIEWS:
            if v not in need and re.search(rf"\b(FROM|JOIN|IN|,)\s*\(?\s*{v}\b", text):
                add(SQL_VIEWS[v])
                if v not in need:
                    need.append(v)

    add(sql)
    head = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in need)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[4:].strip()}"
    return f"WITH {head} {body}"
