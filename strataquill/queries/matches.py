"""Queries with path rules, object filters and line checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import text as X
from strataquill.functions.globs import wildmatch
from strataquill.operators import matching, object_filters, trees
from strataquill.queries import query

IGNORE = ["# sources", "src1/", "*.txt", "!src2/**", "/src3/en", "!src3/en/1.txt", "src2/fr/"]


@query("""
WITH p AS (SELECT path, split_part(path, '/', 1) AS s, split_part(path, '/', 2) AS l FROM blobs)
SELECT path, CASE WHEN s = 'src1' OR (s = 'src3' AND l = 'en') OR (s = 'src2' AND l = 'fr') THEN true WHEN s = 'src2' THEN false ELSE true END AS ignored FROM p
""")
def ignored_paths(v):
    """Verdict of ignore rules on every document's path."""
    return v.blobs.select("path", matching.is_ignored(F.col("path"), IGNORE).alias("ignored"))


@query("""
SELECT path, CASE WHEN path LIKE 'src4/%' THEN CASE WHEN path LIKE 'src4/en/%' THEN false ELSE true END WHEN path LIKE '%/de/%' THEN true END AS ignored FROM blobs
""")
def ignored_paths_by_folder(v):
    """Verdict of rule files in two folders; the deeper one cannot bring back what the root's file excludes as a folder."""
    files = {"": ["de/"], "src4": ["*.txt", "!en/*.txt", "!de/*.txt"]}
    return v.blobs.select("path", matching.is_ignored_by(F.col("path"), files).alias("ignored"))


@query("""
SELECT path, 'true' AS text, CASE WHEN path LIKE 'src5/%' THEN 'lf' END AS eol, CASE WHEN path LIKE '%/en/%' THEN 'false' WHEN path LIKE '%/de/%' THEN NULL ELSE 'true' END AS diff FROM blobs
""")
def attributes_of_paths(v):
    """Attributes of every document's path."""
    lines = ["*.txt text diff", "src5/** eol=lf", "**/en/*.txt -diff", "**/de/*.txt !diff"]
    m = matching.attributes(F.col("path"), lines)
    return v.blobs.select("path", m.alias("m")).select("path", F.col("m")["text"].alias("text"), F.col("m")["eol"].alias("eol"), F.col("m")["diff"].alias("diff"))


@query("SELECT path FROM blobs WHERE (path LIKE 'src1/%' AND path NOT LIKE 'src1/fr/%') OR path LIKE '%/de/1%.txt'")
def sparse_paths(v):
    """Paths that full sparse patterns include."""
    return matching.included_paths(v.blobs.select("path"), ["/src1/", "!/src1/fr/", "/*/de/1*.txt"])


@query("SELECT path, NOT (path LIKE 'src1/%' OR path LIKE 'src2/en/%') AS skip_worktree FROM blobs")
def cone_sparse_paths(v):
    """Flag of paths that cone patterns leave out."""
    return matching.skip_worktree(v.blobs.select("path"), ["/*", "!/*/", "/src1/", "/src2/en/"], cone=True)


def _objects(v):
    roots = v.spark.createDataFrame([("root",)], "root string")
    flat = trees.flatten(v.tree_entries, roots, include_trees=True)
    kind = F.when(F.col("mode") == 0o040000, "tree").otherwise("blob")
    size = v.table("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("oid"), F.floor("o_totalprice").cast("long").alias("size"))
    return flat.join(size, "oid", "left").select("oid", kind.alias("type"), F.coalesce("size", F.lit(0)).alias("size"), "depth", "path")


_SIZED = "x AS (SELECT f.*, CASE WHEN mode = 16384 THEN 'tree' ELSE 'blob' END AS type, CAST(coalesce(floor(o_totalprice), 0) AS BIGINT) AS size FROM flat f LEFT JOIN orders ON oid = 'o' || o_orderkey)"


@query(f"WITH {_SIZED} SELECT oid, type FROM x WHERE type <> 'blob'")
def filter_blob_none(v):
    """Objects without blobs."""
    return object_filters.apply(_objects(v), object_filters.parse("blob:none")).select("oid", "type")


@query(f"WITH {_SIZED} SELECT oid, type FROM x WHERE type <> 'blob' OR size <= 102400")
def filter_blob_limit(v):
    """Objects without blobs over a size."""
    return object_filters.apply(_objects(v), object_filters.parse("blob:limit=100k")).select("oid", "type")


@query(f"WITH {_SIZED} SELECT oid, type FROM x WHERE (type = 'tree' AND depth <= 2) OR (type = 'blob' AND depth < 2)")
def filter_tree_depth(v):
    """Objects down to a depth."""
    return object_filters.apply(_objects(v), object_filters.parse("tree:2")).select("oid", "type")


@query(f"WITH {_SIZED} SELECT oid, type FROM x WHERE (type <> 'blob' OR path LIKE 'ASIA/%') AND (type <> 'blob' OR size <= 204800)")
def filter_combined(v):
    """Objects by sparse rules and a size together, at any place."""
    f = object_filters.parse("combine:sparse:oid=rules+blob:limit=200k", lambda _: ["/ASIA/"])
    return object_filters.apply_with_paths(_objects(v), f)


@query("SELECT path FROM flat WHERE path = 'EUROPE' OR path LIKE 'EUROPE/%'")
def paths_below(v):
    """Everything at or below one folder."""
    roots = v.spark.createDataFrame([("root",)], "root string")
    return trees.under_paths(trees.flatten(v.tree_entries, roots, include_trees=True), ["EUROPE"]).select("path")


@query("SELECT doc_id, n AS line_no, e AS error FROM (SELECT doc_id, n, unnest(list_filter([CASE WHEN regexp_matches(l, '[ \\t]+\\r?$') THEN 'trailing-space' END, CASE WHEN regexp_matches(l, '^\\t* +\\t') THEN 'space-before-tab' END, CASE WHEN regexp_matches(l, '^[ \\t]* {8,}') THEN 'indent-with-non-tab' END, CASE WHEN regexp_matches(l, '^ *\\t') THEN 'tab-in-indent' END, CASE WHEN suffix(l, chr(13)) THEN 'cr-at-eol' END], lambda x: x IS NOT NULL)) AS e FROM (SELECT doc_id, unnest(range(1, len(string_split(data, chr(10))) + 1)) AS n, unnest(string_split(data, chr(10))) AS l FROM (SELECT doc_id, replace(data, '. ', ' .' || chr(13) || chr(10)) AS data FROM blobs)))")
def whitespace_errors(v):
    """White space errors of all kinds by line of every document, with sentences ended by carriage returns."""
    text = F.replace("data", F.lit(". "), F.lit(" .\r\n"))
    lines = v.blobs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line_no", (F.col("n") + 1).cast("long"))
    return X.whitespace_errors(lines, rules=X.WHITESPACE_RULES).select("doc_id", "line_no", "error")


@query("SELECT path FROM blobs WHERE regexp_full_match(path, 'src[^/]/(de|fr|es|en)/[0-9][^/]*5\\.txt') OR regexp_full_match(path, '.*/fr/[^/]*')")
def glob_paths(v):
    """Paths by globs with classes and folders."""
    return v.blobs.select("path").where(F.col("path").rlike(wildmatch("src?/*/[0-9]*5.txt")) | F.col("path").rlike(wildmatch("**/fr/*")))
