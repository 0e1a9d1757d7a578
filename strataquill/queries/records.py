"""Queries over the texts of commits, tags and trees, over identities, names and trailers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions import people, records
from strataquill.functions import refs as R
from strataquill.functions import text as X
from strataquill.operators import fsck, graph, history, rewriting, similarity, trees
from strataquill.queries import query
from strataquill.streaming import logs
from strataquill.streaming.runs import drain

_COMMIT = "'tree ' || sha1('t' || id) || chr(10) || coalesce((SELECT string_agg('parent ' || sha1(CAST(parent AS VARCHAR)) || chr(10), '' ORDER BY parent_no) FROM parents p WHERE p.id = c.id), '') || 'author ' || author || ' <a@x.org> ' || commit_time || ' +0130' || chr(10) || 'committer ' || author || ' <c@x.org> ' || commit_time || ' -0500' || chr(10) || chr(10) || message"


@query(f"""
WITH x AS (SELECT id, author, commit_time, message, {_COMMIT} AS t FROM commits c)
SELECT sha1('commit ' || strlen(t) || chr(0) || t) AS oid, sha1('t' || id) AS tree, (SELECT count(*) FROM parents p WHERE p.id = x.id) AS parents, author || ' <a@x.org>' AS author, CAST(5400 AS INTEGER) AS author_offset, author || ' <c@x.org>' AS committer, commit_time, message FROM x
""")
def commit_records(v):
    """Every event as a commit's text: its id, and the fields parsed from it."""
    up = v.parents.groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("parent_no", F.sha1(F.col("parent").cast("string")).alias("p")))).alias("ps"))
    e = v.commits.join(up, "commit", "left")
    parents = F.coalesce(F.transform("ps", lambda x: x["p"]), F.array().cast("array<string>"))
    who = lambda mail, zone: people.format_time_entry(F.concat("author", F.lit(f" <{mail}@x.org>")), F.col("commit_time"), F.lit(zone))
    text = rewriting.commit_text(F.sha1(F.concat(F.lit("t"), F.col("commit").cast("string"))), parents, who("a", 5400), who("c", -18000), F.col("message"))
    rows = e.select(text.alias("t")).select(O.object_id("commit", F.col("t")).alias("oid"), records.commit_columns(F.col("t")).alias("c"))
    return rows.select("oid", "c.tree", F.size("c.parents").cast("long").alias("parents"), F.col("c.author.person").alias("author"), F.col("c.author.offset").alias("author_offset"), F.col("c.committer.person").alias("committer"), F.col("c.committer.time").alias("commit_time"), "c.message")


@query("""
SELECT sha1(CAST(oid AS VARCHAR)) AS object, 'commit' AS type, name[11:] AS name, 'T <t@x.org>' AS tagger, 'about ' || name || chr(10) AS message, CASE WHEN oid % 1000 = 0 THEN '-----BEGIN PGP SIGNATURE-----' || chr(10) || 'abc' || chr(10) || '-----END PGP SIGNATURE-----' || chr(10) END AS signature FROM tags
""")
def tag_records(v):
    """Every tag's text with, for some, a signature; parsed again."""
    sign = F.when(F.col("oid") % 1000 == 0, "-----BEGIN PGP SIGNATURE-----\nabc\n-----END PGP SIGNATURE-----\n").otherwise("")
    text = F.concat(F.lit("object "), F.sha1(F.col("oid").cast("string")), F.lit("\ntype commit\ntag "), F.substr("name", F.lit(11)), F.lit("\ntagger T <t@x.org> 5 +0000\n\nabout "), F.col("name"), F.lit("\n"), sign)
    t = v.tags.select(records.tag_columns(text).alias("t"))
    return t.select("t.object", "t.type", "t.name", F.col("t.tagger.person").alias("tagger"), "t.message", "t.signature")


_TREE = "sha1(encode('tree ' || octet_length(raw)) || '\\x00'::BLOB || raw)"
_RAW = "list_reduce(list(encode(printf('%o ', m) || name) || '\\x00'::BLOB || unhex(oid) ORDER BY k), lambda a, b: a || b)"


@query(f"""
WITH f AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name, 33188 AS m, oid, encode(regexp_extract(path, '([^/]*)$', 1)) AS k FROM base),
l AS (SELECT folder, {_RAW} AS raw, count(*) AS n FROM f GROUP BY folder), lt AS (SELECT folder AS path, {_TREE} AS oid, n FROM l),
m AS (SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name, 16384 AS m, oid, encode(split_part(path, '/', 2) || '/') AS k FROM lt),
s AS (SELECT folder, {_RAW} AS raw, count(*) AS n FROM m GROUP BY folder), st AS (SELECT folder AS path, {_TREE} AS oid, n FROM s),
r AS (SELECT {_RAW.replace('name', 'path')} AS raw, count(*) AS n FROM (SELECT path, 16384 AS m, oid, encode(path || '/') AS k FROM st))
SELECT path, oid, n AS n_entries FROM lt UNION ALL SELECT path, oid, n FROM st UNION ALL SELECT '', {_TREE}, n FROM r
""")
def built_trees(v):
    """Ids of all folders' tree objects, built from the files up."""
    return trees.build_trees(v.snapshot("base")).select("path", "oid", F.size("entries").cast("long").alias("n_entries"))


@query("SELECT path, CASE WHEN doc_id % 10 = 4 THEN 57344 ELSE 33188 END AS mode, doc_id % 10 = 4 AS submodule FROM blobs WHERE doc_id % 10 IN (3, 4)")
def submodule_rows(v):
    """Entries with a submodule's mode among files, and what submodules() keeps of them."""
    rows = v.blobs.where("doc_id % 10 in (3, 4)").select("path", F.when(F.col("doc_id") % 10 == 4, 0o160000).otherwise(0o100644).alias("mode"))
    kept = trees.submodules(rows).select("path", F.lit(True).alias("submodule"))
    return rows.join(kept, "path", "left").select("path", "mode", F.coalesce("submodule", F.lit(False)).alias("submodule"))


@query("SELECT id AS commit_id, parent_no, parent FROM parents WHERE id % 7 <> 0 AND id % 11 <> 0 UNION ALL SELECT id, 1, id - 1 FROM commits WHERE id % 11 = 0")
def grafted_parents(v):
    """Parents under grafts (every eleventh commit) and shallow cuts (every seventh)."""
    at = lambda n: v.commits.where(F.col("commit") % n == 0).select("commit")
    grafts = at(11).select("commit", F.lit(1).alias("parent_no"), (F.col("commit") - 1).alias("parent"))
    return graph.effective_parents(v.parents, grafts, at(7)).select(F.col("commit").alias("commit_id"), "parent_no", "parent")


# Identities, names, trailers -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'Clerk ' || o_custkey || ' <c@x>' AS person, CAST(86400 * (o_orderkey % 9) AS BIGINT) AS time, CASE WHEN o_orderkey % 3 = 2 THEN -5400 ELSE 5400 END AS t FROM orders")
def lenient_time_entries(v):
    """Time entries without a closing bracket or sign, or with several signs."""
    k = F.col("o_orderkey")
    who, time = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"), F.lit(" <c@x")), (86400 * (k % 9)).cast("string")
    line = F.when(k % 3 == 0, F.concat(who, F.lit("> "), time, F.lit(" +0130"))).when(k % 3 == 1, F.concat(who, F.lit(" "), time, F.lit(" 0130"))).otherwise(F.concat(who, F.lit(">  "), time, F.lit(" --0130")))
    e = v.table("orders").select("o_orderkey", people.parse_time_entry(line, broken=True).alias("e"))
    return e.select("o_orderkey", F.col("e.person").alias("person"), F.col("e.time").alias("time"), F.col("e.offset").alias("t"))


@query("SELECT c_custkey, c_name AS name, lower(c_mktsegment) || '@x.org' AS email FROM customer")
def split_emails(v):
    """Names and addresses of every customer's identity."""
    text = F.concat("c_name", F.lit(" <"), F.lower("c_mktsegment"), F.lit("@x.org>"))
    return v.table("customer").select("c_custkey", people.split_email(text).alias("e")).select("c_custkey", "e.name", "e.email")


@query("""
SELECT k AS c_custkey, n AS name, n NOT LIKE 'refs/%' OR n LIKE 'refs/bisect/%' AS own, CASE WHEN n LIKE 'refs/heads/%' THEN n ELSE 'refs/heads/' || n END AS local_name, CASE WHEN n LIKE 'refs/tags/%' THEN n[11:] END AS tag, CASE WHEN k % 2 = 0 THEN n END AS target, n LIKE 'refs/heads/%' OR n LIKE 'refs/tags/%' AS shared
FROM (SELECT c_custkey AS k, ['refs/heads/a', 'refs/tags/b', 'refs/bisect/c', 'HEAD'][c_custkey % 4 + 1] || c_custkey AS n FROM customer)
""")
def ref_kinds(v):
    """Kinds, local names, tags and symbolic targets of names of refs."""
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("refs/heads/a", "refs/tags/b", "refs/bisect/c", "HEAD")]), (k % 4 + 1).cast("int")), k.cast("string"))
    rows = v.table("customer").select("c_custkey", name.alias("name"))
    n = F.col("name")
    link = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ref: "), n, F.lit("  "))).otherwise(n)
    return rows.select("c_custkey", "name", R.is_per_worktree_ref(n).alias("own"), R.local_branch_name(n).alias("local_name"), R.extract_tag_name(n).alias("tag"), R.parse_symref_value(link).alias("target"), R.under_any(n, ["refs/heads/", "refs/tags/"]).alias("shared"))


_NL = "chr(10)"


@query(f"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN m || {_NL} || 'Signed: ' || c_name || {_NL} || 'Key: v' || {_NL} WHEN 1 THEN m || {_NL} || 'Key: v' || {_NL} WHEN 2 THEN m || {_NL} || 'Key: old' || {_NL} || 'Key: v' || {_NL}
  ELSE m || {_NL} || 'Signed: ' || c_name || {_NL} || 'Key: v' || {_NL} || '---' || {_NL} || ' file | 1 +' || {_NL} END AS message FROM (SELECT c_custkey, c_name, 'Subject' || {_NL} || {_NL} || 'Body.' || {_NL} AS m FROM customer)
""")
def added_trailers(v):
    """Messages with a trailer added: behind others, to one without any, beside one of its key, and before a line of dashes."""
    m = F.lit("Subject\n\nBody.\n")
    signed = F.concat(m, F.lit("\nSigned: "), F.col("c_name"), F.lit("\n"))
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, signed).when(k == 1, m).when(k == 2, F.concat(m, F.lit("\nKey: old\n"))).otherwise(F.concat(signed, F.lit("---\n file | 1 +\n")))
    return v.table("customer").select("c_custkey", X.add_trailer(text, "Key", "v").alias("message"))


@query("SELECT c_custkey, 'Reviewed-by' AS key, c_name || ' and ' || c_mktsegment AS value, 'Signed-off-by' AS last_key, CAST(2 AS BIGINT) AS n FROM customer")
def trailer_blocks(v):
    """Two trailers with a folded line, behind a body and before a patch."""
    message = F.concat(F.lit("Subject\n\nBody: no trailer here.\nMore.\n\nReviewed-by: "), F.col("c_name"), F.lit("\n  and "), F.col("c_mktsegment"), F.lit("\nSigned-off-by: x\n---\n 1 file changed\n"))
    p = v.table("customer").select("c_custkey", X.parse_trailers(message).alias("p"))
    return p.select("c_custkey", F.element_at("p.trailers", 1)["key"].alias("key"), F.element_at("p.trailers", 1)["value"].alias("value"), F.element_at("p.trailers", -1)["key"].alias("last_key"), F.size("p.trailers").cast("long").alias("n"))


@query("SELECT doc_id, sha1(regexp_replace(regexp_replace(replace(data, '. ', ' .' || chr(13) || chr(10)), '\\r(\\n|$)', '\\1', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')) AS fixed_sha1 FROM blobs WHERE NOT contains(data, chr(9))")
def fixed_whitespace(v):
    """Every document without white space errors at the ends of its lines."""
    text = F.replace("data", F.lit(". "), F.lit(" .\r\n"))
    return v.blobs.where("not contains(data, '\\t')").select("doc_id", F.sha1(X.fix_whitespace(text)).alias("fixed_sha1"))


@query("SELECT doc_id, sha1('<<<<<<<' || chr(10) || least(oid, path) || chr(10) || '=======' || chr(10) || greatest(oid, path) || chr(10) || '>>>>>>>' || chr(10)) AS id, true AS same FROM blobs")
def conflict_ids(v):
    """Ids of conflicts, alike for both orders of their sides and for other labels of their markers."""
    one = F.concat(F.lit("<<<<<<< a\n"), F.col("oid"), F.lit("\n=======\n"), F.col("path"), F.lit("\n>>>>>>> b\n"))
    two = F.concat(F.lit("<<<<<<< x\n"), F.col("path"), F.lit("\n=======\n"), F.col("oid"), F.lit("\n>>>>>>> y\n"))
    return v.blobs.select("doc_id", X.conflict_id(one).alias("id"), X.conflict_id(two).alias("other")).select("doc_id", "id", (F.col("id") == F.col("other")).alias("same"))


# Renames, statistics, checks -----------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT path, oid, mode, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM moved m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = m.path)),
d AS (SELECT path, oid, row_number() OVER (PARTITION BY oid ORDER BY path) AS n FROM base b WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE b.path = m.path)),
r AS (SELECT 'rename' AS change_type, d.path AS old_path, a.path AS new_path FROM a JOIN d ON a.oid = d.oid AND a.n = d.n),
x AS (SELECT * FROM r UNION ALL SELECT 'copy', d.path, a.path FROM a JOIN d ON a.oid = d.oid AND d.n = 1 WHERE a.path NOT IN (SELECT new_path FROM r))
SELECT * FROM x UNION ALL SELECT 'add', NULL, path FROM a WHERE path NOT IN (SELECT new_path FROM x)
""")
def detected_renames(v):
    """All changes between two snapshots with exact renames and copies found by the whole detector; no deletion is left for contents to match."""
    found = similarity.RenameDetector().detect(v.snapshot("base"), v.moved(), v.blobs.select("oid", "data"))
    return found.select("change_type", "old_path", "new_path")


@query("SELECT 'modify' AS change_type, path AS old_path, path AS new_path FROM blobs WHERE doc_id % 10 = 2")
def rewritten_files(v):
    """Files with wholly new contents: split into deletion and addition for the search, and joined again as nothing else matches."""
    other = F.concat(F.lit("wholly other "), F.sha1("path"))
    edited = F.col("doc_id") % 10 == 2
    new = v.blobs.select("path", O.blob_id(F.when(edited, other).otherwise(F.col("data"))).alias("oid"), F.lit(0o100644).alias("mode"))
    blobs = v.blobs.select("oid", "data").unionByName(v.blobs.where(edited).select(O.blob_id(other).alias("oid"), other.alias("data"))).dropDuplicates(["oid"])
    return similarity.RenameDetector(rewrite_threshold=50).detect(v.snapshot("base"), new, blobs).select("change_type", "old_path", "new_path")


@query("""
WITH s AS (SELECT o_orderkey, count(*) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), m AS (SELECT max(added + deleted) AS most FROM s)
SELECT 'o' || o_orderkey AS path, repeat('+', CAST(CASE WHEN most <= 20 THEN added ELSE ceil(added * 20 / most) END AS INTEGER)) || repeat('-', CAST(CASE WHEN most <= 20 THEN deleted ELSE ceil(deleted * 20 / most) END AS INTEGER)) AS bar FROM s, m
""")
def diffstat_bars(v):
    """Histograms of additions and deletions by file, scaled to the largest."""
    s = v.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))
    s = s.join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), "added", "deleted")
    return history.diffstat_bars(s, 20).select("path", "bar")


@query("SELECT id AS oid, 'missing ' || parent AS problem FROM parents WHERE parent % 13 = 0")
def dangling_links(v):
    """Links to objects that a store lacks."""
    known = v.commits.where("commit % 13 <> 0").select(F.col("commit").alias("oid"))
    return fsck.links(v.parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")), known)


@query("SELECT commit_time // 86400 * 86400 AS start, author AS ref, count(*) AS moves FROM commits WHERE commit_time // 86400 * 86400 + 86400 <= (SELECT max(commit_time) FROM commits) - 86400 GROUP BY ALL")
def streamed_closed_days(v):
    """Updates of every branch by day in append mode: only days that the watermark has passed are given out."""
    from strataquill.queries.streams import _log

    found = drain(logs.moves_per_window(_log(v)), mode="append")
    return found.select(F.unix_seconds("start").alias("start"), "ref", "moves")
