"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import dates, people
from strataquill.functions import objects as O
from strataquill.functions import refs as R
from strataquill.functions import text as X
from strataquill.operators import store
from strataquill.queries import query


@query("SELECT doc_id, oid, sha256('blob ' || size || chr(0) || data) AS oid256, 'objects/' || oid[1:2] || '/' || oid[3:] AS loose, oid[1:2] || '/' || oid[3:4] || '/' || oid[5:] AS note FROM blobs")
def object_ids(v):
    """Ids of every document as a blob, and the paths that follow from them."""
    o = F.col("oid")
    return v.blobs.select("doc_id", "oid", O.blob_id(F.col("data"), "sha256").alias("oid256"), O.hex_to_filename(o).alias("loose"), O.note_path(o, 2).alias("note"))


@query("SELECT doc_id, NOT contains(data, chr(0)) AS is_text, true AS valid, length(oid) AS width, CAST(octet_length(unhex(oid)) AS BIGINT) AS raw FROM blobs")
def object_checks(v):
    """Binary content, valid ids, and widths of ids."""
    o = F.col("oid")
    return v.blobs.select("doc_id", (~O.is_binary(F.col("data"))).alias("is_text"), O.valid_hexsha(o).alias("valid"), F.length(O.sha_to_hex(O.hex_to_sha(o))).cast("long").alias("width"), F.octet_length(O.hex_to_sha(o)).cast("long").alias("raw"))


@query("SELECT o_orderkey, t, CASE WHEN t < 0 OR (t = 0 AND o_orderkey % 2 = 1) THEN '-' ELSE '+' END || lpad(CAST(abs(t) // 3600 AS VARCHAR), 2, '0') || lpad(CAST(abs(t) // 60 % 60 AS VARCHAR), 2, '0') AS zone, CAST(o_orderkey * 86400 AS BIGINT) AS time, 'Clerk ' || o_custkey AS name, o_custkey || '@x.org' AS email FROM (SELECT *, CAST((o_orderkey % 27 - 12) * 1800 AS BIGINT) AS t FROM orders)")
def time_entries(v):
    """Time entries of orders, written and parsed again."""
    off = ((F.col("o_orderkey") % 27 - 12) * 1800).cast("int")
    neg = F.col("o_orderkey") % 2 == 1
    c = F.col("o_custkey").cast("string")
    line = people.format_time_entry(F.concat(F.lit("Clerk "), c, F.lit(" <"), c, F.lit("@x.org>")), F.col("o_orderkey") * 86400, off, neg)
    p = v.table("orders").select("o_orderkey", line.alias("line")).select("o_orderkey", people.parse_time_entry(F.col("line")).alias("e"))
    who = people.parse_identity(F.col("e.person"))
    return p.select("o_orderkey", F.col("e.offset").cast("long").alias("t"), people.format_timezone(F.col("e.offset"), F.col("e.negative_utc")).alias("zone"), F.col("e.time").alias("time"), who["name"].alias("name"), who["email"].alias("email"))


@query("SELECT p_partkey, lpad(CASE p_partkey % 4 WHEN 0 THEN '100644' WHEN 1 THEN '100755' WHEN 2 THEN '120000' ELSE '160000' END, 6, '0') || ' ' || CASE p_partkey % 4 WHEN 3 THEN 'commit' ELSE 'blob' END || ' ' || repeat('a', 40) || chr(9) || p_name AS row_text FROM part")
def listed_entries(v):
    """Rows of a tree listing with cleaned modes."""
    r = F.col("p_partkey") % 4
    mode = F.when(r == 0, 0o100600).when(r == 1, 0o100711).when(r == 2, 0o120777).otherwise(0o160000)
    return v.table("part").select("p_partkey", O.pretty_entry(F.col("p_name"), O.cleanup_mode(mode), F.lit("a" * 40)).alias("row_text"))


@query("SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, split_part(path, '/', 3) AS base, CAST(2 AS BIGINT) AS depth FROM blobs")
def split_paths(v):
    """Folder, name and depth of every document's path."""
    p = F.col("path")
    return v.blobs.select("path", O.dirname(p).alias("folder"), O.basename(p).alias("base"), O.path_depth(p).cast("long").alias("depth"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'b' || c_custkey WHEN 1 THEN 'v' || c_custkey ELSE 'x..' || c_custkey END AS short, c_custkey % 3 <> 2 AS valid, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey END AS branch FROM customer")
def ref_names(v):
    """Checks and short forms of names of refs."""
    k = F.col("c_custkey").cast("string")
    r = F.col("c_custkey") % 3
    name = F.when(r == 0, F.concat(F.lit("refs/heads/b"), k)).when(r == 1, F.concat(F.lit("refs/tags/v"), k)).otherwise(F.concat(F.lit("refs/heads/x.."), k))
    out = v.table("customer").select("c_custkey", name.alias("n"))
    n = F.col("n")
    return out.select("c_custkey", R.shorten_ref_name(n).alias("short"), R.check_ref_format(n).alias("valid"), F.when(F.col("c_custkey") % 3 == 0, R.extract_branch_name(n)).alias("branch"))


@query("SELECT path, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(path, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: ((h >> 2) + (c << 24)) % 4294967296) AS hash FROM blobs")
def name_hashes(v):
    """Hash of every path by its last characters."""
    return v.blobs.select("path", O.name_hash(F.col("path")).alias("hash"))


@query("SELECT doc_id, length(replace(data, chr(10), chr(13) || chr(10))) AS crlf_chars, sha1(data) AS back FROM blobs")
def line_endings(v):
    """Line feeds as carriage returns and line feeds, and back."""
    crlf = X.lf_to_crlf(F.col("data"))
    return v.blobs.select("doc_id", F.length(crlf).cast("long").alias("crlf_chars"), F.sha1(X.crlf_to_lf(crlf)).alias("back"))


@query("SELECT doc_id, sha1(CASE WHEN c = '' THEN '' ELSE c || chr(10) END) AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(data, '[ \\t\\r\\x0b\\x0c]+(\\n|$)', '\\1', 'g'), '^\\n+|\\n+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS c FROM blobs)")
def stripped_texts(v):
    """Every document without surplus white space."""
    return v.blobs.select("doc_id", F.sha1(X.strip_space(F.col("data"))).alias("clean"))


@query("SELECT doc_id, replace(split_part(data, chr(10), 1), ' ', '-') AS slug FROM blobs")
def summary_slugs(v):
    """First lines as parts of file names."""
    return v.blobs.select("doc_id", X.summary_slug(F.col("data")).alias("slug"))


@query("SELECT doc_id, CASE WHEN size >= 2000 THEN 'version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || sha256(data) || chr(10) || 'size ' || size || chr(10) ELSE data END AS stored, CASE WHEN size >= 2000 THEN size END AS pointed FROM blobs")
def large_file_pointers(v):
    """Large documents as pointers, and the sizes that the pointers name."""
    c = store.clean(v.blobs.select(F.col("doc_id").alias("path"), "data"), 2000)
    return c.select(F.col("path").alias("doc_id"), F.col("data").alias("stored"), O.lfs_pointer(F.col("data"))["size"].alias("pointed"))


@query("SELECT doc_id, sha1(data) AS back FROM blobs")
def large_file_round_trip(v):
    """Documents cleaned to pointers and smudged back."""
    c = store.clean(v.blobs.select(F.col("doc_id").alias("path"), "data"), 2000)
    large = v.blobs.select(F.sha2("data", 256).alias("oid"), F.col("data").alias("content")).dropDuplicates(["oid"])
    return store.smudge(c, large).select(F.col("path").alias("doc_id"), F.sha1("data").alias("back"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 WHEN 5 THEN 2592000 ELSE 31536000 END * (event_id % 50) AS back FROM events")
def relative_dates(v):
    """Seconds of relative dates."""
    units = F.array(*[F.lit(u) for u in ("second", "minutes", "hours", "day", "weeks", "month", "years")])
    text = F.concat_ws(" ", (F.col("event_id") % 50).cast("string"), F.get(units, (F.col("event_id") % 7).cast("int")), F.lit("ago"))
    return v.table("events").select("event_id", dates.relative_seconds(text).alias("back"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9-]', '-', 'g') AS key, c_mktsegment AS value FROM customer")
def trailers(v):
    """Trailers put into messages and parsed again."""
    message = F.concat(F.lit("Subject\n\nBody of the text.\n\n"), F.regexp_replace("c_name", "[^A-Za-z0-9-]", "-"), F.lit(": "), F.col("c_mktsegment"), F.lit("\n"))
    p = v.table("customer").select("c_custkey", "c_name", X.parse_trailers(message).alias("p"))
    t = F.element_at("p.trailers", 1)
    return p.select("c_custkey", t["key"].alias("key"), t["value"].alias("value"))
