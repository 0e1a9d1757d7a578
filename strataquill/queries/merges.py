"""Queries that merge several snapshots, rewrite histories, read revision expressions and negotiate."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions.text import split_lines
from strataquill.operators import graph, merging, refs, rewriting
from strataquill.plans import revspec
from strataquill.queries import query
from strataquill.queries.graphs import _LAST, _PREV, _edges, _last, _node, _reach
from strataquill.streaming import transfers


class _Sides:
    """Every document as base (with a final line feed), ours (a line before it) and theirs (a line behind it); of those with ``clash``, every tenth, both sides end differently."""

    def __init__(self, v, clash: str = "doc_id % 10 = 0"):
        base = F.concat(F.col("data"), F.lit("\n"))
        clash = F.expr(clash)
        texts = {"base": base, "ours": F.when(clash, F.concat(base, F.lit("mine\n"))).otherwise(F.concat(F.lit("top\n"), base)), "theirs": F.when(clash, F.concat(base, F.lit("yours\n"))).otherwise(F.concat(base, F.lit("end\n")))}
        self.rows = v.blobs.select("path", "doc_id", *[t.alias(n) for n, t in texts.items()])
        stored = None
        for n in texts:
            part = self.rows.select(O.blob_id(F.col(n)).alias("oid"), F.col(n).alias("data"))
            stored = part if stored is None else stored.unionByName(part)
        self.blobs = stored.dropDuplicates(["oid"])

    def side(self, name: str, where: str = "true"):
        return self.rows.where(where).select("path", O.blob_id(F.col(name)).alias("oid"), F.lit(0o100644).alias("mode"))


def _oid(text: str) -> str:
    return f"sha1('blob ' || strlen({text}) || chr(0) || {text})"


_BASE = "(data || chr(10))"
_MERGED = f"('top' || chr(10) || {_BASE} || 'end' || chr(10))"
_CLASH = f"({_BASE} || '<<<<<<< ours' || chr(10) || 'mine' || chr(10) || '=======' || chr(10) || 'yours' || chr(10) || '>>>>>>> theirs' || chr(10))"


@query(f"SELECT path, {_oid(f'CASE WHEN doc_id % 10 = 0 THEN {_CLASH} ELSE {_MERGED} END')} AS oid, doc_id % 10 = 0 AS conflict FROM blobs")
def merged_files(v):
    """Snapshots that both sides edited, merged line by line, with conflict marks where their lines meet."""
    s = _Sides(v)
    return merging.merge_files(s.side("base"), s.side("ours"), s.side("theirs"), s.blobs)[0].select("path", "oid", "conflict")


@query(f"SELECT path, {_oid(f'''CASE WHEN doc_id % 10 = 0 THEN {_BASE} || 'mine' || chr(10) || 'yours' || chr(10) ELSE {_MERGED} END''')} AS oid, false AS conflict FROM blobs")
def union_merged_files(v):
    """The same with the driver that keeps both sides' lines."""
    s = _Sides(v)
    return merging.merge_files(s.side("base"), s.side("ours"), s.side("theirs"), s.blobs, driver="union")[0].select("path", "oid", "conflict")


@query(f"""
SELECT path, CASE WHEN doc_id % 10 = 0 THEN {_oid(_CLASH)} ELSE {_oid(_MERGED)} END AS oid, doc_id % 10 = 0 AS conflict FROM blobs WHERE doc_id % 3 <> 0
UNION ALL SELECT path, {_oid(f"CASE WHEN doc_id % 10 = 0 THEN {_CLASH} ELSE {_MERGED} END")}, doc_id % 10 = 0 FROM blobs WHERE doc_id % 3 = 0
""")
def recursively_merged_files(v):
    """A merge over two bases that hold overlapping parts of the snapshot; they are merged with each other first."""
    s = _Sides(v)
    return merging.recursive_merge([s.side("base", "doc_id % 3 <> 0"), s.side("base", "doc_id % 3 <> 1")], s.side("ours"), s.side("theirs"), s.blobs)[0].select("path", "oid", "conflict")


@query(f"SELECT path, {_oid(_MERGED)} AS oid FROM blobs UNION ALL SELECT 'third/' || path, {_oid(_BASE)} FROM blobs")
def octopus_merged_files(v):
    """Three heads merged one after another: two edits of every file, and a head that adds files."""
    s = _Sides(v, clash="false")
    base = s.side("base")
    third = base.unionByName(base.select(F.concat(F.lit("third/"), "path").alias("path"), "oid", "mode"))
    return merging.octopus_merge(base, [s.side("ours"), s.side("theirs"), third], s.blobs)[0].select("path", "oid")


@query("SELECT CAST(1 AS BIGINT) AS first_conflict, count(*) AS paths, count(*) FILTER (doc_id % 10 = 0) AS conflicts FROM blobs")
def octopus_conflict(v):
    """The head at which an octopus merge stops, with the paths that it stops at."""
    s = _Sides(v)
    merged, _, at = merging.octopus_merge(s.side("base"), [s.side("ours"), s.side("theirs"), s.side("base")], s.blobs)
    return merged.agg(F.lit(at).cast("long").alias("first_conflict"), F.count("*").alias("paths"), F.count_if("conflict").alias("conflicts"))


@query(f"SELECT path, {_oid(_MERGED)} AS oid FROM blobs WHERE doc_id % 10 > 0 AND doc_id % 7 > 0")
def replayed_series(v):
    """A series of two changes (an edit of every file, then deletions) applied onto another edit."""
    s, rest = _Sides(v), "doc_id % 10 > 0"
    theirs = s.side("theirs", rest)
    gone = s.side("theirs", "doc_id % 10 > 0 and doc_id % 7 > 0")
    onto = s.side("ours", rest)
    now, _, at = merging.replay(onto, [(s.side("base", rest), theirs)], s.blobs)
    kept = now.join(gone.select("path"), "path", "left_semi")
    return kept.select("path", "oid").where(F.lit(at is None))


# Negotiation ---------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_reach('a', _PREV)}, {_reach('b', 'SELECT node FROM branches')}, c AS (SELECT node FROM a WHERE node IN (SELECT node FROM b)) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM parents WHERE id IN (SELECT node FROM c))")
def negotiated_commits(v):
    """The newest commits that a receiver and the branches have in common."""
    return transfers.negotiate(v.parents, _last(v, 7), v.branches.select("node"))


@query("SELECT DISTINCT node AS oid FROM branches WHERE node NOT IN (SELECT id FROM commits WHERE message = 'click')")
def wanted_objects(v):
    """Targets of remote refs that a store lacks, peeled rows aside."""
    remote = v.branches.select(F.col("branch").alias("name"), F.col("node").alias("oid"))
    peeled = remote.select(F.concat("name", F.lit("^{}")).alias("name"), (-F.col("oid")).alias("oid"))
    return refs.wanted(remote.unionByName(peeled), v.commits.where("message = 'click'").select(F.col("commit").alias("oid")))


@query(f"WITH RECURSIVE {_reach('a', _LAST)} SELECT branch, node IN (SELECT node FROM a) AS forward FROM branches WHERE branch IN ('user1', 'user2')")
def fast_forwards(v):
    """Whether two branches can be moved to the newest commit without a merge."""
    out = None
    for name in ("user1", "user2"):
        one = graph.is_ancestor(v.parents, v.branches.where(F.col("branch") == name).select("node"), _last(v)).select(F.lit(name).alias("branch"), F.col("is_ancestor").alias("forward"))
        out = one if out is None else out.unionByName(one)
    return out.join(v.branches.select("branch"), "branch", "left_semi")


@query(f"WITH RECURSIVE {_reach('a', _LAST)}, {_reach('b', 'SELECT unnest([(SELECT max(event_id) - 7 FROM events)]) AS node')}, c AS (SELECT node FROM a WHERE node IN (SELECT node FROM b)), l AS (SELECT node FROM c WHERE node NOT IN (SELECT parent FROM parents WHERE id IN (SELECT node FROM c))), {_reach('d', 'SELECT max(event_id) - 12 AS node FROM events')}, {_reach('e', 'SELECT node FROM l')}, f AS (SELECT node FROM d WHERE node IN (SELECT node FROM e)) SELECT node FROM f WHERE node NOT IN (SELECT parent FROM parents WHERE id IN (SELECT node FROM f))")
def octopus_base_of_three(v):
    """Bases folded over three commits."""
    n = _last(v).first().node
    return graph.octopus_base(v.parents, [n, n - 7, n - 12])


@query("""
WITH RECURSIVE edges AS (SELECT 'c' || id AS src, 'c' || parent AS dst FROM parents UNION ALL SELECT 'c' || o_orderkey, 'r' FROM orders UNION ALL SELECT 'r', 'p' || p_partkey FROM part),
a AS (SELECT 'c' || node AS node FROM branches UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node) SELECT node FROM a
""")
def objects_of_all_branches(v):
    """Everything that any branch reaches: commits, trees and blobs."""
    return graph.reachable_objects(_edges(v), v.branches.select(F.concat(F.lit("c"), F.col("node").cast("string")).alias("node")))


@query("SELECT 'p' || p_partkey AS oid FROM part UNION ALL SELECT 'r' UNION ALL SELECT 'x' || o_orderkey FROM orders WHERE false")
def tree_and_blobs_sent(v):
    """What a receiver with the newest commit's history needs of one order's tree."""
    have = _node(v).limit(0)
    edges = _edges(v).where("src = 'r'")
    return graph.missing_objects(edges, have, v.spark.createDataFrame([("r",)], "node string")).select(F.col("node").alias("oid"))


# Revision expressions ------------------------------------------------------------------------------------------

_TIP = "(SELECT max(event_id) FROM events WHERE user_id = 1)"


@query(f"""
SELECT unnest(['user1', 'user1~1', 'user1~2', 'user1^1', 'refs/heads/user1~2^1', 'v1', '12^0', 'user1@{{0}}', 'user1@{{2}}']) AS spec,
  unnest([{_TIP}, {_TIP} // 2, {_TIP} // 4, {_TIP} // 2, {_TIP} // 8, 500, 12, {_TIP}, (SELECT event_id FROM events WHERE user_id = 1 ORDER BY event_id DESC LIMIT 1 OFFSET 2)]) AS oid
""")
def revision_expressions(v):
    """Refs, tags, parents, ancestors, peeled ids and log positions by expression."""
    heads = v.branches.select(F.concat(F.lit("refs/heads/"), "branch").alias("name"), F.col("node").alias("oid"))
    log = v.reflog.withColumn("ref", F.concat(F.lit("refs/heads/"), "ref"))
    repo = revspec.Repository(objects=v.commits.select(F.col("commit").alias("oid")), parents=v.parents, refs=heads.unionByName(v.tags.select("name", "oid")), reflog=log)
    specs = ["user1", "user1~1", "user1~2", "user1^1", "refs/heads/user1~2^1", "v1", "12^0", "user1@{0}", "user1@{2}"]
    return v.spark.createDataFrame([(s, revspec.resolve(repo, s)) for s in specs], "spec string, oid long")


@query(f"WITH RECURSIVE {_reach('a', _LAST)}, {_reach('b', f'SELECT {_TIP} AS node')} SELECT node FROM a WHERE node NOT IN (SELECT node FROM b)")
def commit_ranges(v):
    """Commits of a range between a branch and the newest commit."""
    heads = v.branches.select(F.concat(F.lit("refs/heads/"), "branch").alias("name"), F.col("node").alias("oid"))
    repo = revspec.Repository(objects=v.commits.select(F.col("commit").alias("oid")), parents=v.parents, refs=heads)
    return revspec.commit_range(repo, f"user1..{_last(v).first().node}")


@query("SELECT path[8:] AS path, oid FROM flat WHERE depth = 4 AND path LIKE 'EUROPE/%'")
def tree_of_expression(v):
    """Files below the tree that ``commit:path`` names."""
    entries = v.tree_entries
    repo = revspec.Repository(objects=v.spark.createDataFrame([("abcd1",)], "oid string"), parents=v.spark.createDataFrame([], "commit string, parent_no int, parent string"), refs=v.spark.createDataFrame([("refs/heads/main", "abcd1")], "name string, oid string"), commits=v.spark.createDataFrame([("abcd1", "root")], "commit string, tree string"), tree_entries=entries)
    from strataquill.operators import trees

    found = revspec.resolve(repo, "main:EUROPE")
    return trees.flatten(entries, v.spark.createDataFrame([(found,)], "root string")).select("path", "oid")


# Rewritten histories -------------------------------------------------------------------------------------------

_TEXT = "'tree ' || sha1('t' || k) || chr(10) || {parent} || 'author ' || author || chr(10) || 'committer ' || author || chr(10) || chr(10) || message"


def _chains(v):
    """(commits, parents): each user's first twelve events as a chain of commits named user-number."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("author").orderBy("commit"))
    e = v.commits.select("author", k.alias("k"), "message").where("k <= 12")
    name = lambda n: F.concat("author", F.lit("-"), n.cast("string"))
    who = F.concat("author", F.lit(" <a@x.org> 1 +0000"))
    commits = e.select(name(F.col("k")).alias("commit"), F.sha1(F.concat(F.lit("t"), F.col("k").cast("string"))).alias("tree"), who.alias("author"), who.alias("committer"), F.col("message"))
    parents = e.where("k > 1").select(name(F.col("k")).alias("commit"), F.lit(1).alias("parent_no"), name(F.col("k") - 1).alias("parent"))
    return commits, parents


_CHAIN = "e AS (SELECT author AS u, author || ' <a@x.org> 1 +0000' AS author, message, row_number() OVER (PARTITION BY author ORDER BY id) AS k FROM commits QUALIFY k <= 12)"


def _commit_sql(parent: str) -> str:
    text = _TEXT.format(parent=parent)
    return f"sha1('commit ' || strlen({text}) || chr(0) || {text})"


@query(f"""
WITH RECURSIVE {_CHAIN}, r AS (SELECT u, k, {_commit_sql("''")} AS new FROM e WHERE k = 1
  UNION ALL SELECT e.u, e.k, {_commit_sql("'parent ' || r.new || chr(10)").replace(' k)', ' e.k)')} FROM r JOIN e ON e.u = r.u AND e.k = r.k + 1)
SELECT u || '-' || k AS commit_id, new FROM r
""".replace("|| k)", "|| e.k)").replace("'t' || e.k) || chr(10) || '' ", "'t' || k) || chr(10) || '' "))
def rewritten_commits(v):
    """New ids of chains of commits, each hashed over its parent's new id."""
    commits, parents = _chains(v)
    return rewriting.rewrite(commits, parents).select(F.col("commit").alias("commit_id"), "new")


@query(f"""
WITH RECURSIVE {_CHAIN.replace('QUALIFY k <= 12)', 'QUALIFY k <= 12), d AS (SELECT u, author, message, k, row_number() OVER (PARTITION BY u ORDER BY k) AS n FROM e WHERE k % 3 <> 0)')},
r AS (SELECT u, k, n, {_commit_sql("''")} AS new FROM d WHERE n = 1 UNION ALL SELECT d.u, d.k, d.n, {_commit_sql("'parent ' || r.new || chr(10)")} FROM r JOIN d ON d.u = r.u AND d.n = r.n + 1)
SELECT u || '-' || k AS commit_id, new FROM r
""".replace("|| k)", "|| d.k)"))
def commits_without_dropped(v):
    """The same chains without every third commit: its child gets its parent."""
    commits, parents = _chains(v)
    drop = F.substring_index("commit", "-", -1).cast("int") % 3 == 0
    return rewriting.rewrite(commits, parents, drop=drop).select(F.col("commit").alias("commit_id"), "new")


@query("SELECT 'c' || doc_id AS commit_id, lang AS dir, sha1(CAST(doc_id AS VARCHAR)) AS split FROM documents")
def subtree_trailers(v):
    """Subtree folders and splits that messages name."""
    message = F.concat(F.lit("Merge\n\nbody\n\ngit-subtree-dir: "), F.col("lang"), F.lit("\ngit-subtree-split: "), F.sha1(F.col("doc_id").cast("string")), F.lit("\n"))
    rows = v.table("documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("commit"), message.alias("message"))
    return rewriting.subtree_metadata(rows).select(F.col("commit").alias("commit_id"), "dir", "split")


@query("SELECT doc_id, printf('%04d-%s.patch', doc_id, replace(split_part(path, '/', 1), ' ', '-')) AS file_name, path AS author, split_part(path, '/', 1) AS subject, 'body of ' || path || chr(10) AS body FROM blobs")
def mailed_patches(v):
    """Every document as a mailed patch, and the parts of the mail read from it."""
    from strataquill.sources import lines

    rows = v.blobs.select(F.col("doc_id").alias("number"), "oid", F.concat("path", F.lit(" <a@x.org>")).alias("author"), F.lit(86400).cast("long").alias("time"), F.lit(3600).alias("offset"), F.concat(F.substring_index("path", "/", 1), F.lit("\n\nbody of "), F.col("path"), F.lit("\n")).alias("message"), F.lit("diff --git a/x b/x\n").alias("patch"))
    mails = rewriting.patch_mails(rows)
    read = lines.mail_columns(mails.select("number", "file_name", F.regexp_replace("mail", r"^From [^\n]*\n", "").alias("message")))
    return read.select(F.col("number").alias("doc_id"), "file_name", "author", "subject", "body")


@query("SELECT path, n AS line_no, line, CASE WHEN n = 1 THEN 'second' WHEN n = c THEN 'third' ELSE 'first' END AS commit_id FROM (SELECT path, c, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT path, l, len(l) AS c FROM (SELECT path, regexp_extract_all('top' || chr(10) || data || chr(10) || 'end' || chr(10), '[^\\n]*\\n') AS l FROM blobs WHERE NOT contains(chr(10) || data || chr(10), chr(10) || 'top' || chr(10)))))")
def annotated_lines(v):
    """Every line of three versions of every document with the version that brought it."""
    from strataquill.operators import history

    base = F.concat("data", F.lit("\n"))
    b = v.blobs.where("not contains(concat('\\n', data, '\\n'), '\\ntop\\n')")
    revs = [b.select("path", F.lit(i).alias("position"), F.lit(c).alias("commit"), t.alias("data")) for i, (c, t) in enumerate((("first", base), ("second", F.concat(F.lit("top\n"), base)), ("third", F.concat(F.lit("top\n"), base, F.lit("end\n")))))]
    found = history.annotate(revs[0].unionByName(revs[1]).unionByName(revs[2]))
    return found.select("path", "line_no", "line", F.col("commit").alias("commit_id"))


@query("SELECT path, len(regexp_extract_all(data, '[^\\n]*\\n|[^\\n]+')) AS lines, CAST(1 AS BIGINT) AS files FROM blobs")
def documents_by_lines(v):
    """Lines of each file of a snapshot read through its ids."""
    flat = v.snapshot("base").join(v.blobs.select("oid", "data").dropDuplicates(["oid"]), "oid")
    return flat.select("path", F.size(split_lines(F.col("data"))).cast("long").alias("lines"), F.lit(1).cast("long").alias("files"))
