"""Queries over the commit graph, refs, reflogs and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquill.functions import objects as O
from strataquill.functions.text import split_lines
from strataquill.operators import bitmaps, fsck, graph, history, refs
from strataquill.plans.closure import closure
from strataquill.queries import query

_ANC = "anc AS (SELECT node AS s, node FROM branches UNION SELECT a.s, p.parent FROM anc a JOIN parents p ON p.id = a.node)"


def _reach(name: str, seeds: str) -> str:
    return f"{name} AS ({seeds} UNION SELECT p.parent FROM {name} a JOIN parents p ON p.id = a.node)"


_LAST = "SELECT max(event_id) AS node FROM events"
_PREV = "SELECT max(event_id) - 7 AS node FROM events"


def _last(v, back: int = 0):
    return v.table("events").agg((F.max("event_id") - back).alias("node"))


@query(f"WITH RECURSIVE {_ANC} SELECT branch, CAST(count(*) AS BIGINT) AS n, CAST(sum(a.node) AS BIGINT) AS total FROM branches b JOIN anc a ON a.s = b.node GROUP BY branch")
def branch_ancestors(v):
    """Number and sum of the ancestors of every branch."""
    reach = graph.ancestors_by(v.parents, v.branches, "branch")
    return reach.groupBy("branch").agg(F.count("*").alias("n"), F.sum("node").alias("total"))


@query(f"WITH RECURSIVE {_reach('a', _LAST)} SELECT node, id IS NOT NULL AS known FROM a LEFT JOIN commits ON id = node")
def walk_include(v):
    """All ancestors of the newest commit."""
    found = graph.walk(v.parents, _last(v))
    return found.join(v.commits.select(F.col("commit").alias("node"), F.lit(True).alias("known")), "node", "left").select("node", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH RECURSIVE {_reach('a', 'SELECT node FROM branches')}, {_reach('b', _PREV)} SELECT node FROM a WHERE node NOT IN (SELECT node FROM b)")
def walk_exclude(v):
    """Commits of all branches that are not behind one commit."""
    return graph.walk(v.parents, v.branches.select("node"), _last(v, 7))


@query("""
WITH RECURSIVE g AS (SELECT id, 1 AS d FROM commits WHERE id NOT IN (SELECT id FROM parents) UNION SELECT p.id, g.d + 1 FROM g JOIN parents p ON p.parent = g.id)
SELECT id AS commit_id, CAST(max(d) AS BIGINT) AS generation FROM g GROUP BY id
""")
def generation_numbers(v):
    """Generation of every commit."""
    return graph.generations(v.commits, v.parents).select(F.col("commit").alias("commit_id"), F.col("generation").cast("long").alias("generation"))


@query("""
WITH RECURSIVE g AS (SELECT id, 1 AS d FROM commits WHERE id NOT IN (SELECT id FROM parents) UNION SELECT p.id, g.d + 1 FROM g JOIN parents p ON p.parent = g.id), x AS (SELECT id, max(d) AS d FROM g GROUP BY id)
SELECT c.id AS commit_id, row_number() OVER (ORDER BY d DESC, commit_time DESC, c.id) AS position FROM commits c JOIN x ON x.id = c.id
""")
def topological_order(v):
    """Every commit's place in an order without a parent before its child."""
    return graph.topological(v.commits, v.parents).select(F.col("commit").alias("commit_id"), F.col("position").cast("long").alias("position"))


@query(f"WITH RECURSIVE {_reach('a', _LAST)}, {_reach('b', _PREV)}, c AS (SELECT node FROM a WHERE node IN (SELECT node FROM b)) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM parents WHERE id IN (SELECT node FROM c))")
def lowest_common_ancestors(v):
    """Lowest common ancestors of two commits."""
    return graph.lowest_common(v.parents, _last(v), _last(v, 7))


@query(f"WITH RECURSIVE {_reach('a', _LAST)}, {_reach('b', 'SELECT unnest([(SELECT max(event_id) - 7 FROM events), (SELECT max(event_id) - 12 FROM events)]) AS node')}, c AS (SELECT node FROM a WHERE node IN (SELECT node FROM b)) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM parents WHERE id IN (SELECT node FROM c))")
def merge_base_of_three(v):
    """Bases of one commit and the union of two others."""
    n = _last(v).first().node
    return graph.merge_base(v.parents, [n, n - 7, n - 12])


@query("WITH RECURSIVE x AS (SELECT parent AS node FROM parents WHERE id IN (SELECT node FROM branches) UNION SELECT p.parent FROM x JOIN parents p ON p.id = x.node) SELECT node FROM branches WHERE node NOT IN (SELECT node FROM x)")
def independent_heads(v):
    """Branch tips that no other tip reaches."""
    return graph.independent(v.parents, v.branches.select("node"))


@query("WITH RECURSIVE d AS (SELECT CAST(9 AS BIGINT) AS node UNION SELECT p.id FROM d JOIN parents p ON p.parent = d.node) SELECT branch FROM branches WHERE node IN (SELECT node FROM d)")
def branches_containing(v):
    """Branches that contain commit 9."""
    return graph.containing(v.parents, v.branches, v.ids(9))


@query(f"WITH RECURSIVE {_reach('a', _LAST)} SELECT branch, node IN (SELECT node FROM a) AS is_merged FROM branches")
def merged_branches(v):
    """Whether each branch is behind the newest commit."""
    return graph.merged(v.parents, v.branches, _last(v))


@query(f"WITH RECURSIVE {_ANC}, r AS (SELECT branch, a.node FROM branches b JOIN anc a ON a.s = b.node WHERE branch IN ('user1', 'user2', 'user3')) SELECT node, bool_or(branch = 'user1') AS user1, bool_or(branch = 'user2') AS user2, bool_or(branch = 'user3') AS user3, node IN (SELECT node FROM branches WHERE branch IN ('user1', 'user2', 'user3')) AS is_tip FROM r GROUP BY node")
def branch_membership(v):
    """Commits by branches that contain them."""
    return graph.branch_matrix(v.parents, v.branches, ["user1", "user2", "user3"])


@query("""
WITH RECURSIVE a AS (SELECT max(event_id) AS node, 0 AS d FROM events UNION SELECT p.parent, d + 1 FROM a JOIN parents p ON p.id = a.node WHERE p.parent NOT IN (2, 3)),
g AS (SELECT CAST(unnest([2, 3]) AS BIGINT) AS node UNION SELECT p.parent FROM g JOIN parents p ON p.id = g.node), c AS (SELECT node, min(d) AS d FROM a WHERE node NOT IN (SELECT node FROM g) GROUP BY node)
SELECT node, CAST(d AS BIGINT) AS level, row_number() OVER (ORDER BY d, node) AS position FROM c WHERE d > 0
""")
def bisect_candidates(v):
    """Commits between the newest (bad) and two good ones."""
    c = graph.bisect_candidates(v.parents, _last(v), v.ids(2, 3))
    return c.select("node", F.col("level").cast("long").alias("level"), F.col("position").cast("long").alias("position"))


@query("""
WITH RECURSIVE a AS (SELECT max(event_id) AS node, 0 AS d FROM events UNION SELECT p.parent, d + 1 FROM a JOIN parents p ON p.id = a.node WHERE p.parent NOT IN (2, 3)),
g AS (SELECT CAST(unnest([2, 3]) AS BIGINT) AS node UNION SELECT p.parent FROM g JOIN parents p ON p.id = g.node), c AS (SELECT node, min(d) AS d FROM a WHERE node NOT IN (SELECT node FROM g) GROUP BY node),
n AS (SELECT node, row_number() OVER (ORDER BY d, node) AS position, count(*) OVER () AS remaining FROM c WHERE d > 0)
SELECT node, remaining, CAST(floor(log2(remaining)) AS INTEGER) AS steps FROM n WHERE position = remaining // 2 + 1
""")
def bisect_next(v):
    """The middle candidate and the steps left."""
    return graph.bisect_next(graph.bisect_candidates(v.parents, _last(v), v.ids(2, 3)))


@query("""
WITH RECURSIVE l AS (SELECT node, 1 AS d FROM branches UNION SELECT p.parent, d + 1 FROM l JOIN parents p ON p.id = l.node WHERE d < 5)
SELECT DISTINCT 'shallow' AS side, node FROM l WHERE d = 5 UNION ALL SELECT DISTINCT 'not_shallow', node FROM l WHERE d < 5
""")
def shallow_cut(v):
    """Where histories of five commits end, and what lies before."""
    at, before = graph.shallow(v.parents, v.branches.select("node"), 5)
    return at.select(F.lit("shallow").alias("side"), "node").unionByName(before.select(F.lit("not_shallow").alias("side"), "node"))


@query("WITH RECURSIVE l AS (SELECT max(event_id) AS node, 1 AS d FROM events UNION SELECT p.parent, d + 1 FROM l JOIN parents p ON p.id = l.node) SELECT CAST(max(d) AS BIGINT) AS depth FROM l")
def history_depth(v):
    """Longest path from the newest commit."""
    return graph.depth_of(v.parents, _last(v)).select(F.col("depth").cast("long").alias("depth"))


@query(f"WITH RECURSIVE {_ANC} SELECT DISTINCT s AS want, s IN (SELECT s FROM anc WHERE node = 5) AS satisfied FROM anc")
def wants_satisfied(v):
    """Whether each branch tip reaches commit 5."""
    return graph.wants_satisfied(v.parents, v.branches.select("node"), v.ids(5))


_EDGES = "edges AS (SELECT 'c' || id AS src, 'c' || parent AS dst FROM parents UNION ALL SELECT 'c' || o_orderkey, 'r' FROM orders UNION ALL SELECT 'r', 'p' || p_partkey FROM part)"


def _edges(v):
    """Commits to parents, commits of orders to one tree, the tree to parts."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = v.parents.select(s("c", "commit").alias("src"), s("c", "parent").alias("dst"))
    e = e.unionByName(v.table("orders").select(s("c", "o_orderkey").alias("src"), F.lit("r").alias("dst")))
    return e.unionByName(v.table("part").select(F.lit("r").alias("src"), s("p", "p_partkey").alias("dst")))


def _node(v, back: int = 0):
    return _last(v, back).select(F.concat(F.lit("c"), F.col("node").cast("string")).alias("node"))


@query(f"WITH RECURSIVE {_EDGES}, a AS (SELECT 'c' || max(event_id) AS node FROM events UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node), b AS (SELECT 'c' || (max(event_id) - 7) AS node FROM events UNION SELECT e.dst FROM b JOIN edges e ON e.src = b.node) SELECT node FROM a WHERE node NOT IN (SELECT node FROM b)")
def missing_objects(v):
    """Objects that a receiver who has one commit lacks of another."""
    return graph.missing_objects(_edges(v), _node(v, 7), _node(v))


@query(f"WITH RECURSIVE {_EDGES}, a AS (SELECT 'c' || node AS node FROM branches UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node) SELECT count(*) AS pruned, CAST(coalesce(sum(length(message)), 0) AS BIGINT) AS freed_bytes FROM commits WHERE 'c' || id NOT IN (SELECT node FROM a)")
def prunable_objects(v):
    """Commits that no branch reaches, and their bytes."""
    objects = v.commits.select(F.concat(F.lit("c"), F.col("commit").cast("string")).alias("oid"), F.length("message").alias("size"))
    return graph.prune(objects, _edges(v), v.branches.select(F.concat(F.lit("c"), F.col("node").cast("string")).alias("node")))


@query("SELECT name, oid AS target, oid AS peeled FROM tags")
def peeled_tags(v):
    """Targets of tags of tags."""
    t = v.tags
    chain = t.select(F.concat(F.lit("t"), F.col("oid").cast("string")).alias("tag"), F.col("oid").cast("string").alias("target")).unionByName(t.select(F.concat(F.lit("tt"), F.col("oid").cast("string")).alias("tag"), F.concat(F.lit("t"), F.col("oid").cast("string")).alias("target")))
    ids = t.select(F.concat(F.lit("tt"), F.col("oid").cast("string")).alias("oid"))
    return graph.peel(chain, ids).select(F.concat(F.lit("refs/tags/v"), F.expr("cast(peeled as bigint) div 500").cast("string")).alias("name"), F.substr("oid", F.lit(3)).cast("long").alias("target"), F.col("peeled").cast("long").alias("peeled"))


_ABBREV = """
WITH d AS (SELECT DISTINCT oid FROM blobs), n AS (SELECT oid, lag(oid) OVER (ORDER BY oid) AS a, lead(oid) OVER (ORDER BY oid) AS b FROM d),
c AS (SELECT oid, coalesce(len(list_filter(range(1, 41), lambda i: a[1:i] = oid[1:i])), 0) AS x, coalesce(len(list_filter(range(1, 41), lambda i: b[1:i] = oid[1:i])), 0) AS y FROM n)
SELECT oid, oid[1:greatest(7, x + 1, y + 1)] AS abbrev FROM c
"""


@query(_ABBREV)
def unique_abbreviations(v):
    """Shortest unique prefix of every blob's id."""
    return graph.abbreviations(v.blobs.select("oid"))


@query("SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS pos FROM (SELECT DISTINCT oid FROM blobs)")
def object_positions(v):
    """Rank of every blob's id."""
    return bitmaps.positions(v.blobs.select("oid").distinct()).select("oid", F.col("pos").cast("long").alias("pos"))


@query("SELECT lang AS type, count(DISTINCT sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, ''))) AS n FROM documents GROUP BY lang")
def type_bitmap_counts(v):
    """Set bits of a bitmap for each language of blobs."""
    rows = v.table("documents").select(O.blob_id(F.coalesce("text", F.lit(""))).alias("oid"), F.col("lang").alias("type"))
    placed = bitmaps.positions(rows.select("oid").distinct())
    return bitmaps.counts(bitmaps.build(rows.join(placed, "oid"), "type"), "type")


@query(f"WITH RECURSIVE {_ANC} SELECT branch AS commit_id, count(*) AS n FROM branches b JOIN anc a ON a.s = b.node GROUP BY branch")
def reachability_bitmap_counts(v):
    """Set bits of each branch's reachability bitmap."""
    placed = bitmaps.positions(v.commits.select(F.lpad(F.col("commit").cast("string"), 12, "0").alias("oid")))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    edges = v.parents.select(pad("commit").alias("src"), pad("parent").alias("dst"))
    tips = v.branches.select("branch", pad("node").alias("commit"))
    n = bitmaps.counts(bitmaps.reachability_bitmaps(edges, tips.select("commit").distinct(), placed), "commit")
    return tips.join(n, "commit").select(F.col("branch").alias("commit_id"), "n")


@query(f"WITH RECURSIVE {_ANC}, x AS (SELECT DISTINCT a.node FROM branches b JOIN anc a ON a.s = b.node WHERE branch <> 'user1'), y AS (SELECT a.node FROM branches b JOIN anc a ON a.s = b.node WHERE branch = 'user1') SELECT node AS pos FROM x WHERE node NOT IN (SELECT node FROM y)")
def bitmap_difference(v):
    """Commits that other branches reach and user1's does not, from bitmaps alone."""
    reach = closure(v.parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")), v.branches.select(F.col("branch").alias("commit"), "node"), keys=("commit",))
    stored = bitmaps.build(reach.select("commit", F.col("node").alias("pos")), "commit")
    names = v.branches.select(F.col("branch").alias("commit"))
    return bitmaps.combine(stored, names.where("commit <> 'user1'"), names.where("commit = 'user1'"))


@query("""
WITH RECURSIVE a AS (SELECT node, 0 AS d FROM branches UNION SELECT p.parent, d + 1 FROM a JOIN parents p ON p.id = a.node), m AS (SELECT node, min(d) AS d FROM a GROUP BY node),
n AS (SELECT *, row_number() OVER (ORDER BY d, node) AS k FROM m) SELECT node AS commit_id FROM n WHERE k % 100 = 0 OR d = 0
""")
def bitmap_commits(v):
    """Commits that get a bitmap: tips and every hundredth."""
    return bitmaps.select_commits(v.parents, v.branches.select("node")).select(F.col("commit").alias("commit_id"))


# History -----------------------------------------------------------------------------------------------------


@query("SELECT id AS commit_id, row_number() OVER (ORDER BY commit_time DESC, id) AS position FROM commits WHERE regexp_matches(author, '(?i)USER1') AND regexp_matches(message, '(?i)c') AND commit_time >= 1704153600 AND commit_time <= 1706000000")
def log_filtered(v):
    """Commits by author, message and time, newest first."""
    found = history.log(v.commits, author="USER1", grep="c", since=1704153600, until=1706000000)
    return found.select(F.col("commit").alias("commit_id"), F.col("position").cast("long").alias("position"))


@query("SELECT id AS commit_id, row_number() OVER (ORDER BY commit_time DESC, id) AS position FROM commits WHERE id IN (SELECT id FROM parents GROUP BY id HAVING count(*) > 1)")
def log_merges(v):
    """Merge commits, newest first."""
    return history.log(v.commits, v.parents, merges=True).select(F.col("commit").alias("commit_id"), F.col("position").cast("long").alias("position"))


@query("SELECT id AS commit_id FROM commits WHERE author = 'user3' OR author = 'user5'")
def log_paths(v):
    """Commits that changed paths below two folders."""
    changes = v.commits.select("commit", F.concat("author", F.lit("/"), F.col("message")).alias("path"))
    return history.log(v.commits, paths=["user3", "user5"], changes=changes).select(F.col("commit").alias("commit_id"))


@query("SELECT author, count(*) AS commits, count(*) AS lines, string_agg(message, chr(10) ORDER BY commit_time, id) AS messages FROM commits GROUP BY author")
def shortlog(v):
    """Messages by author."""
    return history.shortlog(v.commits)


@query("""
WITH RECURSIVE a AS (SELECT max(event_id) AS node FROM events UNION SELECT p.parent FROM a JOIN parents p ON p.id = a.node),
w AS (SELECT id, row_number() OVER (ORDER BY commit_time DESC, id) - 1 AS n FROM commits JOIN a ON node = id), h AS (SELECT name, n FROM w JOIN tags ON oid = id ORDER BY n LIMIT 1)
SELECT coalesce((SELECT CASE WHEN n = 0 THEN name ELSE name || '-' || n || '-g' || CAST((SELECT max(event_id) FROM events) AS VARCHAR)[1:7] END FROM h), CAST((SELECT max(event_id) FROM events) AS VARCHAR)[1:7]) AS description
""")
def describe(v):
    """The newest commit by the nearest tag."""
    return history.describe(v.commits, v.parents, v.tags, _last(v).first().node)


@query("SELECT path, n AS line_no, line FROM (SELECT path, unnest(string_split(data, chr(10))) AS line, unnest(range(1, len(string_split(data, chr(10))) + 1)) AS n FROM blobs) WHERE regexp_matches(line, '(?i)token|worthless')")
def grep(v):
    """Lines of all documents that match."""
    return history.grep(v.blobs.select("path", "oid"), v.blobs.select("oid", "data").dropDuplicates(["oid"]), "token|worthless", ignore_case=True).select("path", F.col("line_no").cast("long").alias("line_no"), "line")


_PATCH = "SELECT page_id AS k, string_agg(CASE WHEN regexp_matches(l, '^[+-]') THEN regexp_replace(l, '[ \\t]', '', 'g') ELSE l END, chr(10) ORDER BY n) AS t FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l, unnest(range(0, len(string_split(html, chr(10))))) AS n FROM pages) WHERE NOT regexp_matches(l, '^(index |diff |@@|\\\\)') GROUP BY 1"


def _patch_lines(v):
    return v.table("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line_no", "line"))


@query(f"SELECT k AS page_id, sha1(t) AS patch_id FROM ({_PATCH})")
def patch_ids(v):
    """Normalised digests of texts read as patches."""
    return history.patch_ids(_patch_lines(v), "page_id")


@query(f"WITH p AS ({_PATCH}) SELECT k AS commit_id, CASE WHEN t IN (SELECT t FROM p WHERE k % 2 = 0) THEN '-' ELSE '+' END AS sign FROM p")
def cherry(v):
    """Which patches the upstream half already has."""
    ids = history.patch_ids(_patch_lines(v), "page_id").withColumnRenamed("page_id", "commit")
    return history.cherry(ids, ids.where("commit % 2 = 0")).select(F.col("commit").alias("commit_id"), "sign")


@query("""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), o AS (SELECT doc_id, n AS old_position FROM d WHERE doc_id % 5 <> 0), w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS new_position FROM d WHERE doc_id % 5 <> 1 OR doc_id > 50)
SELECT old_position, new_position, CASE WHEN o.doc_id IS NULL THEN '>' WHEN w.doc_id IS NULL THEN '<' ELSE '=' END AS sign FROM o FULL OUTER JOIN w ON o.doc_id = w.doc_id
""")
def range_diff(v):
    """Two series of patches made of all documents, in opposite orders, each without some of them; what is left over is unlike anything left on the other side."""
    from strataquill.plans.ranking import numbered

    rows = v.table("documents").select("doc_id", F.col("doc_id").cast("string").alias("patch_id"), F.concat(F.lit("+"), F.col("doc_id").cast("string"), F.lit("\n")).alias("patch"))
    old = numbered(rows, "doc_id").where("doc_id % 5 <> 0").select("position", "patch_id", "patch")
    new = numbered(rows.where("doc_id % 5 <> 1 or doc_id > 50"), F.desc("doc_id")).select("position", "patch_id", "patch")
    return history.range_diff(old, new, creation_factor=0)


# Reflogs and refs --------------------------------------------------------------------------------------------


@query("SELECT b.branch AS ref, t.at, coalesce((SELECT max_by(new, seq) FROM reflog r WHERE r.ref = b.branch AND r.ts <= t.at), -1) AS oid FROM branches b, (SELECT CAST(unnest([1704200000, 1705000000, 1706500000]) AS BIGINT) AS at) t")
def reflog_at_time(v):
    """Every branch's value at three times."""
    probes = v.branches.select(F.col("branch").alias("ref"), F.explode(F.array(*[F.lit(t).cast("long") for t in (1704200000, 1705000000, 1706500000)])).alias("at"))
    return refs.at_time(v.reflog, probes)


@query("SELECT ref, seq, CASE WHEN n = 1 THEN coalesce(o2, 0) ELSE old END AS old, new FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY seq DESC) - 1 AS n, lead(new, 2) OVER (PARTITION BY ref ORDER BY seq DESC) AS o2 FROM reflog) WHERE n <> 2")
def reflog_drop(v):
    """Reflogs without their third newest row, linked again."""
    return refs.drop_entry(v.reflog, 2, rewrite=True).select("ref", "seq", "old", "new")


@query(f"WITH RECURSIVE {_reach('a', _LAST)} SELECT ref, seq FROM reflog WHERE ts >= CASE WHEN new IN (SELECT node FROM a) THEN 1704300000 ELSE 1705000000 END")
def reflog_expire(v):
    """Reflog rows that stay, with one bound for reachable and one for unreachable commits."""
    reach = graph.walk(v.parents, _last(v))
    return refs.expire(v.reflog, 1704300000, 1705000000, reach).select("ref", "seq")


@query("SELECT branch AS name, max(node) AS oid FROM branches GROUP BY branch")
def stacked_refs(v):
    """Newest value of every ref over stacked tables."""
    stack = v.reflog.select(F.col("ref").alias("name"), F.col("seq").alias("update_index"), F.col("new").alias("oid"), F.lit(False).alias("deleted"))
    return refs.newest_wins(stack).select("name", "oid")


@query("SELECT 'refs/remotes/origin/' || branch AS name, node AS oid FROM branches UNION ALL SELECT name, oid FROM tags")
def imported_refs(v):
    """Refs after an import with pruning."""
    now = v.tags.unionByName(v.branches.select(F.concat(F.lit("refs/remotes/origin/old-"), "branch").alias("name"), F.col("node").alias("oid")))
    return refs.import_refs(now, v.branches.select(F.col("branch").alias("name"), F.col("node").alias("oid")), "refs/remotes/origin", prune=True)


@query("SELECT 'refs/heads/' || branch AS name, CASE WHEN node % 2 = 0 THEN node + 1 ELSE node END AS oid, node % 2 = 0 AS applied FROM branches")
def conditional_updates(v):
    """Refs after updates that expect a value, half of them rightly."""
    now = v.branches.select(F.concat(F.lit("refs/heads/"), "branch").alias("name"), F.col("node").alias("oid"))
    return refs.compare_and_set(now, now.select("name", F.expr("oid - oid % 2").alias("expected"), F.expr("oid + 1").alias("new")))


@query("SELECT name, oid FROM tags WHERE name LIKE 'refs/tags/v1%' UNION ALL SELECT 'refs/heads/' || branch, node FROM branches WHERE regexp_matches(branch, '^user.1$')")
def refs_by_glob(v):
    """Refs by segment globs."""
    every = v.tags.select("name", "oid").unionByName(v.branches.select(F.concat(F.lit("refs/heads/"), "branch").alias("name"), F.col("node").alias("oid")))
    kinds = v.commits.select(F.col("commit").alias("oid"), F.lit("commit").alias("type"))
    return refs.for_each_ref(every, kinds, "refs/tags/v1*").select("name", "oid").unionByName(refs.for_each_ref(every, kinds, "refs/heads/user?1").select("name", "oid"))


@query("SELECT name, oid FROM tags WHERE name = 'refs/tags/v1' OR name LIKE '%/v2' UNION ALL SELECT name || '^{}', oid FROM tags WHERE name = 'refs/tags/v1' OR name LIKE '%/v2'")
def shown_refs(v):
    """Tags by last segments, with peeled rows."""
    t = v.tags.withColumn("peeled", F.col("oid"))
    return refs.show_ref(t, ["v1", "v2"], tags=True, dereference=True).select("name", "oid")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Both' WHEN c_custkey % 3 = 0 THEN 'Mail' WHEN c_mktsegment = 'BUILDING' THEN 'Name' ELSE c_mktsegment END AS to_name, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'x@y' ELSE c_name || '@z' END AS to_email FROM customer")
def canonical_identities(v):
    """Every customer's canonical identity, by name and address, address, or name."""
    c = v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.concat("c_name", F.lit("@z")).alias("email"))
    none = F.lit(None).cast("string")
    both = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("no"), F.lit("Both").alias("to"), F.lit("x@y").alias("mail"), F.col("name").alias("from_name"), F.col("email").alias("from_email"))
    mail = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("no"), F.lit("Mail").alias("to"), F.lit("x@y").alias("mail"), none.alias("from_name"), F.col("email").alias("from_email"))
    name = c.where("name = 'BUILDING'").select(F.col("c_custkey").alias("no"), F.lit("Name").alias("to"), none.alias("mail"), F.col("name").alias("from_name"), none.alias("from_email"))
    rules = both.unionByName(mail).unionByName(name).select("no", F.col("to").alias("name"), F.col("mail").alias("email"), "from_name", "from_email")
    return refs.canonical(c, rules).select("c_custkey", "to_name", "to_email")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+')) AS n_lines FROM documents")
def line_counts(v):
    """Number of lines of every document."""
    return v.table("documents").select("doc_id", F.size(split_lines(F.coalesce("text", F.lit("")))).cast("long").alias("n_lines"))


@query("SELECT id AS oid, 'missing ' || parent AS problem FROM parents WHERE parent NOT IN (SELECT id FROM commits WHERE author <> 'user7') UNION ALL SELECT id, 'bad-time' FROM commits WHERE commit_time < 1704150000 UNION ALL SELECT id, 'bad-author' FROM commits WHERE author = 'user3'")
def consistency(v):
    """Commits with parents that a store lacks, early times and malformed authors."""
    known = v.commits.where("author <> 'user7'").select(F.col("commit").alias("oid"))
    lost = fsck.links(v.parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")), known)
    author = F.when(F.col("author") == "user3", "no address").otherwise(F.concat("author", F.lit(" <a@b>")))
    odd = fsck.commits(v.commits.select("commit", F.lit("a" * 40).alias("tree"), author.alias("author"), (F.col("commit_time") - 1704150000).alias("commit_time")))
    return lost.unionByName(odd)
