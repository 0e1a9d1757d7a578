"""Names of references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions import globs

HEADS, TAGS, REMOTES = "refs/heads/", "refs/tags/", "refs/remotes/"


def check_ref_format(name: Column) -> Column:
    """Whether a name is well formed: at least two segments and none of the forbidden characters, ends and sequences."""
    bad = r"(^|/)\.|\.\.|[\x00-\x20\x7f~^:?*\[\\]|//|@\{|/$|^/|\.$|\.lock(/|$)"
    return name.contains("/") & ~name.rlike(bad)


def is_per_worktree_ref(name: Column) -> Column:
    """Names that each working tree has of its own: those outside refs/, and the three folders that are not shared."""
    return ~name.startswith("refs/") | name.rlike("^refs/(bisect|worktree|rewritten)/")


def shorten_ref_name(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|remotes|tags)/", "")


def local_branch_name(name: Column) -> Column:
    return F.when(name.startswith(HEADS), name).otherwise(F.concat(F.lit(HEADS), name))


def extract_branch_name(name: Column) -> Column:
    """The branch of a name in refs/heads/, else null."""
    return F.when(name.startswith(HEADS), F.substr(name, F.lit(len(HEADS) + 1)))


def extract_tag_name(name: Column) -> Column:
    return F.when(name.startswith(TAGS), F.substr(name, F.lit(len(TAGS) + 1)))


def parse_symref_value(contents: Column) -> Column:
    """Target of ``ref: <name>``, else null."""
    return F.when(contents.startswith("ref: "), F.rtrim(F.substr(contents, F.lit(6))))


def under_any(name: Column, prefixes: list[str]) -> Column:
    """Whether a name starts with one of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def matches_segments(name: Column, pattern: str) -> Column:
    """Segment-wise glob in which the name may have more segments than the pattern only below a pattern without wildcards."""
    return name.rlike(globs.segments(pattern))


def candidates(spec: str) -> list[str]:
    """Full names that an abbreviated one may mean, in order of preference."""
    return [spec, f"refs/{spec}", f"{TAGS}{spec}", f"{HEADS}{spec}", f"{REMOTES}{spec}", f"{REMOTES}{spec}/HEAD"]
