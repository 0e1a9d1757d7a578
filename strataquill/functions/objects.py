"""Object ids, modes and paths of content-addressed objects, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
#: File modes: type bits and the fixed forms that trees hold.
S_IFMT, S_IFDIR, S_IFREG, S_IFLNK, S_IFGITLINK = 0o170000, 0o040000, 0o100000, 0o120000, 0o160000


def object_header(kind: Column | str, size: Column) -> Column:
    """``<type> <size>NUL``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(" "), size.cast("string"), F.lit("\0"))


def object_id(kind: Column | str, data: Column, algorithm: str = "sha1") -> Column:
    """The id of an object from its type and text or bytes."""
    whole = F.concat(object_header(kind, F.octet_length(data)).cast("binary"), data.cast("binary"))
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def blob_id(data: Column, algorithm: str = "sha1") -> Column:
    return object_id("blob", data, algorithm)


def sha_to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def hex_to_sha(text: Column) -> Column:
    return F.unhex(text)


def hex_to_filename(text: Column, root: str = "objects") -> Column:
    """The loose-object path: two characters as folder, the rest as name."""
    return F.concat(F.lit(root + "/"), F.substring(text, 1, 2), F.lit("/"), F.substr(text, F.lit(3)))


def valid_hexsha(text: Column) -> Column:
    return text.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def is_gitlink(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFMT) == S_IFGITLINK


def is_dir(mode: Column) -> Column:
    return mode.bitwiseAND(S_IFMT) == S_IFDIR


def cleanup_mode(mode: Column) -> Column:
    """The mode a tree would store: link, folder and submodule as they are; files 0644, or 0755 if the owner may execute."""
    kind = mode.bitwiseAND(S_IFMT)
    executable = mode.bitwiseAND(0o100) != 0
    return F.when(kind == S_IFLNK, S_IFLNK).when(kind == S_IFDIR, S_IFDIR).when(kind == S_IFGITLINK, S_IFGITLINK).when(executable, S_IFREG | 0o755).otherwise(S_IFREG | 0o644)


def mode_octal(mode: Column, width: int = 6) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), width, "0")


def entry_kind(mode: Column) -> Column:
    return F.when(is_gitlink(mode), "commit").when(is_dir(mode), "tree").otherwise("blob")


def pretty_entry(name: Column, mode: Column, oid: Column) -> Column:
    """``<mode> <type> <id>TAB<name>``."""
    return F.concat(mode_octal(mode), F.lit(" "), entry_kind(mode), F.lit(" "), oid, F.lit("\t"), name)


def tree_sort_key(name: Column, mode: Column) -> Column:
    """Trees order folders as if their names ended in a slash, by bytes."""
    return F.when(is_dir(mode), F.concat(name, F.lit("/"))).otherwise(name).cast("binary")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?s)(?:(.*)/)?[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors_of_path(path: Column) -> Column:
    """All proper folder prefixes of a path, shortest first: turns prefix joins into equality joins."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def path_under(path: Column, prefix: Column | str) -> Column:
    """Whether a path is ``prefix`` or lies below it."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def note_path(oid: Column, level: int) -> Column:
    """An id as a path with ``level`` two-character folders."""
    cut = [F.substring(oid, 2 * i + 1, 2) for i in range(level)]
    return F.concat_ws("/", *cut, F.substr(oid, F.lit(2 * level + 1)))


def note_fanout_level(count: Column) -> Column:
    return F.when(count < 256, 0).when(count < 65536, 1).otherwise(2)


def name_hash(name: Column) -> Column:
    """32-bit hash in which the last characters weigh most; white space is skipped. ASCII names."""
    chars = F.filter(F.split(name, ""), lambda c: ~c.rlike(r"^\s*$"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (F.shiftright(h, 2) + F.shiftleft(F.ascii(c).cast("long"), 24)) % (1 << 32))


def is_binary(data: Column) -> Column:
    """Whether a NUL is among the first 8000 bytes."""
    return F.decode(F.substring(data.cast("binary"), 1, 8000), "ISO-8859-1").contains("\0")


def lfs_pointer(text: Column) -> Column:
    """Struct (oid, size) of a large-file pointer text, else null."""
    shape = r"^version https://[^\n]+\n(?:[a-z.]+ [^\n]*\n)*?oid sha256:([0-9a-f]{64})\nsize (\d+)\n$"
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("oid"), F.regexp_extract(text, shape, 2).cast("long").alias("size")))


def lfs_pointer_text(oid: Column, size: Column) -> Column:
    return F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), oid, F.lit("\nsize "), size.cast("string"), F.lit("\n"))
