"""Line-based stores, read and written by the text source: refs, reflogs, aliases, rules, server info, loose objects, mail."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.functions import people
from strataquill.operators import refs
from strataquill.shipping import ship
from strataquill.sources import packs


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, line) of text files; a file is read as one value, so numbers don't depend on splits."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("no", "line")).where(F.col("line") != "")


def packed_refs(lines: DataFrame) -> DataFrame:
    """(file, name, oid, peeled) of packed refs (file, no, line); a ^ line peels the ref before it."""
    rows = lines.where(~F.col("line").startswith("#"))
    rows = rows.withColumn("next", F.lead("line").over(Window.partitionBy("file").orderBy("no")))
    peeled = F.when(F.col("next").startswith("^"), F.substr("next", F.lit(2)))
    return rows.where(~F.col("line").startswith("^")).select("file", F.regexp_extract("line", r"^(\S+) (.+)$", 2).alias("name"), F.regexp_extract("line", r"^(\S+) (.+)$", 1).alias("oid"), peeled.alias("peeled"))


def packed_ref_lines(rows: DataFrame) -> DataFrame:
    """(value) lines of packed refs (name, oid, peeled), in one sorted partition."""
    body = F.concat(F.col("oid"), F.lit(" "), F.col("name"), F.when(F.col("peeled").isNotNull(), F.concat(F.lit("\n^"), F.col("peeled"))).otherwise(F.lit("")))
    head = rows.sparkSession.createDataFrame([("", "# pack-refs with: peeled fully-peeled sorted")], "name string, value string")
    return head.unionByName(rows.select("name", body.alias("value"))).repartition(1).sortWithinPartitions("name").select("value")


def loose_refs(spark: SparkSession, root: str) -> DataFrame:
    """(name, oid, symref) of a folder of loose refs."""
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{root}/refs", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"(refs/.*)$", 1).alias("name"), F.rtrim(F.regexp_replace("value", "\n", "")).alias("value"))
    link = F.col("value").startswith("ref: ")
    return rows.select("name", F.when(~link, F.col("value")).alias("oid"), F.when(link, F.substr("value", F.lit(6))).alias("symref"))


def all_refs(loose: DataFrame, packed: DataFrame) -> DataFrame:
    return refs.pack_refs(loose, packed)


def info_refs(spark: SparkSession, path: str) -> DataFrame:
    """(oid, name, peeled) rows of a server's list of refs."""
    rows = spark.read.csv(path, sep="\t", schema="oid string, name string", quote="")
    plain, tail = rows.where(~F.col("name").endswith("^{}")), rows.where(F.col("name").endswith("^{}")).select(F.regexp_replace("name", r"\^\{\}$", "").alias("name"), F.col("oid").alias("peeled"))
    return plain.join(tail, "name", "left").select("oid", "name", "peeled")


def info_ref_lines(rows: DataFrame) -> DataFrame:
    """(value) lines of a server's list of refs (name, oid, peeled)."""
    body = F.concat(F.col("oid"), F.lit("\t"), F.col("name"), F.coalesce(F.concat(F.lit("\n"), F.col("peeled"), F.lit("\t"), F.col("name"), F.lit("^{}")), F.lit("")))
    return rows.repartition(1).sortWithinPartitions("name").select(body.alias("value"))


# Reflogs -----------------------------------------------------------------------------------------------------

_LOG = r"^(\S+) (\S+) (.*> -?\d+ [+-]\d+)(?:\t(.*))?$"


def reflog_columns(line: Column) -> Column:
    """Struct (old, new, committer, ts, tz, message) of a reflog line."""
    who = people.parse_time_entry(F.regexp_extract(line, _LOG, 3))
    return F.struct(F.regexp_extract(line, _LOG, 1).alias("old"), F.regexp_extract(line, _LOG, 2).alias("new"), who["person"].alias("committer"), who["time"].alias("ts"), who["offset"].alias("tz"), F.regexp_extract(line, _LOG, 4).alias("message"))


def read_reflogs(spark: SparkSession, root: str) -> DataFrame:
    """(ref, seq, old, new, committer, ts, tz, message) of all logs below a folder."""
    lines = numbered(spark, root)
    return lines.select(F.regexp_extract("file", r"logs/(.*)$", 1).alias("ref"), F.col("no").cast("long").alias("seq"), reflog_columns(F.col("line")).alias("x")).select("ref", "seq", "x.*")


def reflog_line(old: Column, new: Column, committer: Column, ts: Column, tz: Column, message: Column) -> Column:
    """A reflog line; the message is cut to one line."""
    head = F.concat_ws(" ", F.coalesce(old, F.lit("0" * 40)), new, people.format_time_entry(committer, ts, tz))
    return F.when(F.coalesce(message, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\t"), F.regexp_replace(message, "\\s+", " ")))


def reflog_spec(text: Column) -> Column:
    """Struct (ref, n) of ``ref@{n}``; a missing ref is HEAD."""
    shape = r"^(.*)@\{(\d+)\}$"
    ref = F.regexp_extract(text, shape, 1)
    return F.when(text.rlike(shape), F.struct(F.when(ref == "", "HEAD").otherwise(ref).alias("ref"), F.regexp_extract(text, shape, 2).cast("int").alias("n")))


# Aliases and rules -------------------------------------------------------------------------------------------


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return refs.alias_rows(numbered(spark, path).select("no", "line"))


def rule_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small rule file (ignore, attributes, sparse) for the driver's compilers."""
    return [r.line for r in numbered(spark, path).orderBy("file", "no").collect()]


# Objects and mail --------------------------------------------------------------------------------------------


def parse_loose(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(type, size, data) of a loose object's file."""
    raw = zlib.decompress(data)
    head, _, body = raw.partition(b"\0")
    kind, _, size = head.decode().partition(" ")
    if int(size) != len(body):
        raise ValueError("loose object of another size")
    yield kind, len(body), body


def read_loose(spark: SparkSession, root: str) -> DataFrame:
    """(oid, type, size, data) of the loose objects below a folder."""
    rows = packs.rows_of(spark, f"{root}/[0-9a-f][0-9a-f]/*", parse_loose, "type string, size long, data binary")
    return rows.select(F.regexp_replace(F.regexp_extract("file", r"([0-9a-f]{2}/[0-9a-f]+)$", 1), "/", "").alias("oid"), "type", "size", "data")


def loose_bytes(kind: str, data: bytes, level: int = -1) -> bytes:
    return zlib.compress(f"{kind} {len(data)}\0".encode() + data, level)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, message) of mailboxes."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"(?m)^From [^\n]*\n").alias("parts"))
    return whole.select("file", F.posexplode("parts").alias("no", "message")).where("no > 0")


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """(file, message) of a mail folder's new and current messages, in order of names."""
    rows = spark.read.text([f"{root}/cur", f"{root}/new"], wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("message"))


def mail_columns(messages: DataFrame) -> DataFrame:
    """``messages`` (…, message) with author, email, subject, body and patch."""
    from strataquill.functions.records import mail_info

    ship(messages.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in messages.dtypes) + ", author string, email string, subject string, body string, patch string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = pd.DataFrame([mail_info(m or "") for m in f["message"]], columns=["author", "email", "subject", "message", "patch", "message_id"])
            yield pd.concat([f.reset_index(drop=True), found.rename(columns={"message": "body"})[["author", "email", "subject", "body", "patch"]]], axis=1)

    return messages.mapInPandas(run, schema)
