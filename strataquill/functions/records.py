"""Commits, trees and tags between bytes and records, and mail patches."""

from __future__ import annotations

import email
import email.policy
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions import people

HEADER = r"(?s)^(.*?)\n\n(.*)$"


def message_headers(raw: bytes) -> tuple[list[tuple[str, bytes]], bytes | None]:
    """Headers with folded lines joined, and the body (None if there is no blank line)."""
    head, gap, body = raw.partition(b"\n\n")
    if raw.startswith(b"\n"):
        head, gap, body = b"", b"\n", raw[1:]
    out: list[tuple[str, bytes]] = []
    for line in head.split(b"\n"):
        if line.startswith(b" ") and out:
            out[-1] = (out[-1][0], out[-1][1] + b"\n" + line[1:])
        elif line:
            key, _, value = line.partition(b" ")
            out.append((key.decode(), value))
    return out, body if gap else None


@dataclass
class CommitRecord:
    tree: str = ""
    parents: list[str] = field(default_factory=list)
    author: bytes = b""
    committer: bytes = b""
    encoding: bytes | None = None
    gpgsig: bytes | None = None
    mergetags: list[bytes] = field(default_factory=list)
    extra: list[tuple[str, bytes]] = field(default_factory=list)
    message: bytes | None = b""


def parse_commit(raw: bytes) -> CommitRecord:
    headers, body = message_headers(raw)
    out = CommitRecord(message=body)
    for k, v in headers:
        if k == "tree":
            out.tree = v.decode()
        elif k == "parent":
            out.parents.append(v.decode())
        elif k in ("author", "committer", "encoding", "gpgsig"):
            setattr(out, k, v)
        elif k == "mergetag":
            out.mergetags.append(v)
        else:
            out.extra.append((k, v))
    return out


def _fold(key: str, value: bytes) -> bytes:
    return key.encode() + b" " + value.replace(b"\n", b"\n ") + b"\n"


def serialise_commit(c: CommitRecord) -> bytes:
    out = _fold("tree", c.tree.encode()) + b"".join(_fold("parent", p.encode()) for p in c.parents) + _fold("author", c.author) + _fold("committer", c.committer)
    if c.encoding is not None:
        out += _fold("encoding", c.encoding)
    out += b"".join(_fold("mergetag", m) for m in c.mergetags) + b"".join(_fold(k, v) for k, v in c.extra)
    if c.gpgsig is not None:
        out += _fold("gpgsig", c.gpgsig)
    return out if c.message is None else out + b"\n" + c.message


def parse_tree(raw: bytes, id_bytes: int = 20, strict: bool = False) -> list[tuple[bytes, int, str]]:
    """(name, mode, id) entries of a tree's bytes."""
    out, at = [], 0
    while at < len(raw):
        space = raw.index(b" ", at)
        end = raw.index(b"\0", space)
        mode = raw[at:space]
        if strict and mode.startswith(b"0"):
            raise ValueError(f"mode {mode!r} starts with zero")
        sha = raw[end + 1 : end + 1 + id_bytes]
        if len(sha) != id_bytes:
            raise ValueError("tree ends within an id")
        out.append((raw[space + 1 : end], int(mode, 8), sha.hex()))
        at = end + 1 + id_bytes
    return out


def serialise_tree(entries: list[tuple[bytes, int, str]]) -> bytes:
    key = lambda e: e[0] + b"/" if e[1] & 0o170000 == 0o040000 else e[0]
    return b"".join(b"%o " % m + n + b"\0" + bytes.fromhex(o) for n, m, o in sorted(entries, key=key))


def split_signature(raw: bytes) -> tuple[bytes, bytes | None, str | None]:
    """(payload, signature, kind) of a commit with a signature header or a tag with one at its end."""
    for mark, kind in ((b"-----BEGIN PGP SIGNATURE-----", "pgp"), (b"-----BEGIN SSH SIGNATURE-----", "ssh"), (b"-----BEGIN SIGNED MESSAGE-----", "x509")):
        at = raw.find(b"\n" + mark)
        headers, _ = message_headers(raw)
        for k, v in headers:
            if k == "gpgsig" and v.startswith(mark):
                return raw.replace(_fold("gpgsig", v), b"", 1), v, kind
        if at >= 0 and raw.find(b"\n\n") <= at:
            return raw[: at + 1], raw[at + 1 :], kind
    return raw, None, None


def commit_columns(raw: Column) -> Column:
    """Struct of a commit's text: tree, parents, author and committer as time entries, message."""
    head, message = F.regexp_extract(raw, HEADER, 1), F.regexp_extract(raw, HEADER, 2)
    line = lambda k: F.regexp_extract(head, rf"(?m)^{k} (.*)$", 1)
    return F.struct(line("tree").alias("tree"), F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"), people.parse_time_entry(line("author")).alias("author"), people.parse_time_entry(line("committer")).alias("committer"), message.alias("message"))


def tag_columns(raw: Column) -> Column:
    """Struct of a tag's text: object, type, name, tagger, message, signature (null without one)."""
    head, body = F.regexp_extract(raw, HEADER, 1), F.regexp_extract(raw, HEADER, 2)
    line = lambda k: F.regexp_extract(head, rf"(?m)^{k} (.*)$", 1)
    at = F.regexp_extract(body, r"(?s)(-----BEGIN [A-Z ]+-----.*)$", 1)
    return F.struct(line("object").alias("object"), line("type").alias("type"), line("tag").alias("name"), people.parse_time_entry(line("tagger")).alias("tagger"), F.regexp_replace(body, r"(?s)-----BEGIN [A-Z ]+-----.*$", "").alias("message"), F.nullif(at, F.lit("")).alias("signature"))


# Mail --------------------------------------------------------------------------------------------------------


def mail_info(raw: str, keep_subject: bool = False, scissors: bool = False) -> dict[str, str | None]:
    """author, email, subject, message, patch, message_id of a mailed patch."""
    m = email.message_from_string(raw, policy=email.policy.default)
    body = m.get_body(("plain",)) if m.is_multipart() else m
    text = body.get_content() if body is not None else ""
    name = re.match(r"^\s*\"?([^\"<]*?)\"?\s*<([^>]*)>", str(m["from"] or ""))
    subject = re.sub(r"\s+", " ", str(m["subject"] or "")).strip()
    if not keep_subject:
        subject = re.sub(r"^((re|fwd?):\s*|\[[^\]]*\]\s*)+", "", subject, flags=re.I)
    if scissors and (cut := re.search(r"(?m)^.*(>8|8<).*-.*$\n", text)):
        text = text[cut.end() :]
    start = re.search(r"(?m)^(---$|diff --git |Index: )", text)
    message, patch = (text[: start.start()], text[start.start() :]) if start else (text, "")
    return {"author": name[1] if name else None, "email": name[2] if name else str(m["from"] or "") or None, "subject": subject, "message": message.strip("\n") + "\n" if message.strip() else "", "patch": patch, "message_id": str(m["message-id"]) if m["message-id"] else None}


def mail_patch(oid: str, author: str, date: str, message: str, patch: str, number: tuple[int, int] = (1, 1), version: str = "1") -> str:
    """A commit as a mailed patch."""
    subject, _, body = message.partition("\n")
    tag = "[PATCH]" if number == (1, 1) else f"[PATCH {number[0]}/{number[1]}]"
    return f"From {oid} Mon Sep 17 00:00:00 2001\nFrom: {author}\nDate: {date}\nSubject: {tag} {subject}\n\n{body.lstrip()}---\n\n{patch}-- \n{version}\n"


def split_mbox(text: str, mboxrd: bool = False) -> list[str]:
    """Messages of a mailbox; with ``mboxrd`` quoted From lines are unquoted."""
    parts = re.split(r"(?m)^From [^\n]*\n", text)
    out = [p for p in parts[1:]]
    return [re.sub(r"(?m)^>(>*From )", r"\1", p) for p in out] if mboxrd else out
