"""Variable-length numbers, deltas, base 85 and compressed bitsets."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd

from strataquill.functions._udf import vectorised

#: Alphabet of the base-85 form in binary patches (fixed by the format).
BASE85 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"


def size_varint(value: int) -> bytes:
    """Seven bits a byte, low bits first."""
    out = bytearray()
    while True:
        value, low = value >> 7, value & 127
        out.append(low | (128 if value else 0))
        if not value:
            return bytes(out)


def read_size_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def offset_varint(value: int) -> bytes:
    """Seven bits a byte, high bits first, each continuation adding one."""
    out = [value & 127]
    value >>= 7
    while value:
        value -= 1
        out.append(128 | (value & 127))
        value >>= 7
    return bytes(reversed(out))


def read_offset_varint(data: bytes, at: int) -> tuple[int, int]:
    byte = data[at]
    at += 1
    value = byte & 127
    while byte & 128:
        byte = data[at]
        at += 1
        value = ((value + 1) << 7) | (byte & 127)
    return value, at


# Deltas ------------------------------------------------------------------------------------------------------

_STEP = 16


def create_delta(base: bytes, target: bytes) -> bytes:
    """Copy and insert instructions that make ``target`` from ``base``: matches are found by blocks of 16 bytes and grown both ways."""
    index: dict[bytes, int] = {}
    for at in range(0, len(base) - _STEP + 1, _STEP):
        index.setdefault(base[at : at + _STEP], at)
    out = bytearray(size_varint(len(base)) + size_varint(len(target)))
    pending = bytearray()

    def flush() -> None:
        for i in range(0, len(pending), 127):
            part = pending[i : i + 127]
            out.append(len(part))
            out.extend(part)
        pending.clear()

    at = 0
    while at < len(target):
        found = index.get(target[at : at + _STEP])
        if found is None:
            pending.append(target[at])
            at += 1
            continue
        back = 0
        while back < len(pending) and back < found and base[found - back - 1] == target[at - back - 1]:
            back += 1
        if back:
            del pending[-back:]
        start, n = found - back, _STEP + back
        while start + n < len(base) and at - back + n < len(target) and base[start + n] == target[at - back + n]:
            n += 1
        flush()
        at += n - back
        while n:
            size = min(n, 0xFFFF)
            code, arguments = 128, bytearray()
            for i in range(4):
                if byte := start >> 8 * i & 255:
                    code |= 1 << i
                    arguments.append(byte)
            for i in range(2):
                if byte := size >> 8 * i & 255:
                    code |= 16 << i
                    arguments.append(byte)
            out.append(code)
            out.extend(arguments)
            start, n = start + size, n - size
    flush()
    return bytes(out)


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The target of a delta; ValueError if sizes or instructions don't fit."""
    size, at = read_size_varint(delta, 0)
    if size != len(base):
        raise ValueError(f"delta is for {size} bytes, base has {len(base)}")
    size, at = read_size_varint(delta, at)
    out = bytearray()
    while at < len(delta):
        code = delta[at]
        at += 1
        if code & 128:
            start = n = 0
            for i in range(4):
                if code >> i & 1:
                    start |= delta[at] << 8 * i
                    at += 1
            for i in range(3):
                if code >> 4 + i & 1:
                    n |= delta[at] << 8 * i
                    at += 1
            n = n or 0x10000
            if start + n > len(base):
                raise ValueError("copy beyond the base")
            out += base[start : start + n]
        elif code:
            out += delta[at : at + code]
            at += code
        else:
            raise ValueError("instruction 0")
    if len(out) != size:
        raise ValueError(f"delta gave {len(out)} bytes for {size}")
    return bytes(out)


@vectorised("binary")
def delta(base: pd.Series, target: pd.Series) -> pd.Series:
    """Delta of each target against its base."""
    return pd.Series([create_delta(bytes(b), bytes(t)) for b, t in zip(base, target)])


@vectorised("binary")
def undelta(base: pd.Series, change: pd.Series) -> pd.Series:
    """Target of each base and delta."""
    return pd.Series([apply_delta(bytes(b), bytes(d)) for b, d in zip(base, change)])


@vectorised("binary")
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.decompress(bytes(d)))


# Base 85 -----------------------------------------------------------------------------------------------------


_FULL = 67  # characters of a line of 52 bytes
_LINES = 8192  # lines that are coded at once
_LETTERS = np.frombuffer(BASE85.encode(), np.uint8)
_DIGITS = np.full(256, 255, np.uint8)
_DIGITS[_LETTERS] = np.arange(85, dtype=np.uint8)
_POWERS = np.array([85**k for k in (4, 3, 2, 1, 0)], np.uint64)


def base85_encode(data: bytes) -> str:
    """Lines of at most 52 bytes: a letter for the length, then five characters for each four bytes."""
    out, full = [], len(data) - len(data) % 52
    for at in range(0, full, 52 * _LINES):
        words = np.frombuffer(data[at : min(full, at + 52 * _LINES)], ">u4").astype(np.uint64)
        lines = np.full((len(words) // 13, _FULL), ord("\n"), np.uint8)
        lines[:, 0] = ord("z")
        lines[:, 1:66] = _LETTERS[(words[:, None] // _POWERS % np.uint64(85)).astype(np.uint8)].reshape(-1, 65)
        out.append(lines.tobytes().decode("ascii"))
    if part := data[full:]:
        head = chr(len(part) + (64 if len(part) <= 26 else 70))
        text = ""
        for i in range(0, len(part), 4):
            value = int.from_bytes(part[i : i + 4].ljust(4, b"\0"), "big")
            text += "".join(BASE85[value // 85**k % 85] for k in (4, 3, 2, 1, 0))
        out.append(f"{head}{text}\n")
    return "".join(out)


def base85_decode(text: str) -> bytes:
    out, at = bytearray(), 0
    raw = text.encode() if text.isascii() else b""
    while len(raw) - at >= _FULL:  # full lines at once, up to the first of another form
        lines = np.frombuffer(raw, np.uint8, min(_LINES, (len(raw) - at) // _FULL) * _FULL, at).reshape(-1, _FULL)
        digits = _DIGITS[lines[:, 1:66]]
        words = (np.minimum(digits, 84).reshape(-1, 13, 5) * _POWERS).sum(axis=2, dtype=np.uint64)
        good = (lines[:, 0] == ord("z")) & (lines[:, 66] == ord("\n")) & (digits < 85).all(axis=1) & (words < 1 << 32).all(axis=1)
        n = len(good) if good.all() else int(good.argmin())
        out += words[:n].astype(">u4").tobytes()
        at += n * _FULL
        if n < len(good):
            break
    for line in text[at:].splitlines():
        n = ord(line[0]) - (64 if line[0] <= "Z" else 70)
        part = bytearray()
        for i in range(1, len(line), 5):
            value = 0
            for c in line[i : i + 5]:
                value = value * 85 + BASE85.index(c)
            part += value.to_bytes(4, "big")
        out += part[:n]
    return bytes(out)


@vectorised("string")
def base85(data: pd.Series) -> pd.Series:
    """Base-85 lines of each value."""
    return data.map(lambda d: None if d is None else base85_encode(bytes(d)))


@vectorised("binary")
def unbase85(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else base85_decode(t))


# Run-length compressed bitsets -------------------------------------------------------------------------------

_ONES = (1 << 64) - 1


def ewah_encode(positions: set[int], size: int | None = None) -> bytes:
    """Bits, words, run-length words with literals, place of the last run-length word."""
    size = (max(positions) + 1 if positions else 0) if size is None else size
    words = [0] * -(-size // 64)
    for p in positions:
        words[p // 64] |= 1 << p % 64
    out, at, last = [], 0, 0
    while at < len(words):
        run, bit = 0, int(words[at] == _ONES)
        while at < len(words) and words[at] == (_ONES if bit else 0) and run < 0xFFFFFFFF:
            run, at = run + 1, at + 1
        start = at
        while at < len(words) and words[at] not in (0, _ONES) and at - start < 0x7FFFFFFF:
            at += 1
        last = len(out)
        out += [(at - start) << 33 | run << 1 | bit, *words[start:at]]
    if not out:
        out = [0]
    return struct.pack(">II", size, len(out)) + struct.pack(f">{len(out)}Q", *out) + struct.pack(">I", last)


def ewah_decode(data: bytes, at: int = 0) -> tuple[set[int], int]:
    """(set positions, place behind the bitset)."""
    size, n = struct.unpack_from(">II", data, at)
    words = struct.unpack_from(f">{n}Q", data, at + 8)
    out: set[int] = set()
    i = place = 0
    while i < n:
        head = words[i]
        run, literals = head >> 1 & 0xFFFFFFFF, head >> 33
        if head & 1:
            out.update(range(place * 64, (place + run) * 64))
        place += run
        for w in words[i + 1 : i + 1 + literals]:
            while w:
                low = w & -w
                out.add(place * 64 + low.bit_length() - 1)
                w ^= low
            place += 1
        i += 1 + literals
    return {p for p in out if p < size}, at + 12 + 8 * n
