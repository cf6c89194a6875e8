"""Text functions with the meaning that configurations give them: ECMAScript regular expressions and replacements, IRI
resolution, and the 32-bit hashes in IRIs. All are column expressions; hashes are Arrow functions, which hash a batch's distinct
texts side by side."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(regex: str, before: int = 0) -> str:
    """An ECMAScript regular expression (flag u, no m) for the JVM: $ is the very end, \\/ a slash, [^] any character. before: how
    many groups will stand in front of it, for back-references by number."""
    out, i, inside = [], 0, False
    while i < len(regex):
        c = regex[i]
        if not inside and (m := re.match(r"\\([1-9][0-9]*)", regex[i:])):
            out.append(f"(?:\\{int(m[1]) + before})")
            i += len(m[0])
            continue
        if c == "\\" and i + 1 < len(regex):
            out.append(regex[i + 1] if regex[i + 1] == "/" else regex[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else "&\\&" if c == "&" and regex[i : i + 2] == "&&" else c)
            i += 2 if c == "&" and regex[i : i + 2] == "&&" else 1
            continue
        if regex.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        inside = c == "["
        out.append(r"\z" if c == "$" else c)
        i += 1
    return "".join(out)


def group_count(regex: str) -> int:
    """Capturing groups of a regular expression."""
    plain = re.sub(r"\\.", "", regex, flags=re.S)
    plain = re.sub(r"\[[^\]]*\]", "", plain)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def matches(value: Column, regex: str) -> Column:
    return value.rlike(pattern(regex))


def group(value: Column, regex: str, n: int) -> Column:
    """The n-th group of the first match, null if there is no match. (An optional group without a match is empty.)"""
    return F.when(matches(value, regex), F.regexp_extract(value, pattern(regex), n))


def js_replace(value: Column, regex: str, replacement: str) -> Column:
    """The first match replaced; $1.. are groups, $& the match, $$ a dollar; other dollars stand for themselves."""
    groups = group_count(regex)
    out, i = [], 0
    while i < len(replacement):
        c, rest = replacement[i], replacement[i + 1 : i + 3]
        if c == "$" and rest[:1] == "$":
            out.append(r"\$")
            i += 2
        elif c == "$" and rest[:1] == "&":
            out.append("$2")
            i += 2
        elif c == "$" and (m := re.match(r"\d{2}|\d", rest)) and (n := _reference(m[0], groups)):
            out.append(f"${int(n) + 2}")
            i += 1 + len(n)
            if replacement[i : i + 1].isdigit():
                # a digit that follows must not become part of the number
                out.append("\\")
        elif c in "$\\":
            out.append("\\" + c)
            i += 1
        else:
            out.append(c)
            i += 1
    whole = rf"\A([\s\S]*?)({pattern(regex, 2)})([\s\S]*)\z"
    middle = "".join(out)
    return F.regexp_replace(value, F.lit(whole), F.lit("$1" + ("\\" if middle[:1].isdigit() else "") + middle + f"${groups + 3}"))


def _reference(digits: str, groups: int) -> str | None:
    for d in (digits, digits[:1]):
        if 1 <= int(d) <= groups:
            return d
    return None


def resolve_iri(relative: Column | str, base: Column) -> Column:
    """A reference resolved against a base IRI (RFC 3986, section 5.2; schemes without // included)."""
    r = relative if isinstance(relative, Column) else F.lit(relative)
    part = lambda x, rx: F.regexp_extract(x, rx, 1)
    scheme, authority = part(base, r"^([^:/?#]+:)"), part(base, r"^[^:/?#]+:(//[^/?#]*)")
    path, query = part(base, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)"), part(base, r"^[^?#]*(\?[^#]*)")
    r_path, r_tail = part(r, r"^([^?#]*)"), F.regexp_replace(r, r"^[^?#]*", "")
    folder = part(path, r"^([\s\S]*/)")
    merged = F.when((authority != "") & (path == ""), F.concat(F.lit("/"), r_path)).otherwise(F.concat(folder, r_path))
    front = F.concat(scheme, authority)
    return (
        F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme, r))
        .when(r == "", F.regexp_replace(base, "#[\\s\\S]*", ""))
        .when(r.startswith("#"), F.concat(front, path, query, r))
        .when(r.startswith("?"), F.concat(front, path, r))
        .when(r.startswith("/"), F.concat(front, _without_dots(r_path), r_tail))
        .otherwise(F.concat(front, _without_dots(merged), r_tail))
    )


def _without_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    rooted = F.when(path.startswith("/"), F.lit(1)).otherwise(F.lit(0))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, rooted))
    done = F.aggregate(
        segments, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.when(F.size(a) > rooted, up(a)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), F.array_join(closed, "/")).otherwise(path)


def _by_arrow(f, kind: str):
    """A user-defined function of a text column from f, which gets a batch's distinct texts and gives a number for each."""

    def column(texts: pa.Array) -> pa.Array:
        found = texts.cast(pa.large_string()).dictionary_encode()
        made = f(found.dictionary)
        return pa.array(made).take(found.indices)

    return F.arrow_udf(column, kind)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string array without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _murmur(texts: pa.Array) -> np.ndarray:
    """All texts step by step side by side, those of most blocks first."""
    at, data = _bytes(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    if len(data) and data.max() > 127:
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
        data = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    codes = np.concatenate((data.astype(np.uint32), np.zeros(4, np.uint32)))
    order = np.argsort(-np.diff(at), kind="stable")
    starts, lengths = at[:-1][order], np.diff(at)[order]
    u = np.uint32

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * u(0xCC9E2D51)
        return (k << u(15) | k >> u(17)) * u(0x1B873593)

    def block(a, b, c, d) -> np.ndarray:
        return mixed(a ^ b << u(8) ^ c << u(16) ^ (d & u(255)) << u(24) ^ (d & u(0xFF00)) >> u(8))

    h = np.zeros(len(order), np.uint32)
    full = lengths // 4
    for i in range(int(full[0]) if len(full) else 0):
        n = int(np.searchsorted(-full, -i, "left"))
        first = starts[:n] + 4 * i
        x = h[:n] ^ block(*(codes[first + j] for j in range(4)))
        h[:n] = (x << u(13) | x >> u(19)) * u(5) + u(0xE6546B64)
    # a block that the text does not fill is zero beyond it, and zero changes nothing
    rest = starts + 4 * full
    h ^= block(*(np.where(4 * full + j < lengths, codes[rest + j], u(0)) for j in range(4)))
    h ^= lengths.astype(np.uint32)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    out = np.empty(len(order), np.int64)
    out[order] = h ^ h >> u(16)
    return out


def _fnv(texts: pa.Array, basis: int) -> np.ndarray:
    at, data = _bytes(texts)
    order = np.argsort(-np.diff(at), kind="stable")
    starts, lengths = at[:-1][order], np.diff(at)[order]
    h = np.full(len(order), basis, np.uint32)
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i, "left"))
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint32(0x01000193)
    out = np.empty(len(order), np.int64)
    out[order] = h
    return out


def murmur3_32(value: Column) -> Column:
    """MurmurHash3 x86-32, seed 0, as a number from 0 to 2^32 - 1. Characters count as their code (below 256: as bytes)."""
    return _by_arrow(_murmur, "bigint")(value)


def fnv1a_32(value: Column, basis: int = 0x811C9DC5) -> Column:
    """FNV-1a, 32 bits, of a text's UTF-8 bytes."""
    return _by_arrow(partial(_fnv, basis=basis), "bigint")(value)


def hex32(number: Column) -> Column:
    """Lower-case hexadecimal without leading zeros."""
    return F.lower(F.hex(number))


def code_sum(value: Column) -> Column:
    """The sum of a text's code points; one beyond the first plane counts its low surrogate too, as UTF-16 does."""
    surrogate = lambda c: F.when(c > 65_535, c + 56_320 + (c - 65_536) % 1024).otherwise(c)
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + surrogate(c))
