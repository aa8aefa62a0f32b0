"""Readers of repository files as DataFrames: loose objects, packs, staging indexes, packed refs, config, mail boxes, patches.

Files come through Spark's own readers (``binaryFile``), so any store that Spark reads will do; a row is a
file, parsed in an Arrow batch.  Damaged input gives a row whose ``error`` says why; other files go on.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.text_diff import parse_patch

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def _each(spark: SparkSession, path: str, schema: str, parse: Callable[[str, bytes], Iterator[dict]], glob: str | None = None) -> DataFrame:
    """Rows that ``parse`` makes of each file below ``path``, and a row with ``error`` for a file that it can't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    columns = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)] + ["error"]
    arrow = pa.schema(_fields(schema) + [("error", pa.string())])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    rows.extend(parse(name, content))
                except (ValueError, IndexError, KeyError, struct.error, zlib.error) as e:
                    rows.append({"error": f"{name}: {e}"})
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in columns} for r in rows], schema=arrow)

    return files.mapInArrow(run, f"{schema}, error string")


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return [(c.split()[0], kinds[c.split()[1]]) for c in re.split(r",\s*", schema)]


def object_id(kind: str, body: bytes, algorithm: str = "sha1") -> str:
    return hashlib.new(algorithm, f"{kind} {len(body)}\0".encode() + body).hexdigest()


def inflate(data: bytes, most: int) -> tuple[bytes, int]:
    """(content, bytes read) of a zlib stream; more than ``most`` bytes of content raise ValueError."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError(f"content beyond {most} bytes")
    if not stream.eof:
        out += stream.flush()
    if not stream.eof:
        raise ValueError("the zlib stream is cut")
    return out, len(data) - len(stream.unused_data)


def loose_objects(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """(oid, type, size, body, error) of the two-level loose object folders below ``path``; content and name must agree."""

    def parse(name: str, content: bytes):
        m = re.search(r"/([0-9a-f]{2})/([0-9a-f]{38}|[0-9a-f]{62})$", name)
        if not m:
            return
        raw, _ = inflate(content, most + 64)
        head, _, body = raw.partition(b"\0")
        kind, _, size = head.decode().partition(" ")
        if kind not in KINDS.values() or int(size) != len(body):
            raise ValueError("bad object header")
        oid = m[1] + m[2]
        if object_id(kind, body, "sha1" if len(oid) == 40 else "sha256") != oid:
            raise ValueError("the content has another id")
        yield {"oid": oid, "type": kind, "size": len(body), "body": body}

    return _each(spark, path, "oid string, type string, size long, body binary", parse)


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta (copies from ``base`` and inserts) describes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    if number() != len(base):
        raise ValueError("the delta has another base size")
    size, out = number(), bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            place = length = 0
            for i in range(7):
                if op & (1 << i):
                    if i < 4:
                        place |= delta[at] << 8 * i
                    else:
                        length |= delta[at] << 8 * (i - 4)
                    at += 1
            length = length or 0x10000
            if place + length > len(base):
                raise ValueError("the delta copies beyond its base")
            out += base[place : place + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("reserved delta instruction")
    if len(out) != size:
        raise ValueError("the delta makes another size")
    return bytes(out)


def pack_entries(content: bytes, most: int = 1 << 30) -> Iterator[dict]:
    """Entries of a pack in storage order, deltas resolved along their chains (bases before, by place or by id)."""
    if content[:4] != b"PACK" or struct.unpack(">I", content[4:8])[0] not in (2, 3):
        raise ValueError("not a pack")
    if hashlib.sha1(content[:-20]).digest() != content[-20:]:
        raise ValueError("the pack's checksum is wrong")
    at, count = 12, struct.unpack(">I", content[8:12])[0]
    whole: dict[int, tuple[str, bytes, int]] = {}
    by_id: dict[bytes, int] = {}
    for _ in range(count):
        start = at
        byte = content[at]
        at += 1
        kind, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 128:
            byte = content[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
        base = None
        if kind == 6:
            byte = content[at]
            at += 1
            back = byte & 127
            while byte & 128:
                byte = content[at]
                at += 1
                back = (back + 1) << 7 | byte & 127
            base = start - back
        elif kind == 7:
            base = by_id.get(content[at : at + 20])
            at += 20
        data, used = inflate(content[at:], min(most, size))
        at += used
        if len(data) != size:
            raise ValueError(f"the entry at {start} has another size")
        depth = 0
        if kind in (6, 7):
            if base not in whole:
                raise ValueError(f"the base of the delta at {start} is missing")
            name, body, depth = whole[base]
            data, depth = apply_delta(body, data), depth + 1
        elif kind in KINDS:
            name = KINDS[kind]
        else:
            raise ValueError(f"unknown entry type {kind}")
        oid = object_id(name, data)
        whole[start], by_id[bytes.fromhex(oid)] = (name, data, depth), start
        yield {"oid": oid, "type": name, "size": len(data), "body": data, "offset": start, "depth": depth}


def packed_objects(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """(pack, oid, type, size, body, offset, depth, error) of the ``.pack`` files below ``path``."""

    def parse(name: str, content: bytes):
        for entry in pack_entries(content, most):
            yield {"pack": name.rsplit("/", 1)[-1], **entry}

    return _each(spark, path, "pack string, oid string, type string, size long, body binary, offset long, depth int", parse, "*.pack")


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """(pack, oid, crc, offset, error) of version 2 ``.idx`` files."""

    def parse(name: str, content: bytes):
        if content[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("not a version 2 index")
        n = struct.unpack(">I", content[8 + 255 * 4 : 8 + 256 * 4])[0]
        ids = 8 + 1024
        crcs, places, large = ids + 20 * n, ids + 24 * n, ids + 28 * n
        for i in range(n):
            place = struct.unpack(">I", content[places + 4 * i : places + 4 * i + 4])[0]
            if place >> 31:
                at = large + 8 * (place & 0x7FFFFFFF)
                place = struct.unpack(">Q", content[at : at + 8])[0]
            yield {"pack": name.rsplit("/", 1)[-1].removesuffix(".idx"), "oid": content[ids + 20 * i : ids + 20 * i + 20].hex(), "crc": struct.unpack(">I", content[crcs + 4 * i : crcs + 4 * i + 4])[0], "offset": place}

    return _each(spark, path, "pack string, oid string, crc long, offset long", parse, "*.idx")


def staging_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, stage, mode, oid, size, mtime, flags, error) of an index file of version 2, 3 or 4."""

    def parse(name: str, content: bytes):
        if content[:4] != b"DIRC":
            raise ValueError("not an index")
        version, count = struct.unpack(">II", content[4:12])
        if version not in (2, 3, 4):
            raise ValueError(f"index version {version}")
        at, last = 12, b""
        for _ in range(count):
            start = at
            mtime, mode, size = struct.unpack(">I", content[at + 8 : at + 12])[0], struct.unpack(">I", content[at + 24 : at + 28])[0], struct.unpack(">I", content[at + 36 : at + 40])[0]
            oid, flags = content[at + 40 : at + 60].hex(), struct.unpack(">H", content[at + 60 : at + 62])[0]
            at += 62 + 2 * bool(flags & 0x4000)
            if version == 4:
                byte = content[at]
                at += 1
                cut = byte & 127
                while byte & 128:
                    byte = content[at]
                    at += 1
                    cut = (cut + 1) << 7 | byte & 127
                end = content.index(b"\0", at)
                last = last[: len(last) - cut] + content[at:end]
                at = end + 1
            else:
                end = content.index(b"\0", at)
                last = content[at:end]
                at = start + (end - start) // 8 * 8 + 8
            yield {"path": last.decode("utf-8", "surrogateescape"), "stage": flags >> 12 & 3, "mode": mode, "oid": oid, "size": size, "mtime": mtime, "flags": flags}

    return _each(spark, path, "path string, stage int, mode int, oid string, size long, mtime long, flags int", parse)


def tree_entries(objects: DataFrame) -> DataFrame:
    """(tree, ord, mode, name, oid) of the tree objects of ``objects`` (oid, type, body)."""

    def run(batches):
        for batch in batches:
            rows = []
            for tree, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = n = 0
                while at < len(body):
                    space, end = body.index(b" ", at), body.index(b"\0", at)
                    rows.append({"tree": tree, "ord": n, "mode": int(body[at:space], 8), "name": body[space + 1 : end], "oid": body[end + 1 : end + 21].hex()})
                    at, n = end + 21, n + 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("tree", pa.string()), ("ord", pa.int32()), ("mode", pa.int32()), ("name", pa.binary()), ("oid", pa.string())]))

    return objects.where("type = 'tree'").select("oid", "body").mapInArrow(run, "tree string, ord int, mode int, name binary, oid string")


def commits(objects: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, committer, encoding, message) of commit objects, by expressions only."""
    text = F.decode("body", "UTF-8")
    head = F.substring_index(text, "\n\n", 1)
    one = lambda key: F.nullif(F.regexp_extract(head, rf"(?m)^{key} (.*)$", 1), F.lit(""))
    message = F.when(F.locate("\n\n", text) > 0, F.substring(text, F.locate("\n\n", text) + 2, F.lit(1 << 30))).otherwise("")
    return objects.where("type = 'commit'").select("oid", one("tree").alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), 1).alias("parents"), one("author").alias("author"), one("committer").alias("committer"), one("encoding").alias("encoding"), message.alias("message"))


def packed_refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid, peeled, error) of a packed-refs file; a ``^`` line is the peeled value of the ref above."""

    def parse(name: str, content: bytes):
        held = None
        for line in content.decode().split("\n"):
            if not line or line.startswith("#"):
                continue
            if line.startswith("^"):
                if held is None:
                    raise ValueError("a peeled line without a ref")
                held["peeled"] = line[1:]
                continue
            if held:
                yield held
            oid, _, ref = line.partition(" ")
            if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", oid) or not ref:
                raise ValueError(f"bad line {line!r}")
            held = {"name": ref, "oid": oid, "peeled": None}
        if held:
            yield held

    return _each(spark, path, "name string, oid string, peeled string", parse)


def config_rows(text: str) -> Iterator[dict]:
    """(section, subsection, key, value) in order; a key without ``=`` has a null value."""
    section, sub = None, None
    for raw in re.sub(r"\\\r?\n", "", text).split("\n"):
        line = raw.strip()
        if m := re.match(r'\[([A-Za-z0-9.-]+)(?:\s+"((?:[^"\\]|\\.)*)")?\]', line):
            section, sub = m[1].lower(), re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else None
            line = line[m.end() :].strip()
        if not line or line[0] in "#;":
            continue
        m = re.match(r"([A-Za-z][A-Za-z0-9-]*)\s*(=)?\s*", line)
        if not m or section is None:
            raise ValueError(f"bad config line {raw!r}")
        value = None
        if m[2]:
            value, quoted, keep, i, rest = "", False, 0, 0, line[m.end() :]
            while i < len(rest):
                c = rest[i]
                if c == "\\":
                    i += 1
                    value += {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}[rest[i]]
                    keep = len(value)
                elif c == '"':
                    quoted = not quoted
                    keep = len(value)
                elif c in "#;" and not quoted:
                    break
                else:
                    value += c
                    keep = len(value) if quoted or not c.isspace() else keep
                i += 1
            if quoted:
                raise ValueError(f"unclosed quotes in {raw!r}")
            value = value[:keep]
        yield {"section": section, "subsection": sub, "key": m[1].lower(), "value": value}


def config(spark: SparkSession, scopes: dict[str, str]) -> DataFrame:
    """(scope, seq, section, subsection, key, value, error) of config files by scope; later scopes of the dict win."""
    out = None
    for rank, (scope, path) in enumerate(scopes.items()):

        def parse(name: str, content: bytes):
            for seq, row in enumerate(config_rows(content.decode())):
                yield {"seq": seq, **row}

        rows = _each(spark, path, "seq long, section string, subsection string, key string, value string", parse).select(F.lit(rank).alias("rank"), F.lit(scope).alias("scope"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def config_last(rows: DataFrame) -> DataFrame:
    """(section, subsection, key, value, scope): the last value of each key."""
    last = F.max_by(F.struct("value", "scope"), F.struct("rank", "seq")).alias("v")
    return rows.where("error is null").groupBy("section", "subsection", "key").agg(last).select("section", "subsection", "key", "v.value", "v.scope")


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """(n, sender, date, subject, body, error) of mbox files; ``[PATCH n/m]`` prefixes are cut from subjects, folded headers joined."""

    def parse(name: str, content: bytes):
        text = content.decode("utf-8", "replace").replace("\r\n", "\n")
        for n, mail in enumerate(re.split(r"(?m)^From .*\n", text)[1:]):
            head, _, body = mail.partition("\n\n")
            fields = dict(re.findall(r"(?m)^([A-Za-z-]+): *(.*)$", re.sub(r"\n[ \t]+", " ", head)))
            subject = re.sub(r"^(?:\s*(?:[Rr][Ee]:|\[[^\]]*\]))*\s*", "", fields.get("Subject", ""))
            yield {"n": n, "sender": fields.get("From"), "date": fields.get("Date"), "subject": subject, "body": re.sub(r"(?m)^>(>*From )", r"\1", body)}

    return _each(spark, path, "n long, sender string, date string, subject string, body string", parse)


def patches(spark: SparkSession, path: str) -> DataFrame:
    """(old, new, hunk, old_start, old_lines, new_start, new_lines, lines, error): a row per hunk of unified diffs."""

    def parse(name: str, content: bytes):
        for f in parse_patch(content.decode("utf-8", "replace")):
            for i, h in enumerate(f["hunks"]):
                yield {"old": f["old"], "new": f["new"], "hunk": i, **{k: h[k] for k in ("old_start", "old_lines", "new_start", "new_lines")}, "lines": json.dumps(h["lines"])}

    return _each(spark, path, "old string, new string, hunk long, old_start long, old_lines long, new_start long, new_lines long, lines string", parse)


def mailmap(spark: SparkSession, path: str) -> DataFrame:
    """(name, email, old_name, old_email, error) of mailmap files; old names and e-mails are lower case, for the join."""

    def parse(_: str, content: bytes):
        for line in content.decode("utf-8", "replace").split("\n"):
            m = re.match(r"\s*([^<#]*?)\s*<([^>]*)>\s*(?:([^<]*?)\s*<([^>]*)>)?", line)
            if line.lstrip().startswith("#") or not m:
                continue
            two = m[4] is not None
            yield {"name": m[1] or None, "email": m[2] if two else None, "old_name": (m[3] or "").lower() or None if two else None, "old_email": (m[4] if two else m[2]).lower()}

    return _each(spark, path, "name string, email string, old_name string, old_email string", parse)


def mapped_identities(people: DataFrame, rows: DataFrame) -> DataFrame:
    """``people`` (name, email) with their canonical ones: an entry for name and e-mail wins over one for the e-mail alone."""
    both = rows.where("old_name is not null").select(F.col("old_name").alias("k_name"), F.col("old_email").alias("k_both"), F.struct("name", "email").alias("full")).dropDuplicates(["k_name", "k_both"])
    mail = rows.where("old_name is null and error is null").groupBy(F.col("old_email").alias("k_mail")).agg(F.last("name", True).alias("m_name"), F.last("email", True).alias("m_email"))
    p = people.join(both, (F.lower("name") == F.col("k_name")) & (F.lower("email") == F.col("k_both")), "left").join(mail, F.lower("email") == F.col("k_mail"), "left")
    pick = lambda c: F.coalesce(F.col(f"full.{c}"), F.col(f"m_{c}"), F.col(c)).alias(f"mapped_{c}")
    return p.select(*people.columns, pick("name"), pick("email"))
