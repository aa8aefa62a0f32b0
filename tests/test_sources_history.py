"""Files made by hand and read back; orders, blame and renames on small histories."""

import hashlib
import struct
import zlib

from annalist import sources
from annalist.operators import history
from annalist.sources import files


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def entry(kind, size, data, head=b""):
    first, rest = kind << 4 | size & 15, size >> 4
    return (bytes([first | 128]) + varint(rest) if rest else bytes([first])) + head + zlib.compress(data)


def pack():
    base = b"hello world, hello again\n" * 3
    delta = varint(len(base)) + varint(len(base) + 4) + b"\x90" + bytes([len(base)]) + b"\x04more"
    one = entry(3, len(base), base)
    two = entry(6, len(delta), delta, bytes([len(one)]))
    three = entry(7, len(delta), delta, bytes.fromhex(files.object_id("blob", base)))
    raw = b"PACK" + struct.pack(">II", 2, 3) + one + two + three
    return raw + hashlib.sha1(raw).digest(), base


def test_objects(spark, tmp_path):
    store = tmp_path / "objects"
    tree = b"100644 a\0" + b"\1" * 20 + b"40000 d\0" + b"\2" * 20
    commit = b"tree " + b"a" * 40 + b"\nparent " + b"b" * 40 + b"\nparent " + b"c" * 40 + b"\nauthor A <a@b> 1 +0000\ncommitter C <c@d> 2 +0000\n\nsubject\n\nbody\n"
    for kind, body in (("blob", b""), ("blob", b"x" * 5000), ("tree", tree), ("commit", commit)):
        oid = files.object_id(kind, body)
        (store / oid[:2]).mkdir(parents=True, exist_ok=True)
        (store / oid[:2] / oid[2:]).write_bytes(zlib.compress(f"{kind} {len(body)}\0".encode() + body))
    (store / "ab").mkdir(exist_ok=True)
    (store / "ab" / ("0" * 38)).write_bytes(b"junk")
    found = sources.loose_objects(spark, str(store))
    assert found.where("error is not null").count() == 1
    good = found.where("error is null").cache()
    assert {(r.oid, r.type, r.size) for r in good.collect()} >= {(hashlib.sha1(b"blob 0\0").hexdigest(), "blob", 0)}
    assert [(r.ord, r.mode, bytes(r.name), r.oid[:2]) for r in sources.tree_entries(good).orderBy("ord").collect()] == [(0, 0o100644, b"a", "01"), (1, 0o40000, b"d", "02")]
    c = sources.commits(good).first()
    assert (c.tree, c.parents, c.author, c.message) == ("a" * 40, ["b" * 40, "c" * 40], "A <a@b> 1 +0000", "subject\n\nbody\n")
    assert sources.loose_objects(spark, str(store), most=100).where("error like '%beyond%'").count() == 2


def test_packs(spark, tmp_path):
    raw, base = pack()
    (tmp_path / "p.pack").write_bytes(raw)
    (tmp_path / "bad.pack").write_bytes(raw[:-1] + b"?")
    rows = sources.packed_objects(spark, str(tmp_path)).collect()
    good = sorted((r for r in rows if not r.error), key=lambda r: r.offset)
    assert [(bytes(r.body), r.depth) for r in good] == [(base, 0), (base + b"more", 1), (base + b"more", 1)]
    assert sum("checksum" in (r.error or "") for r in rows) == 1
    ids = sorted({bytes.fromhex(r.oid) for r in good})
    fan = b"".join(struct.pack(">I", sum(i[0] <= b for i in ids)) for b in range(256))
    (tmp_path / "p.idx").write_bytes(b"\xfftOc" + struct.pack(">I", 2) + fan + b"".join(ids) + struct.pack(">II", 7, 8) + struct.pack(">II", 12, 0x80000000) + struct.pack(">Q", 1 << 33) + bytes(40))
    assert [(r.oid, r.crc, r.offset) for r in sources.pack_index(spark, str(tmp_path)).collect()] == [(ids[0].hex(), 7, 12), (ids[1].hex(), 8, 1 << 33)]


def test_text_files(spark, tmp_path):
    (tmp_path / "packed-refs").write_text("# pack-refs with: peeled\n" + "a" * 40 + " refs/heads/x\n" + "b" * 40 + " refs/tags/t\n^" + "c" * 40 + "\n")
    assert [(r.name, r.peeled) for r in sources.packed_refs(spark, str(tmp_path / "packed-refs")).collect()] == [("refs/heads/x", None), ("refs/tags/t", "c" * 40)]
    (tmp_path / "one").write_text('[core]\n\tbare = false ; note\n[remote "o\\"x"]\n url = "a # b" c\\\n d\n flag\n')
    (tmp_path / "two").write_text("[Core]\nBARE = true\n[broken\n")
    (tmp_path / "three").write_text("[core]\nbare = yes\n")
    rows = sources.config(spark, {"system": str(tmp_path / "one"), "global": str(tmp_path / "three"), "local": str(tmp_path / "two")})
    assert rows.where("error is not null").count() == 1
    last = {(r.section, r.subsection, r.key): (r.value, r.scope) for r in sources.config_last(rows).collect()}
    assert last == {("core", None, "bare"): ("true", "local"), ("remote", 'o"x', "url"): ("a # b c d", "system"), ("remote", 'o"x', "flag"): (None, "system")}
    (tmp_path / "box").write_text("From a Mon\nFrom: A <a@b>\nSubject: [PATCH 1/2] Re: fix\n it\nDate: now\n\nbody\n>From here\nFrom b Tue\nSubject: two\n\nx\n")
    assert [(r.n, r.subject, r.body) for r in sources.mailbox(spark, str(tmp_path / "box")).collect()] == [(0, "fix it", "body\nFrom here\n"), (1, "two", "x\n")]
    (tmp_path / "map").write_text("# c\nProper <p@x>\nFull <f@x> Old Name <o@x>\nOther <n@x> <o@x>\n")
    people = spark.createDataFrame([("p", "P@x"), ("old name", "o@x"), ("else", "o@x"), ("no", "no@x")], "name string, email string")
    got = {(r.name, r.mapped_name, r.mapped_email) for r in sources.mapped_identities(people, sources.mailmap(spark, str(tmp_path / "map"))).collect()}
    assert got == {("p", "Proper", "P@x"), ("old name", "Full", "f@x"), ("else", "Other", "n@x"), ("no", "no", "no@x")}
    (tmp_path / "diff").write_text("--- a/f\n+++ b/f\n@@ -1 +1,2 @@\n x\n+y\n")
    r = sources.patches(spark, str(tmp_path / "diff")).first()
    assert (r.old, r.new, r.old_lines, r.new_lines) == ("a/f", "b/f", 1, 2)


def test_staging_index(spark, tmp_path):
    def row(path, stage, version, last=b""):
        head = struct.pack(">10I", 0, 0, 9, 0, 0, 0, 0o100644, 0, 0, len(path)) + b"\5" * 20 + struct.pack(">H", stage << 12 | len(path))
        if version == 4:
            return head + bytes([len(last)]) + path + b"\0"
        return head + path + b"\0" * (8 - (62 + len(path)) % 8)

    for version in (2, 4):
        raw = b"DIRC" + struct.pack(">II", version, 2) + row(b"a", 0, version) + row(b"dir/long-name", 2, version, b"a")
        (tmp_path / "index").write_bytes(raw + hashlib.sha1(raw).digest())
        assert [(r.path, r.stage, r["size"], r.mtime) for r in sources.staging_index(spark, str(tmp_path / "index")).collect()] == [("a", 0, 1, 9), ("dir/long-name", 2, 13, 9)]


def test_orders(spark):
    pairs = [("b", "a", 0), ("d", "b", 0), ("f", "d", 0), ("c", "a", 0), ("e", "c", 0), ("f", "e", 1)]
    names = dict(a=1, b=2, c=3, d=4, e=5, f=6, x=7)
    edges = spark.createDataFrame([(names[c], names[p], o) for c, p, o in pairs], "child long, parent long, ord int")

    def walk(order, **time):
        time = dict(a=1, b=3, c=2, d=5, e=4, f=6, x=0) | time
        rows = history.ordered(spark.createDataFrame([(names[n], t) for n, t in time.items()], "id long, time long"), edges, order).orderBy("rank").collect()
        return "".join(next(n for n, i in names.items() if i == r.id) for r in rows)

    assert walk("date") == "fdebcax"
    assert walk("date", c=9) == "fdecbax"  # a newer parent waits for its child
    assert walk("topo") in ("fecdbax", "fdbecax")


def test_blame_and_renames(spark):
    rows = [("p", 1, "a\nb"), ("p", 2, "a\nx\nb"), ("p", 3, "x\nb\nc"), ("q", 5, "only")]
    got = sorted((r.path, r.line, r.text, r.version) for r in history.blame(spark.createDataFrame(rows, "path string, version long, text string")).collect())
    assert got == [("p", 1, "x", 2), ("p", 2, "b", 1), ("p", 3, "c", 3), ("q", 1, "only", 5)]
    body = "\n".join(f"line {i}" for i in range(20))
    old = spark.createDataFrame([("o1", body), ("o2", "other")], "path string, text string")
    new = spark.createDataFrame([("n1", body + "\nmore"), ("n2", "nothing"), ("n3", "other")], "path string, text string")
    assert sorted((r.old, r.new) for r in history.renames(old, new).collect()) == [("o1", "n1"), ("o2", "n3")]
