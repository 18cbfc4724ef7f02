"""Queries of executables: a small one for each second document, stamped with its length and with its text behind the last section; the others' texts behind
the two letters that executables begin with."""

import struct

from pyspark.sql import functions as F

from assay.catalog.files import _values
from assay.catalog.made import made
from assay.catalog.base import query
from assay.sources import pe
from assay.sources.corpora import table


def tiny(stamp: int = 1234, tail: bytes = b"end") -> bytes:
    """A 32-bit executable of two sections that imports two functions and exports one, with a tail."""
    body = bytearray(0x200)  # the second section: tables at address 0x2000
    put = lambda at, data: body.__setitem__(slice(at, at + len(data)), data)
    put(0, struct.pack("<5I5I", 0x2040, 0, 0, 0x2060, 0x2040, 0, 0, 0, 0, 0))
    put(0x40, struct.pack("<3I", 0x2080, 0x80000007, 0))
    put(0x60, b"KERNEL32.dll\0")
    put(0x80, b"\0\0ExitProcess\0")
    put(0xA0, struct.pack("<IIHHI", 0, 0, 0, 0, 0x2100) + struct.pack("<6I", 1, 2, 1, 0x20E0, 0x20F0, 0x20F8))
    put(0xE0, struct.pack("<2I", 0x1000, 0x1004))
    put(0xF0, struct.pack("<I", 0x2110))
    put(0xF8, struct.pack("<H", 0))
    put(0x110, b"run\0")
    optional = bytearray(96 + 128)
    struct.pack_into("<HBBIIII", optional, 0, 0x10B, 14, 1, 0x200, 0x200, 0, 0x1000)
    struct.pack_into("<I", optional, 28, 0x400000)
    struct.pack_into("<HHHHHH", optional, 40, 6, 0, 2, 3, 6, 1)
    struct.pack_into("<II", optional, 56, 0x3000, 0x200)
    struct.pack_into("<HH", optional, 68, 3, 0x140)
    struct.pack_into("<I", optional, 92, 16)
    struct.pack_into("<IIII", optional, 96, 0x20A0, 0x40, 0x2000, 0x28)
    section = lambda name, va, raw, flags: struct.pack("<8sIIIIIIHHI", name, 0x100, va, 0x200, raw, 0, 0, 0, 0, flags)
    head = b"MZ" + bytes(58) + struct.pack("<I", 0x80)
    key = 0x1234
    rich = b"".join(struct.pack("<I", w ^ key) for w in (int.from_bytes(b"DanS", "little"), 0, 0, 0, 0x105, 9)) + b"Rich" + struct.pack("<I", key)
    head = (head + rich).ljust(0x80, b"\0") + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 2, stamp, 0, 0, len(optional), 0x102) + optional + section(b".text", 0x1000, 0x200, 0x60000020) + section(b".DATA", 0x2000, 0x400, 0xC0000040)
    return head.ljust(0x200, b"\0") + b"\x90" * 0x200 + bytes(body) + tail


SIZE = len(tiny(0, b""))
_EXE = "doc_id % 2 = 0"
_BYTES = "octet_length(encode(coalesce(text, '')))"


def _file(doc_id: int, text: str | None) -> tuple[str, bytes]:
    text = text or ""
    return str(doc_id), tiny(len(text), text.encode()) if doc_id % 2 == 0 else b"MZ" + text.encode()


def _part(spark, sf, schema):
    files = made(table(spark, sf, "documents").select("doc_id", "text"), _file, "executables")
    return pe.records(files).select(F.col("path").cast("bigint").alias("doc_id"), F.from_json("value", schema).alias("r"))


def _each(rows, names):
    """SQL: these rows for each executable."""
    return f"SELECT doc_id, t.* FROM documents, ({_values(rows, names)}) t WHERE {_EXE}"


@query("pe_parse_v3", f"SELECT doc_id, (doc_id % 2 = 0)::BIGINT AS is_pe, {_BYTES} + CASE WHEN {_EXE} THEN {SIZE} ELSE 2 END AS size FROM documents")
def _(spark, sf):
    return _part(spark, sf, "general struct<is_pe:bigint,size:bigint>").select("doc_id", "r.general.*")


@query("pe_parse_v2", f"SELECT doc_id, ({_BYTES} + CASE WHEN {_EXE} THEN {SIZE} ELSE 2 END)::BIGINT AS counted FROM documents")
def _(spark, sf):
    return _part(spark, sf, "histogram array<bigint>").select("doc_id", F.aggregate("r.histogram", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("counted"))


@query("pe_sections", _each([(".text", 512, True, ".text"), (".data", 512, False, ".text")], ["name", "size", "runs", "entry"]))
def _(spark, sf):
    r = _part(spark, sf, "section struct<entry:string,sections:array<struct<name:string,size:bigint,props:array<string>>>>")
    return r.select("doc_id", F.col("r.section.entry").alias("entry"), F.explode("r.section.sections").alias("s")).select("doc_id", "s.name", "s.size", F.array_contains("s.props", "MEM_EXECUTE").alias("runs"), "entry")


@query("pe_imports", _each([("KERNEL32.dll", "ExitProcess"), ("KERNEL32.dll", "KERNEL32.dll:ordinal7")], ["library", "function"]))
def _(spark, sf):
    return _part(spark, sf, "imports map<string,array<string>>").select("doc_id", F.explode("r.imports").alias("library", "f")).select("doc_id", "library", F.explode("f").alias("function"))


@query("pe_exports", _each([("run",), ("ordinal2",)], ["name"]))
def _(spark, sf):
    return _part(spark, sf, "exports array<string>").select("doc_id", F.explode("r.exports").alias("name"))


@query("pe_header", f"SELECT doc_id, 'I386' AS machine, length(coalesce(text, ''))::BIGINT AS timestamp, 'WINDOWS_CUI' AS subsystem, 4194304::BIGINT AS image_base, 'EXECUTABLE_IMAGE,32BIT_MACHINE' AS flags, 'DYNAMIC_BASE,NX_COMPAT' AS dll_flags FROM documents WHERE {_EXE}")
def _(spark, sf):
    r = _part(spark, sf, "header struct<coff:struct<machine:string,timestamp:bigint,characteristics:array<string>>,optional:struct<subsystem:string,image_base:bigint,dll_characteristics:array<string>>>").where("doc_id % 2 = 0")
    h = F.col("r.header")
    return r.select("doc_id", h["coff"]["machine"].alias("machine"), h["coff"]["timestamp"].alias("timestamp"), h["optional"]["subsystem"].alias("subsystem"), h["optional"]["image_base"].alias("image_base"), F.array_join(h["coff"]["characteristics"], ",").alias("flags"), F.array_join(h["optional"]["dll_characteristics"], ",").alias("dll_flags"))


@query("pe_datadirs", _each([("EXPORT", 64, 0x20A0), ("IMPORT", 40, 0x2000)], ["name", "size", "virtual_address"]))
def _(spark, sf):
    return _part(spark, sf, "datadirectories array<struct<name:string,size:bigint,virtual_address:bigint>>").select("doc_id", F.inline("r.datadirectories")).where("size > 0")


@query("pe_rich", _each([(0x105, 9)], ["tool", "uses"]))
def _(spark, sf):
    return _part(spark, sf, "richheader array<bigint>").where("doc_id % 2 = 0").select("doc_id", F.col("r.richheader")[0].alias("tool"), F.col("r.richheader")[1].alias("uses"))


@query("pe_authenticode", _each([(0,)], ["num_certs"]))
def _(spark, sf):
    return _part(spark, sf, "authenticode struct<num_certs:bigint>").where("doc_id % 2 = 0").select("doc_id", "r.authenticode.num_certs")
