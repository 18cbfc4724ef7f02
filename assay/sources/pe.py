"""Windows executables to raw records, by the published file format alone: headers, sections, imports, exports, directories.

Files that aren't executables, or end before their headers do, give the parts that any file has and empty ones else.
Signatures are counted, not checked.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format.
MACHINES = {0x14C: "I386", 0x8664: "AMD64", 0x1C0: "ARM", 0x1C4: "ARMNT", 0xAA64: "ARM64", 0x200: "IA64"}
SUBSYSTEMS = {1: "NATIVE", 2: "WINDOWS_GUI", 3: "WINDOWS_CUI", 5: "OS2_CUI", 7: "POSIX_CUI", 9: "WINDOWS_CE_GUI", 10: "EFI_APPLICATION", 14: "XBOX"}
FILE_FLAGS = ["RELOCS_STRIPPED", "EXECUTABLE_IMAGE", "LINE_NUMS_STRIPPED", "LOCAL_SYMS_STRIPPED", "AGGRESIVE_WS_TRIM", "LARGE_ADDRESS_AWARE", "16BIT_MACHINE", "BYTES_REVERSED_LO", "32BIT_MACHINE", "DEBUG_STRIPPED", "REMOVABLE_RUN_FROM_SWAP", "NET_RUN_FROM_SWAP", "SYSTEM", "DLL", "UP_SYSTEM_ONLY", "BYTES_REVERSED_HI"]
DLL_FLAGS = {5: "HIGH_ENTROPY_VA", 6: "DYNAMIC_BASE", 7: "FORCE_INTEGRITY", 8: "NX_COMPAT", 9: "NO_ISOLATION", 10: "NO_SEH", 11: "NO_BIND", 12: "APPCONTAINER", 13: "WDM_DRIVER", 14: "GUARD_CF", 15: "TERMINAL_SERVER_AWARE"}
SECTION_FLAGS = {5: "CNT_CODE", 6: "CNT_INITIALIZED_DATA", 7: "CNT_UNINITIALIZED_DATA", 25: "MEM_DISCARDABLE", 26: "MEM_NOT_CACHED", 27: "MEM_NOT_PAGED", 28: "MEM_SHARED", 29: "MEM_EXECUTE", 30: "MEM_READ", 31: "MEM_WRITE"}
DIRECTORIES = ["EXPORT", "IMPORT", "RESOURCE", "EXCEPTION", "SECURITY", "BASERELOC", "DEBUG", "COPYRIGHT", "GLOBALPTR", "TLS", "LOAD_CONFIG", "BOUND_IMPORT", "IAT", "DELAY_IMPORT", "COM_DESCRIPTOR", "RESERVED"]
DOS = ["e_magic", "e_cblp", "e_cp", "e_crlc", "e_cparhdr", "e_minalloc", "e_maxalloc", "e_ss", "e_sp", "e_csum", "e_ip", "e_cs", "e_lfarlc", "e_ovno"]
OPTIONAL = [("magic", "H", 0), ("major_linker_version", "B", 2), ("minor_linker_version", "B", 3), ("sizeof_code", "I", 4), ("sizeof_initialized_data", "I", 8), ("sizeof_uninitialized_data", "I", 12), ("address_of_entrypoint", "I", 16), ("base_of_code", "I", 20), ("section_alignment", "I", 32), ("major_operating_system_version", "H", 40), ("minor_operating_system_version", "H", 42), ("major_image_version", "H", 44), ("minor_image_version", "H", 46), ("major_subsystem_version", "H", 48), ("minor_subsystem_version", "H", 50), ("sizeof_image", "I", 56), ("sizeof_headers", "I", 60), ("checksum", "I", 64)]


def entropy(data: bytes) -> float:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = n[n > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


class Executable:
    """Offsets and tables of one file; struct.error or ValueError if it isn't one."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] != b"MZ":
            raise ValueError("no executable")
        self.head = self.int("I", 60)
        if data[self.head : self.head + 4] != b"PE\0\0":
            raise ValueError("no executable")
        self.machine, self.n_sections, self.time, self.symbols_at, self.n_symbols, self.optional_size, self.flags = struct.unpack_from("<HHIIIHH", data, self.head + 4)
        self.optional = self.head + 24
        self.wide = self.int("H", self.optional) == 0x20B
        rest = self.optional + (112 if self.wide else 96)
        self.n_directories = self.int("I", rest - 4)
        self.directories = [struct.unpack_from("<II", data, rest + 8 * i) for i in range(min(self.n_directories, 16))]
        at = self.optional + self.optional_size
        # name, virtual size, address, raw size, raw offset, flags
        self.sections = []
        for i in range(self.n_sections):
            name, vsize, va, size, raw, *_, flags = struct.unpack_from("<8sIIIIIIHHI", data, at + 40 * i)
            self.sections.append((name.strip(b"\0").decode(errors="ignore").lower(), vsize, va, size, raw, flags))

    def int(self, kind: str, at: int) -> int:
        return struct.unpack_from("<" + kind, self.data, at)[0]

    def offset(self, address: int) -> int:
        """Place in the file of an address in memory."""
        for _, vsize, va, size, raw, _ in self.sections:
            if va <= address < va + max(vsize, size):
                return raw + address - va
        raise ValueError(f"address {address} is in no section")

    def text(self, address: int, most: int = 10_000) -> str:
        at = self.offset(address)
        return self.data[at : at + most].split(b"\0", 1)[0].decode(errors="ignore")


def header(x: Executable) -> dict:
    bits = lambda value, table: [n for i, n in (enumerate(table) if isinstance(table, list) else table.items()) if value >> i & 1]
    coff = {"timestamp": x.time, "machine": MACHINES.get(x.machine, "UNKNOWN"), "number_of_sections": x.n_sections, "number_of_symbols": x.n_symbols, "sizeof_optional_header": x.optional_size, "pointer_to_symbol_table": x.symbols_at, "characteristics": bits(x.flags, FILE_FLAGS)}
    own = {name: x.int(kind, x.optional + at) for name, kind, at in OPTIONAL}
    own["subsystem"] = SUBSYSTEMS.get(x.int("H", x.optional + 68), "UNKNOWN")
    own["dll_characteristics"] = bits(x.int("H", x.optional + 70), DLL_FLAGS)
    kind, size = ("Q", 8) if x.wide else ("I", 4)
    own["image_base"] = x.int(kind, x.optional + (24 if x.wide else 28))
    own |= {name: x.int(kind, x.optional + 72 + size * i) for i, name in enumerate(("sizeof_stack_reserve", "sizeof_stack_commit", "sizeof_heap_reserve", "sizeof_heap_commit"))}
    own["number_of_rvas_and_sizes"] = x.n_directories
    return {"coff": coff, "optional": own, "dos": dict(zip(DOS, struct.unpack_from("<14H", x.data), strict=True))}


def sections(x: Executable) -> dict:
    """Sections; the entry is the last one that holds the entry point, else the first that runs; what lies behind them all is the overlay."""
    start, whole = x.int("I", x.optional + 16), max(len(x.data), 1)
    holds = [s[0] for s in x.sections if s[2] <= start < s[2] + max(s[1], s[3])]
    runs = [s[0] for s in x.sections if s[5] >> 29 & 1]
    entry = next((n for n in reversed(holds) if n), next((n for n in runs if n), ""))
    rows = [{"name": n, "size": size, "entropy": entropy(x.data[raw : raw + size]), "vsize": vsize, "size_ratio": size / whole, "vsize_ratio": size / max(vsize, 1), "props": [f for i, f in SECTION_FLAGS.items() if flags >> i & 1]} for n, vsize, _, size, raw, flags in x.sections]
    tail = x.data[max((s[4] + s[3] for s in x.sections), default=len(x.data)) :]
    return {"entry": entry, "sections": rows, "overlay": {"size": len(tail), "size_ratio": len(tail) / whole, "entropy": entropy(tail)}}


def imports(x: Executable) -> dict[str, list[str]]:
    """Functions by library: names, or library:ordinalN."""
    out: dict[str, list[str]] = {}
    if len(x.directories) < 2 or not x.directories[1][0]:
        return out
    at, size = x.offset(x.directories[1][0]), 8 if x.wide else 4
    while any(row := struct.unpack_from("<IIIII", x.data, at)):
        names, _, _, library, thunk = row
        own = out.setdefault(x.text(library), [])
        entry = x.offset(names or thunk)
        while value := x.int("Q" if x.wide else "I", entry):
            by_number = value >> (8 * size - 1)
            own.append(f"{x.text(library)}:ordinal{value & 0xFFFF}" if by_number else x.text(value + 2))
            entry += size
        at += 20
    return out


def exports(x: Executable) -> list[str]:
    """Names in order of their table, then ordinals without one."""
    if not x.directories or not x.directories[0][0]:
        return []
    base, n, n_names, functions, names, ordinals = struct.unpack_from("<6I", x.data, x.offset(x.directories[0][0]) + 16)
    named = {x.int("H", x.offset(ordinals) + 2 * i): x.text(x.int("I", x.offset(names) + 4 * i)) for i in range(n_names)}
    return [named.get(i) or f"ordinal{base + i}" for i in range(n) if x.int("I", x.offset(functions) + 4 * i)]


def directories(x: Executable) -> list[dict]:
    relocs = int(len(x.directories) > 5 and x.directories[5][1] > 0)
    return [{"has_relocs": relocs, "has_dynamic_relocs": 0}, *({"name": n, "size": size, "virtual_address": va} for n, (va, size) in zip(DIRECTORIES, x.directories, strict=False))]


def rich_header(x: Executable) -> list[int]:
    """Pairs (tool, count) that linkers leave before the header, unmasked."""
    end = x.data.find(b"Rich", 0x40, x.head)
    if end < 0 or end + 8 > len(x.data):
        return []
    key = x.int("I", end + 4)
    words = [x.int("I", at) ^ key for at in range(end - 4, 0x3C, -4)][::-1]
    mark = int.from_bytes(b"DanS", "little")
    return words[words.index(mark) + 4 :] if mark in words else []


def signature(x: Executable) -> dict:
    """How many certificates are attached, and their bytes."""
    if len(x.directories) < 5 or not x.directories[4][1]:
        return {"num_certs": 0, "size": 0}
    at, size = x.directories[4]  # an offset in the file, unlike the others
    n, end = 0, min(at + size, len(x.data))
    while at + 8 <= end and (own := x.int("I", at)) >= 8:
        n, at = n + 1, at + -(-own // 8) * 8
    return {"num_certs": n, "size": size}


def record(data: bytes) -> dict:
    """The raw record of a file."""
    import hashlib

    out = {"sha256": hashlib.sha256(data).hexdigest(), "histogram": np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist(), "general": {"size": len(data), "entropy": entropy(data), "is_pe": 0, "start_bytes": [*data[:4], 0, 0, 0, 0][:4]}}
    empty = {"header": {}, "section": {}, "imports": {}, "exports": [], "datadirectories": [], "richheader": [], "authenticode": {}}
    try:
        x = Executable(data)
    except (ValueError, struct.error):
        return out | empty
    out["general"]["is_pe"] = 1
    for part, read in (("header", header), ("section", sections), ("imports", imports), ("exports", exports), ("datadirectories", directories), ("richheader", rich_header), ("authenticode", signature)):
        try:
            out[part] = read(x)
        except (ValueError, struct.error):  # a table that points nowhere
            out[part] = empty[part]
    return out


def records(files: DataFrame) -> DataFrame:
    """files (path, content) to (path, value): raw records as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = json.dumps(record(batch.column(1)[i].as_py() or b""))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([value])], ["path", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, value string")
