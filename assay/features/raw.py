"""Raw feature records (JSON objects of one file each) to fixed-width vectors, in two layouts.

A record says what a parser found: byte counts, strings, header fields, sections, imports, exports, directories.
Vectors are made for a whole Arrow batch: plain fields by position, names by the hashing trick.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.features.hashing import HashedBlocks, hash_bucket

# Fixed values of the second layout: groups with their widths, and the order of fields within them.
LAYOUT2 = {"histogram": 256, "byteentropy": 256, "strings": 104, "general": 10, "header": 62, "section": 255, "imports": 1280, "exports": 128, "datadirectories": 30}
STRINGS2 = ["paths", "urls", "registry", "MZ"]
GENERAL2 = ["size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols"]
OPTIONAL2 = ["major_image_version", "minor_image_version", "major_linker_version", "minor_linker_version", "major_operating_system_version", "minor_operating_system_version", "major_subsystem_version", "minor_subsystem_version", "sizeof_code", "sizeof_headers", "sizeof_heap_commit"]
DIRECTORIES = ["EXPORT_TABLE", "IMPORT_TABLE", "RESOURCE_TABLE", "EXCEPTION_TABLE", "CERTIFICATE_TABLE", "BASE_RELOCATION_TABLE", "DEBUG", "ARCHITECTURE", "GLOBAL_PTR", "TLS_TABLE", "LOAD_CONFIG_TABLE", "BOUND_IMPORT", "IAT", "DELAY_IMPORT_DESCRIPTOR", "CLR_RUNTIME_HEADER"]
ENUMS2 = [("coff", "machine", False), ("coff", "characteristics", True), ("optional", "subsystem", False), ("optional", "dll_characteristics", True), ("optional", "magic", False)]
SECTION_COUNTS = ["num_sections", "num_zero_size", "num_empty_name", "num_rx", "num_w"]


def starts(layout: dict[str, int]) -> dict[str, int]:
    """First column of each group."""
    ends = np.cumsum([0, *layout.values()]).tolist()
    return dict(zip(layout, ends, strict=False))


def width_of(layout: dict[str, int]) -> int:
    return sum(layout.values())


def names(value) -> list[str]:
    """A list of names; a bare string would count as its letters and is refused."""
    if not isinstance(value, list | tuple):
        raise TypeError(f"a list of names, not {type(value).__name__}")
    return list(value)


def normalised(rows: list, width: int, empty: float = np.nan) -> np.ndarray:
    """Counts as shares of their row's sum, in single precision; `empty` where the sum is 0 or the row has another length."""
    out = np.full((len(rows), width), empty, np.float32)
    good = [i for i, r in enumerate(rows) if isinstance(r, list | tuple) and len(r) == width]
    if good:
        own = {id(rows[i]): rows[i] for i in good}  # a list that rows share is read once
        number = dict(zip(own, range(len(own)), strict=True))
        counts = np.array(list(own.values()), np.float32)
        total = np.array([c.sum() for c in counts], np.float32)  # each row by itself: pairwise sums depend on the shape
        with np.errstate(divide="ignore", invalid="ignore"):
            share = counts / total[:, None]
        share[~np.isfinite(share)] = empty
        out[good] = share[[number[id(rows[i])] for i in good]]
    return out


def vec_strings(r: dict) -> list[float]:
    s = r["strings"]
    whole = s["printables"] if s["printables"] > 0 else 1.0
    return [s["numstrings"], s["avlength"], s["printables"], *[x / whole for x in s["printabledist"]], s["entropy"], *[s[k] for k in STRINGS2]]


def vec_general(r: dict) -> list[float]:
    return [r["general"][k] for k in GENERAL2]


def vec_datadirs(r: dict) -> list[float]:
    """(size, address) by position; directories beyond the known ones don't count, missing ones are 0."""
    pairs = [(d["size"], d["virtual_address"]) for d in r["datadirectories"][: len(DIRECTORIES)]]
    return [x for pair in pairs for x in pair] + [0.0] * (2 * (len(DIRECTORIES) - len(pairs)))


def vec_header(r: dict, row: int, at: int, hashed: HashedBlocks) -> list[float]:
    """The plain fields around the hashed ones, which go to `hashed`."""
    h = r["header"]
    for k, (part, key, several) in enumerate(ENUMS2):
        hashed.add(row, at + 1 + 10 * k, 10, names(h[part][key]) if several else [h[part][key]])
    return [h["coff"]["timestamp"], *[0.0] * 50, *[h["optional"][k] for k in OPTIONAL2]]


def entry_sections(section: dict) -> list[dict]:
    """Sections that bear the entry section's name."""
    return [s for s in section["sections"] if s["name"] == section["entry"]]


def section_counts(sections: list[dict]) -> list[int]:
    flags = [names(s["props"]) for s in sections]
    return [len(sections), sum(s["size"] == 0 for s in sections), sum(s["name"] == "" for s in sections), sum("MEM_READ" in f and "MEM_EXECUTE" in f for f in flags), sum("MEM_WRITE" in f for f in flags)]


def vec_section(r: dict, row: int, at: int, hashed: HashedBlocks) -> list[float]:
    """Counts; names weighted by size, entropy and virtual size, the letters of the entry's name and its flags are hashed."""
    own = r["section"]["sections"]
    for k, value in enumerate(("size", "entropy", "vsize")):
        hashed.add(row, at + 5 + 50 * k, 50, [s["name"] for s in own], [float(s[value]) for s in own])
    hashed.add(row, at + 155, 50, list(r["section"]["entry"]))
    hashed.add(row, at + 205, 50, [f for s in entry_sections(r["section"]) for f in s["props"]])
    return section_counts(own)


def libraries(imports: dict) -> list[str]:
    return sorted({lib.lower() for lib in imports})


def functions(imports: dict) -> list[str]:
    return [f"{lib.lower()}:{f}" for lib, own in imports.items() for f in names(own)]


def vec_imports(r: dict, row: int, at: int, hashed: HashedBlocks, signed: bool = True) -> None:
    hashed.add(row, at, 256, libraries(r["imports"]), signed=signed)
    hashed.add(row, at + 256, 1024, functions(r["imports"]), signed=signed)


def vec_exports(r: dict, row: int, at: int, hashed: HashedBlocks) -> None:
    hashed.add(row, at, 128, names(r["exports"]))


def problem(r) -> str | None:
    """The first thing that is wrong with the structure of a record; None if nothing is."""
    if not isinstance(r, dict):
        return f"a JSON object, not {type(r).__name__}"
    if gone := next((k for k in LAYOUT2 if k not in r), None):
        return f"no field {gone}"
    if bad := next((k for k in ("histogram", "byteentropy") if not isinstance(r[k], list | tuple) or len(r[k]) != 256), None):
        return f"{bad} must have 256 counts"
    wanted = [("strings", ["numstrings", "avlength", "printables", "printabledist", "entropy", *STRINGS2]), ("general", GENERAL2), ("header", ["coff", "optional"]), ("section", ["entry", "sections"])]
    for part, keys in wanted:
        if not isinstance(r[part], dict):
            return f"{part} must be an object"
        if gone := next((k for k in keys if k not in r[part]), None):
            return f"no field {part}.{gone}"
    if len(r["strings"]["printabledist"]) != 96:
        return "strings.printabledist must have 96 entries"
    for part, keys in (("coff", ["timestamp", "machine", "characteristics"]), ("optional", ["subsystem", "dll_characteristics", "magic", *OPTIONAL2])):
        if gone := next((k for k in keys if k not in r["header"][part]), None):
            return f"no field header.{part}.{gone}"
        if bad := next((k for k in ("characteristics", "dll_characteristics") if not isinstance(r["header"][part].get(k, []), list | tuple)), None):
            return f"header.{part}.{bad} must be a list of names"
    for i, s in enumerate(r["section"]["sections"]):
        if gone := next((k for k in ("name", "size", "entropy", "vsize", "props") if k not in s), None):
            return f"no field section.sections[{i}].{gone}"
        if not isinstance(s["props"], list | tuple):
            return f"section.sections[{i}].props must be a list of names"
    text = lambda x: isinstance(x, list | tuple) and all(isinstance(e, str) for e in x)
    if not isinstance(r["imports"], dict):
        return "imports must map libraries to functions"
    if bad := next((lib for lib, own in r["imports"].items() if not text(own)), None):
        return f"imports[{bad!r}] must be a list of strings"
    if not text(r["exports"]):
        return "exports must be a list of strings"
    for i, d in enumerate(r["datadirectories"]):
        if "size" not in d or "virtual_address" not in d:
            return f"datadirectories[{i}] needs size and virtual_address"
    return None


def vectorize2(records: list[dict]) -> np.ndarray:
    """Records as rows of single-precision vectors of the second layout."""
    out, at, hashed = np.zeros((len(records), width_of(LAYOUT2)), np.float64), starts(LAYOUT2), HashedBlocks()
    for row, r in enumerate(records):
        if wrong := problem(r):
            raise ValueError(f"record {row}: {wrong}")
        own = out[row]
        own[at["strings"] : at["general"]] = vec_strings(r)
        own[at["general"] : at["header"]] = vec_general(r)
        own[at["header"] : at["section"]] = vec_header(r, row, at["header"], hashed)
        own[at["section"] : at["section"] + 5] = vec_section(r, row, at["section"], hashed)
        vec_imports(r, row, at["imports"], hashed)
        vec_exports(r, row, at["exports"], hashed)
        own[at["datadirectories"] :] = vec_datadirs(r)
    hashed.pour(out)
    got = out.astype(np.float32)
    for group in ("histogram", "byteentropy"):
        got[:, at[group] : at[group] + 256] = normalised([r[group] for r in records], 256)
    return got


@dataclass
class Vocabulary:
    """Names that the third layout knows, in order; a deployment passes its own lists."""

    string_counts: list[str] = field(default_factory=list)
    machines: list[str] = field(default_factory=list)
    subsystems: list[str] = field(default_factory=list)
    header_scalars: list[tuple[str, str]] = field(default_factory=list)
    characteristics: list[str] = field(default_factory=list)
    dll_characteristics: list[str] = field(default_factory=list)
    dos: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=lambda: list(DIRECTORIES))
    signature: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def layout(self) -> dict[str, int]:
        header = len(self.header_scalars) + len(self.characteristics) + len(self.dll_characteristics) + len(self.dos)
        return {"general": 7, "histogram": 256, "byteentropy": 256, "strings": 100 + len(self.string_counts), "header": header, "section": 224, "imports": 1282, "exports": 129, "datadirectories": 2 * len(self.directories) + 2, "richheader": 33, "authenticode": len(self.signature), "pefilewarnings": len(self.warnings) + 1}


def feature_layout3(vocabulary: Vocabulary) -> list[str]:
    """Names of the third layout's columns."""
    return [f"{group}[{i}]" for group, n in vocabulary.layout().items() for i in range(n)]


def vec_strings3(s: dict, v: Vocabulary) -> list[float]:
    whole = float(s.get("printables") or 0)
    counts = s.get("string_counts") or {}
    return [s.get("numstrings", 0), s.get("avlength", 0), whole, *[x / (whole if whole > 0 else 1.0) for x in s.get("printabledist") or [0] * 96], s.get("entropy", 0), *[counts.get(k, 0) for k in v.string_counts]]


def vec_header3(h: dict, v: Vocabulary) -> list[float]:
    """Scalars (machine and subsystem as their place in the vocabulary, 0 if unknown), flags, the old header's fields."""
    part = {"coff": h.get("coff") or {}, "optional": h.get("optional") or {}}
    place = {"machine": v.machines, "subsystem": v.subsystems}
    scalar = lambda p, k: (place[k].index(part[p][k]) if part[p].get(k) in place[k] else 0) if k in place else part[p].get(k, 0)
    flags = lambda p, k, known: [x in (part[p].get(k) or []) for x in known]
    return [*[scalar(p, k) for p, k in v.header_scalars], *flags("coff", "characteristics", v.characteristics), *flags("optional", "dll_characteristics", v.dll_characteristics), *[(h.get("dos") or {}).get(k, 0) for k in v.dos]]


def section_general3(section: dict) -> tuple[list[float], list[float]]:
    """(counts and the ends of entropies and size ratios, a 0 among them always; what lies behind the last section)."""
    own, tail = section.get("sections") or [], section.get("overlay") or {}
    ends = lambda key, more: [f([s[key] for s in own] + more + [0]) for f in (max, min)]
    general = section_counts(own) + ends("entropy", [tail.get("entropy", 0)]) + ends("size_ratio", [tail.get("size_ratio", 0)]) + ends("vsize_ratio", [])
    return general, [tail.get(k, 0) for k in ("size", "size_ratio", "entropy")]


def datadir_vec3(directories: list[dict], v: Vocabulary) -> list[float]:
    """By name, without the first, which tells of relocations, and the last."""
    out = [0.0] * (2 * len(v.directories) + 2)
    for d in directories[1:-1]:
        if d.get("name") in v.directories:
            i = 2 * v.directories.index(d["name"])
            out[i : i + 2] = d["size"], d["virtual_address"]
    if directories:
        out[-2:] = directories[0].get("has_relocs", 0), directories[0].get("has_dynamic_relocs", 0)
    return out


def warnings_vec3(found: list[str], v: Vocabulary) -> list[float]:
    return [*[float(w in found) for w in v.warnings], float(len(found))]


def normalize_warnings(found: list[str], known: list[str]) -> list[str]:
    """Warnings as the longest known ending (...x) or else beginning (x...) that fits; others are dropped."""
    ends = sorted((w for w in known if w.startswith("...")), key=len, reverse=True)
    begins = sorted((w for w in known if not w.startswith("...")), key=len, reverse=True)
    fits = lambda w: next((e for e in ends if w.endswith(e[3:])), None) or next((b for b in begins if w.startswith(b.removesuffix("..."))), None)
    return sorted({x for w in set(found) if (x := fits(w))})


def vectorize3(records: list[dict], v: Vocabulary) -> np.ndarray:
    """Records as rows of the third layout; a group that a record lacks is 0."""
    layout = v.layout()
    at, hashed = starts(layout), HashedBlocks()
    out = np.zeros((len(records), width_of(layout)), np.float64)
    for row, r in enumerate(records):
        put = lambda group, values, skip=0: out[row].__setitem__(slice(at[group] + skip, at[group] + skip + len(values)), values)  # noqa: B023, E731
        if g := r.get("general"):
            put("general", [g.get("size", 0), g.get("entropy", 0), g.get("is_pe", 0), *(g.get("start_bytes") or [0, 0, 0, 0])])
        if r.get("strings"):
            put("strings", vec_strings3(r["strings"], v))
        if r.get("header"):
            put("header", vec_header3(r["header"], v))
        put("datadirectories", datadir_vec3(r.get("datadirectories") or [], v))
        if r.get("authenticode"):
            put("authenticode", [r["authenticode"].get(k, 0) for k in v.signature])
        if r.get("pefilewarnings"):
            put("pefilewarnings", warnings_vec3(r["pefilewarnings"], v))
        if s := r.get("section"):
            own, base = s.get("sections") or [], at["section"]
            general, tail = section_general3(s)
            put("section", general)
            for k, value in enumerate(("size", "vsize", "entropy")):
                hashed.add(row, base + 11 + 50 * k, 50, [x["name"] for x in own], [float(x[value]) for x in own])
            hashed.add(row, base + 161, 50, [f"{x['name']}:{f}" for x in own for f in x["props"]])
            hashed.add(row, base + 211, 10, [s.get("entry", "")])
            put("section", tail, 221)
        if r.get("imports"):
            put("imports", [len(functions(r["imports"])), len(libraries(r["imports"]))])
            vec_imports(r, row, at["imports"] + 2, hashed, signed=False)
        if r.get("exports"):
            put("exports", [128.0])
            hashed.add(row, at["exports"] + 1, 128, list(r["exports"]))
        if pairs := r.get("richheader"):
            put("richheader", [len(pairs) // 2])
            hashed.add(row, at["richheader"] + 1, 32, [str(x) for x in pairs[: len(pairs) // 2 * 2 : 2]], [float(x) for x in pairs[1::2]])
    hashed.pour(out)
    got = out.astype(np.float32)
    for group in ("histogram", "byteentropy"):
        got[:, at[group] : at[group] + 256] = normalised([r.get(group) for r in records], 256, 0.0)
    return got


def vectors(records: DataFrame, id_col: str, json_col: str, vocabulary: Vocabulary | None = None, given: dict | None = None, summary: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None, columns: str = "x array<float>") -> DataFrame:
    """(id, x array<float>) of JSON records, by Arrow batches; the second layout, or the third with a vocabulary.

    given: groups that all records have alike, which their JSON needn't repeat. summary: what is wanted of a matrix of vectors, in the
    place of x, with its columns' types: then the vectors don't leave their task."""
    schema = f"{id_col} {records.schema[id_col].dataType.simpleString()}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [{**given, **json.loads(x)} if given else json.loads(x) for x in part.column(1).to_pylist()]
                x = vectorize2(own) if vocabulary is None else vectorize3(own, vocabulary)
                if summary is None:
                    got = {"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}
                else:
                    got = {k: pa.array(v) for k, v in summary(x).items()}
                yield pa.RecordBatch.from_arrays([part.column(0), *got.values()], [id_col, *got])

    return records.select(id_col, json_col).mapInArrow(run, schema)


def feature_names2() -> list[str]:
    """Names of the second layout's columns."""
    hashed = lambda name, n: [f"{name}[{k}]" for k in range(n)]
    out = [f"histogram[0x{b:02X}]" for b in range(256)] + [f"byteentropy.bin{h:02d}[0x{n:X}_]" for h in range(16) for n in range(16)]
    out += ["strings.numstrings", "strings.avlength", "strings.printables", *[f"strings.printabledist[0x{0x20 + k:02X}]" for k in range(96)], "strings.entropy", *[f"strings.{k}" for k in STRINGS2]]
    out += [f"general.{k}" for k in GENERAL2] + ["header.coff.timestamp"]
    out += [n for part, key, _ in ENUMS2 for n in hashed(f"header.{part}.{key}_hashed", 10)] + [f"header.optional.{k}" for k in OPTIONAL2]
    out += [f"section.{k}" for k in SECTION_COUNTS] + [n for k in ("sizes", "entropy", "vsize", "entry_name", "entry_characteristics") for n in hashed(f"section.{k}_hashed", 50)]
    out += hashed("imports.libraries_hashed", 256) + hashed("imports.functions_hashed", 1024) + hashed("exports.functions_hashed", 128)
    return out + [f"datadirectories.{d}.{k}" for d in DIRECTORIES for k in ("size", "virtual_address")]


def flag_bucket_levels(flags: dict[str, str], width: int = 10) -> list[str]:
    """Of each bucket of a hashed list of flags (name to role: info, opt_in or structural) whether an attacker sets it freely:
    controllable if only info flags hash there, fixed if none or only structural ones do, else derived."""
    roles: list[set[str]] = [set() for _ in range(width)]
    for name, role in flags.items():
        roles[hash_bucket(name, width)[0]].add(role)
    return ["controllable" if r == {"info"} else "fixed" if r <= {"structural"} else "derived" for r in roles]


def features2(spark: SparkSession) -> DataFrame:
    """The dimension (feature, name, group) of the second layout."""
    at, kinds = starts(LAYOUT2), list(LAYOUT2)
    rows = [(i, n, max((g for g in kinds if at[g] <= i), key=lambda g: at[g])) for i, n in enumerate(feature_names2())]
    return spark.createDataFrame(rows, "feature int, name string, group string")


def matrix_ok(rows: DataFrame, vec_col: str, width: int) -> DataFrame:
    """rows, or an error for the first whose vector has another width or is null."""
    right = F.coalesce(F.size(vec_col) == width, F.lit(False))
    return rows.where(F.when(right, True).otherwise(F.raise_error(F.lit(f"a vector that has not {width} components")).cast("boolean")))
