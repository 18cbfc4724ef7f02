"""Latent descriptions of files rendered into the full layouts: a description becomes a raw record by expressions, and records are vectorised
as those of real files are.

latents (id, size, stamp, sections array<struct<name, size, entropy, vsize, props>>, imports array<struct<library, function>>,
exports array<string>): what a description doesn't say is 0 in its vector.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.features import raw


#: What no description says: alike in all records.
UNSAID = {"histogram": [0] * 256, "byteentropy": [0] * 256, "strings": {**dict.fromkeys(["numstrings", "avlength", "printables", "entropy", *raw.STRINGS2], 0), "printabledist": [0] * 96}, "datadirectories": []}


def record(entry: Column) -> Column:
    """The raw record of a description as JSON, but for UNSAID; the entry section is given."""
    none = lambda names: [F.lit(0).alias(n) for n in names]
    libraries = F.array_distinct(F.transform("imports", lambda x: x["library"]))
    imports = F.map_from_entries(F.transform(libraries, lambda lib: F.struct(lib.alias("key"), F.transform(F.filter("imports", lambda x: x["library"] == lib), lambda x: x["function"]).alias("value"))))
    sections = F.transform("sections", lambda s: F.struct(s["name"].alias("name"), s["size"].alias("size"), s["entropy"].alias("entropy"), s["vsize"].alias("vsize"), s["props"].alias("props"), F.when(F.col("size") > 0, s["size"] / F.col("size")).otherwise(0.0).alias("size_ratio"), F.when(s["size"] > 0, s["vsize"] / s["size"]).otherwise(0.0).alias("vsize_ratio")))
    given = {"size": F.col("size"), "vsize": F.coalesce(F.aggregate("sections", F.lit(0).cast("double"), lambda a, s: a + s["vsize"].cast("double")), F.lit(0.0)), "exports": F.size("exports"), "imports": F.size("imports")}
    general = F.struct(*[given.get(k, F.lit(0)).alias(k) for k in raw.GENERAL2], F.lit(0.0).alias("entropy"), F.lit(1).alias("is_pe"))
    coff = F.struct(F.col("stamp").alias("timestamp"), F.lit("I386").alias("machine"), F.array(F.lit("EXECUTABLE_IMAGE")).alias("characteristics"))
    optional = F.struct(F.lit("WINDOWS_GUI").alias("subsystem"), F.array().cast("array<string>").alias("dll_characteristics"), F.lit("PE32").alias("magic"), *none(raw.OPTIONAL2))
    return F.to_json(
        F.struct(
            general.alias("general"), F.struct(coff.alias("coff"), optional.alias("optional")).alias("header"),
            F.struct(entry.alias("entry"), sections.alias("sections")).alias("section"), imports.alias("imports"), F.col("exports"),
        )
    )


def render(latents: DataFrame, id_col: str = "id", vocabulary: raw.Vocabulary | None = None, summary: Callable | None = None, columns: str = "x array<float>") -> DataFrame:
    """(id, x) of descriptions: the second layout, or the third with a vocabulary. The entry is the largest section, the first of equals.
    summary and columns: as of raw.vectors."""
    heavy = F.array_max(F.transform("sections", lambda s, i: F.struct(s["size"].alias("size"), (-i).alias("at"), s["name"].alias("name"))))
    entry = F.coalesce(heavy["name"], F.lit(""))
    return raw.vectors(latents.select(id_col, record(entry).alias("value")), id_col, "value", vocabulary, UNSAID, summary, columns)
