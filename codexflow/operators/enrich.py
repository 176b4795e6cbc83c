"""Document metadata for every chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import fields
from codexflow.operators.chunking import explode_chunks


def extract_metadata(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    out = df.withColumn("_m", fields.legal_metadata(F.col(text))).select(
        *[c for c in df.columns if c != text], "_m.*")
    if path is not None:
        out = out.withColumn("extraction_method", F.lit("metadata_extractor_v1"))
    return out


def enrich_chunks(df: DataFrame, chunks: str = "chunks", keep_empty: bool = False, extra: str | None = None) -> DataFrame:
    """Chunks of a document share the fields found in its joined chunk text.

    The chunks are still an array in the document's row, so the fields are
    extracted once per document and copied by the explode; no join, no shuffle.
    ``extra`` names a map<string,string> of the document: ``metadata`` then holds its
    entries, under those of the chunk's own place, under the fields found.
    """
    full = F.array_join(F.transform(chunks, lambda c: c["content"]), "\n\n")
    with_meta = df.withColumn("_full", full).withColumn("_m", fields.legal_metadata(F.col("_full"))).drop("_full")
    keep = [c for c in df.columns if c not in (chunks, extra)]
    carried = [*keep, *([extra] if extra else [])]
    rows = explode_chunks(with_meta, chunks, keep_empty)
    own = [c for c in rows.columns if c not in carried and c != "_m"]
    out = rows.select(*carried, *own, "_m.*", fields.section(F.col("content")).alias("section"))
    if extra is None:
        return out
    found = [f.name for f in with_meta.schema["_m"].dataType.fields]
    named = lambda names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull())
    base = F.coalesce(F.col(extra), F.create_map().cast("map<string,string>"))
    place = [c for c in own if c != "content"]
    return out.withColumn("metadata", merge_extra(base, named(place), named([*found, "section"]))).drop(extra)


def merge_extra(base: Column, chunk: Column, computed: Column) -> Column:
    """Pass-through map; later maps win over earlier ones on the same key."""
    keys = F.array_distinct(F.concat(F.map_keys(base), F.map_keys(chunk), F.map_keys(computed)))
    pick = lambda k: F.coalesce(computed[k], chunk[k], base[k])
    return F.map_from_arrays(keys, F.transform(keys, pick))
