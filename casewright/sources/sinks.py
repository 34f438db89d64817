"""Writers of record files: canonical lines, atomic replacement, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.text import CREDENTIALS, content_hash, redact
from casewright.operators.sequences import numbered


def canonical_lines(df: DataFrame, order: list[str], ascii_only: bool = False) -> DataFrame:
    """One JSON text a row, keys in column order, rows in total order of ``order``: columns ``pos``, ``line``."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*order, line.alias("line")).orderBy(*order).select("line")


def write_lines(df: DataFrame, path: str, order: list[str]) -> int:
    """Replace a JSON Lines file by the rows of ``df`` in order; returns their number.

    Rows are sorted into parts by all tasks, the parts are strung together in a file beside the target (a stream of
    bytes, nothing is held), and that is renamed over the target in one step: a reader sees the old file or the new one.
    """
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    canonical_lines(df, order).write.text(f"{beside}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    parts, whole, target = (hadoop.fs.Path(p) for p in (f"{beside}.parts", beside, path))
    fs = target.getFileSystem(conf)
    try:
        out = fs.create(whole, True)
        for part in sorted(str(s.getPath()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
            into = fs.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
            into.close()
        out.close()
        rename = getattr(hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(whole), fs.makeQualified(target), how)
    finally:
        fs.delete(parts, True)
        fs.delete(whole, False)
    return spark.read.text(path).count()


def _safe(c: Column, kind: T.DataType) -> Column | None:
    """A value with credentials replaced in all its strings; None where its kind holds none."""
    if isinstance(kind, T.StringType):
        return redact(c, CREDENTIALS)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType)) if _safe(F.lit(None), kind.elementType) is not None else None
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType)) if _safe(F.lit(None), kind.valueType) is not None else None
    if isinstance(kind, T.StructType):
        parts = {f.name: _safe(c[f.name], f.dataType) for f in kind}
        if all(p is None for p in parts.values()):
            return None
        return F.when(c.isNotNull(), F.struct(*((c[n] if p is None else p).alias(n) for n, p in parts.items())))
    return None


def redacted(df: DataFrame) -> DataFrame:
    """Every string at any depth (arrays, structs, values of maps) with credentials replaced; keys and other values stay."""
    out = {f.name: c for f in df.schema if (c := _safe(F.col(f.name), f.dataType)) is not None}
    return df.withColumns(out) if out else df


def merge_digest(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """Digest store after an upsert by content hash: known sections only get the new ``digested_at``, new ones get the next ids.

    Both need ``source, heading, content, digested_at``; ``live`` also ``id`` and ``content_hash``. Of equal incoming
    sections the one that sorts first by source and heading is kept.
    """
    fresh = incoming.withColumn("content_hash", content_hash(F.col("content")))
    once = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("content_hash").orderBy("source", "heading"))).where("_k = 1").drop("_k")
    stamp = once.select("content_hash", F.col("digested_at").alias("_at"))
    kept = live.join(stamp, "content_hash", "left").withColumn("digested_at", F.coalesce("_at", "digested_at")).drop("_at")
    last = live.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = once.join(live.select("content_hash"), "content_hash", "left_anti")
    # ids follow the hash order
    new = numbered(new, [F.col("content_hash")], "_pos").crossJoin(F.broadcast(last)).withColumn("id", F.col("_pos") + F.col("_last"))
    columns = ["id", "source", "heading", "content", "content_hash", "digested_at"]
    return kept.select(*columns).unionByName(new.select(*columns))
