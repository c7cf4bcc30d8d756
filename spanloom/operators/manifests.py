"""File manifests: set equality, differences, unsafe and clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Device names that a file must not bear.
RESERVED = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder; the digest is made where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, removed or changed."""
    o = old.select("path", F.struct("bytes", "sha256").alias("o"))
    n = new.select("path", F.struct("bytes", "sha256").alias("n"))
    met = o.join(n, "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return met.select("path", change.alias("change")).where("change is not null")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """path, violation: unsafe names, names equal but for case, a file that is another's folder."""
    parts = F.split("path", "/", -1)
    unsafe = (
        (F.col("path") == "") | F.col("path").startswith("/") | F.col("path").rlike(r"[\\\x00]|^[A-Za-z]:")
        | F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike(RESERVED) | p.rlike(r"[ .]$"))
    )
    bad = manifest.where(unsafe).select("path", F.lit("unsafe_name").alias("violation"))
    twice = manifest.groupBy(F.lower("path").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").select("path", F.lit("case_clash").alias("violation"))
    up = manifest.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("parent"), F.col("path").alias("child")).where("parent != child")
    folders = up.select("parent").distinct()
    both = manifest.join(folders, manifest["path"] == folders["parent"], "left_semi").select("path", F.lit("file_and_folder").alias("violation"))
    return bad.unionByName(twice).unionByName(both)


def manifest_equal(a: DataFrame, b: DataFrame) -> bool:
    return manifest_diff(a, b).limit(1).count() == 0


def size_split(manifest: DataFrame, most: int) -> DataFrame:
    """path, bytes, part: files in path order, a new part before its total would pass ``most``.

    Greedy filling depends on every earlier choice; a manifest is control data, so one group is right.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, total, out = 0, 0, []
        pdf = pdf.sort_values("path")
        for b in pdf["bytes"]:
            if total and total + b > most:
                part, total = part + 1, 0
            total += b
            out.append(part)
        return pdf.assign(part=out)[["path", "bytes", "part"]]

    return manifest.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(run, "path string, bytes long, part int")
