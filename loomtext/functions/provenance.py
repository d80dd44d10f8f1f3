"""Content addresses: canonical strings and their SHA-256, the same in any engine."""

from __future__ import annotations

import subprocess
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators import ranges
from loomtext.sources.scratch import holds_files, written

#: Separates the fields of a canonical string.
SEP = "\u0001"
#: Hashes that one hash of a tree covers.
BLOCK = 1024


def canonical(*fields: Column) -> Column:
    """Fields as text between separators; null is empty."""
    return F.concat_ws(SEP, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def content_hash(*fields: Column) -> Column:
    return F.sha2(canonical(*fields), 256)


def passage_hash(source: Column, school: Column) -> Column:
    """Of the first 2,000 characters of a source and its school."""
    return content_hash(F.substring(F.coalesce(source, F.lit("")), 1, 2000), school)


def passage_id(school: Column, source_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", school, source_id, F.substring(digest, 1, 10))


def set_hash(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str = "set_hash") -> DataFrame:
    """The hash of all rows of a group, in order, by a tree: rows' own hashes in blocks of BLOCK, blocks' hashes again, until one is left.

    A hash is that of the hashes below it, joined. Rows that are equal in `order` go by their hash. Neither texts nor a whole group's
    hashes are ever gathered: rows are numbered over sorted ranges, and a task has one block, so that a group may hold any share
    of all rows. A group of at most BLOCK rows has one block and one level.
    """
    rows = df.select(*keys, *(o for o in order if o not in keys), content_hash(*[F.col(f) for f in fields]).alias("_h"))
    rows = ranges.numbered(rows, [*order, "_h"], keys, parts=0)
    over, most = "_n", None
    while most is None or most > 1:
        block = F.floor(F.col(over) / BLOCK).cast("long")
        below = F.transform(F.array_sort(F.collect_list(F.struct(F.col(over).alias("n"), F.col("_h").alias("h")))), lambda r: r["h"])  # BLOCK at most
        hashed = rows.groupBy(*keys, block.alias("_b")).agg(below.alias("below"))
        # A block that is already alone, above the rows themselves, is the root and goes up as it is.
        root = F.sha2(F.array_join("below", SEP), 256) if most is None else F.when((F.size("below") == 1) & (F.col("_b") == 0), F.col("below")[0]).otherwise(F.sha2(F.array_join("below", SEP), 256))
        rows = written(hashed.select(*keys, "_b", root.alias("_h")))
        over, most = "_b", (rows.agg(F.max("_b")).first()[0] or 0) + 1
    return rows.select(*keys, F.col("_h").alias(out))


def run_signature(gold_hash: Column, code_sha: Column, config_sha: Column) -> Column:
    return content_hash(gold_hash, code_sha, config_sha)


def experiment_id(layer: Column, config: Column, data_hash: Column, ts: Column) -> Column:
    return F.concat_ws("-", F.lit("EXP"), layer, config, F.substring(data_hash, 1, 12), F.date_format(ts, "yyyyMMddHHmmss"))


def result_id(gold_version: Column, source: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", gold_version, F.substring(source, 1, 40), model), 256), 1, 16)


def file_hashes(spark, paths: list[str]) -> DataFrame:
    """path and SHA-256 of files and documents, for code and configuration fingerprints."""
    from loomtext.sources.lines import packed

    parts = []
    for path in paths:
        documents = packed(spark, path, folder=True)
        if documents is not None:
            at = F.concat_ws("/", "folder", F.regexp_replace(F.url_encode("file"), r"\+", "%20"))
            parts.append(documents.select(at.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))
    plain = [p for p in paths if holds_files(spark, p)] if parts else paths
    if plain:
        parts.append(spark.read.format("binaryFile").load(plain).select("path", F.sha2("content", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, parts)


def code_hash(files: DataFrame) -> DataFrame:
    """code_sha: one fingerprint of files (name, sha256), in the order of their names."""
    return set_hash(files, [], ["name"], ["name", "sha256"], "code_sha")


def config_hash(config: dict[str, str]) -> Column:
    """The fingerprint of a configuration, whatever the order of its keys."""
    return content_hash(*[F.lit(x) for k in sorted(config) for x in (k, config[k])])


def state(folder: str) -> dict[str, str | bool | None]:
    """The commit and branch of a working copy and whether it has changes; nulls outside of one."""

    def ask(*what: str) -> str | None:
        got = subprocess.run(["git", "-C", folder, *what], capture_output=True, text=True, timeout=30)
        return got.stdout.strip() if got.returncode == 0 else None

    changed = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if changed is None else bool(changed)}
