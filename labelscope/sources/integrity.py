"""Hashes of files and trees, checksum baselines, and their comparison.

Paths are listed once; the files are read and hashed in blocks on the executors, from any
store that Hadoop lists and the workers reach. Only paths and digests come back.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one file that is no part of a tree: a placeholder at its top.
LEFT_OUT = ".gitkeep"
BLOCK_BYTES = 1 << 20


class BaselineExists(FileExistsError):
    """A baseline is there already and may not be replaced silently."""


def digest_of(file: BinaryIO) -> str:
    """SHA-256 of an open file, read block by block."""
    digest = hashlib.sha256()
    while block := file.read(BLOCK_BYTES):
        digest.update(block)
    return digest.hexdigest()


def open_file(uri: str) -> BinaryIO:
    """A file for reading, by a local path or a URI of a store that Arrow knows."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return open("/" + rest.lstrip("/") if colon and scheme == "file" else uri, "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def files_below(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path relative to ``root``, URI, length) of every file, hidden ones too; an error where there is no such folder."""
    local = root.removeprefix("file://") if root.startswith("file://") else root
    if "://" not in root:
        if not os.path.isdir(local):
            raise FileNotFoundError(f"no folder {root}")
        found = [os.path.join(folder, name) for folder, _, names in os.walk(local) for name in names]
        return sorted((os.path.relpath(p, local).replace(os.sep, "/"), os.path.abspath(p), os.path.getsize(p)) for p in found if os.path.isfile(p))
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = system.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    out, listed = [], system.listFiles(base, True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath()
        out.append((path.toUri().getPath().removeprefix(top), path.toString(), status.getLen()))
    return sorted(out)


def hash_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, length, sha256) of every file below ``root`` but a .gitkeep at its top.

    Files of any size, hidden and empty ones too; a folder without files gives no rows.
    """
    listed = [f for f in files_below(spark, root) if f[0] != LEFT_OUT]

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uri in frame["uri"]:
                with open_file(uri) as file:
                    out.append(digest_of(file))
            yield frame[["path", "length"]].assign(sha256=out)

    files = spark.createDataFrame(listed, "path string, uri string, length long")
    tasks = max(1, min(len(listed), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(tasks).mapInPandas(digests, "path string, length long, sha256 string")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): added, removed or modified files of two (path, sha256) tables; unchanged ones are left out."""
    b, a = before.select("path", F.col("sha256").alias("_b")), after.select("path", F.col("sha256").alias("_a"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, "path", "full_outer").select("path", status.alias("status")).filter("status IS NOT NULL")


def write_baseline(spark: SparkSession, root: str, baseline: Path, replace: bool = False) -> Path:
    """Write the tree's digests as a baseline; refuses an empty tree, and to overwrite a baseline unless told to."""
    baseline = Path(baseline)
    if baseline.exists() and not replace:
        raise BaselineExists(f"{baseline} exists")
    files = {r["path"]: r["sha256"] for r in hash_tree(spark, root).toLocalIterator()}
    if not files:
        raise FileNotFoundError(f"no files below {root}")
    baseline.parent.mkdir(parents=True, exist_ok=True)
    baseline.write_text(json.dumps({"n_files": len(files), "files": dict(sorted(files.items()))}, indent=1) + "\n")
    return baseline


def read_baseline(spark: SparkSession, baseline: Path) -> DataFrame:
    files = json.loads(Path(baseline).read_text())["files"]
    return spark.createDataFrame(sorted(files.items()), "path string, sha256 string")


def changes_since(spark: SparkSession, root: str, baseline: Path) -> dict[str, list[str]]:
    """Sorted paths by status (added, removed, modified) since the baseline; a status without paths is left out."""
    rows = tree_diff(read_baseline(spark, baseline), hash_tree(spark, root)).groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return {r["status"]: list(r["paths"]) for r in rows.collect()}


#: Parts of a row's SHA-256 that are summed apart: four numbers of 64 bits.
LIMBS, LIMB_DIGITS = 4, 16


def table_digest(df: DataFrame, keys: list[str]) -> tuple[str, int]:
    """A digest of a table's rows that file layout and row order do not change, and the row count.

    Each row is hashed with its columns in order; the four parts of all row hashes are summed
    as numbers, and the sums and the count hashed. Repeated rows count each time. The sums
    are of a fixed size however long the table, and are made where the rows are. They tell
    changes apart, not forgeries.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    limb = lambda k: F.conv(F.substring("_h", 1 + LIMB_DIGITS * k, LIMB_DIGITS), 16, 10).cast("decimal(20,0)")
    sums = df.select(row.alias("_h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(limb(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(LIMBS)]).first()
    return hashlib.sha256(":".join([str(sums["n"]), *[sums[f"s{k}"] for k in range(LIMBS)]]).encode()).hexdigest(), sums["n"]


def main(argv: list[str] | None = None) -> int:
    """snapshot|verify ROOT BASELINE [--replace]; 0 well, 1 changed, 2 cannot be done."""
    args = sys.argv[1:] if argv is None else argv
    if len(args) < 3 or args[0] not in ("snapshot", "verify"):
        print(main.__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        if args[0] == "snapshot":
            write_baseline(spark, args[1], Path(args[2]), "--replace" in args)
            return 0
        changes = changes_since(spark, args[1], Path(args[2]))
    except (OSError, ValueError) as problem:
        print(problem)
        return 2
    print(json.dumps(changes))
    return 1 if changes else 0


if __name__ == "__main__":
    raise SystemExit(main())
