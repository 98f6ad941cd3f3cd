"""Tables with manifests: writing, and reading that fails closed."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from labelscope import schema as C
from labelscope.sources.integrity import table_digest


class ArtifactError(RuntimeError):
    """A table is not the one its manifest describes."""


def git_state(folder: str = ".") -> dict[str, object]:
    """Commit and whether files differ from it; nulls outside a repository."""

    def run(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    commit, status = run("rev-parse", "HEAD"), run("status", "--porcelain")
    return {"commit": commit, "dirty": None if status is None else bool(status)}


def write_table(df: DataFrame, path: str, manifest: Path, keys: list[str], frozen: bool = False, **facts: object) -> dict:
    """Write Parquet and a manifest with the rows' digest and count; the git state is taken first."""
    state = git_state(str(Path(manifest).parent))
    df.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    digest, rows = table_digest(written, keys)
    document = {"path": Path(path).as_posix(), "rows": rows, "row_digest": digest, "columns": written.columns, "frozen": frozen, "git": state, "schema_version": C.VERSION, **facts}
    Path(manifest).parent.mkdir(parents=True, exist_ok=True)
    Path(manifest).write_text(json.dumps(document, indent=1, sort_keys=True) + "\n")
    return document


def read_table(spark: SparkSession, manifest: Path, keys: list[str], need_frozen: bool = False) -> DataFrame:
    """The table of a manifest, after its version, frozen mark, columns, count and digest agree."""
    document = json.loads(Path(manifest).read_text())
    if document.get("schema_version") != C.VERSION:
        raise ArtifactError(f"schema version {document.get('schema_version')}, not {C.VERSION}")
    if need_frozen and document.get("frozen") is not True:
        raise ArtifactError("the artifact is not frozen")
    df = spark.read.parquet(document["path"])
    if df.columns != document["columns"]:
        raise ArtifactError("columns differ from the manifest")
    digest, rows = table_digest(df, keys)
    if rows != document["rows"] or digest != document["row_digest"]:
        raise ArtifactError(f"{rows} rows of digest {digest[:12]}, manifest has {document['rows']} of {document['row_digest'][:12]}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    from pyspark.sql import functions as F

    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("errorifexists").csv(path, header=True)


def write_schema(path: Path, parameters: dict) -> dict:
    document = C.document(C.all_columns(), parameters)
    Path(path).write_text(C.dumps(document) + "\n")
    return document
