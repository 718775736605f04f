"""Bundles: one tar with a store's entries (Parquet), its chunk index and its manifest.

The index and manifest stand first, so that a reader learns what a bundle holds before its data.
A bundle is a file for hand-over, made and read on the driver; the data inside stay Parquet.
"""

from __future__ import annotations

import io
import json
import os
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import files


def write_bundle(path: str, entries: DataFrame, chunks: DataFrame, manifest: dict) -> None:
    """Makes a bundle at path, a file of the driver; executors write to the shared folder."""
    spark = entries.sparkSession
    at = f"{files.shared_dir(spark)}/bundles/{uuid.uuid4().hex}"
    chunks.coalesce(1).write.parquet(f"{at}/index")
    entries.write.parquet(f"{at}/entries")
    hidden = f"{path}.part"

    def add(tar, name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    with tarfile.open(hidden, "w", format=tarfile.USTAR_FORMAT) as tar:
        for folder in ("index", "manifest", "entries"):
            if folder == "manifest":
                add(tar, "manifest.json", json.dumps(manifest, sort_keys=True).encode())
                continue
            for name, *_ in files.listing(spark, f"{at}/{folder}"):
                if name.endswith(".parquet"):
                    add(tar, f"{folder}/{name}", files.read_bytes(spark, f"{at}/{folder}/{name}"))
    os.rename(hidden, path)
    files.delete(spark, at)


def read_bundle(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(entries, chunks, manifest) of a bundle, unpacked to a folder that the executors see; a bundle without index is refused."""
    with tarfile.open(path) as tar:
        names = tar.getnames()
        if not any(n.startswith("index/") for n in names) or "manifest.json" not in names:
            raise ValueError(f"{path} is no bundle: its index or manifest is missing")
        tar.extractall(folder, filter="data")
    with open(os.path.join(folder, "manifest.json")) as f:
        manifest = json.load(f)
    return spark.read.parquet(os.path.join(folder, "entries")), spark.read.parquet(os.path.join(folder, "index")), manifest
