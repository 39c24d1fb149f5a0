"""Meshes on disk: Parquet snapshots, raw binary fields in segments, interleaved files with ghost cells, configurations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import AXES, GridSpec

LAYERS = 16


def write_snapshot(grid: DataFrame, path: str, layers: int = LAYERS) -> None:
    """Parquet, partitioned by bands of z so that slices and sub-volumes prune; sorted within."""
    band = F.expr(f"z div {layers}").alias("zband")
    grid.select("*", band).repartition("zband").sortWithinPartitions("z", "y", "x").write.mode("overwrite").partitionBy("zband").parquet(path)


def read_snapshot(spark: SparkSession, path: str, z: tuple[int, int] | None = None, layers: int = LAYERS) -> DataFrame:
    d = spark.read.parquet(path)
    if z:
        d = d.where((F.col("zband") >= z[0] // layers) & (F.col("zband") <= (z[1] - 1) // layers) & (F.col("z") >= z[0]) & (F.col("z") < z[1]))
    return d.drop("zband")


def write_slice(grid: DataFrame, spec: GridSpec, path: str, step: int, t: float) -> None:
    """The plane in the middle of z, with its step and time, appended."""
    grid.where(F.col("z") == spec.n[2] // 2).select("*", F.lit(step).alias("step"), F.lit(t).alias("t")).write.mode("append").partitionBy("step").parquet(path)


def append_series(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_raw(grid: DataFrame, spec: GridSpec, folder: str, field: str, label: str = "0", layers: int = LAYERS) -> DataFrame:
    """field as files of little-endian doubles, x fastest, `<field>-segment-0-0-<z>-<label>.mesh`; a list of paths and bytes.

    A segment is written under a name of its own and renamed when it is whole.
    """
    nx, ny, nz = spec.n

    def run(t: pa.Table) -> pa.Table:
        from pyarrow import fs
        import uuid

        z0 = t.column("_s")[0].as_py() * layers
        a = np.full((min(layers, nz - z0), ny, nx), np.nan, "<f8")
        a[t.column("z").to_numpy() - z0, t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column(field).to_numpy()
        there, root = fs.FileSystem.from_uri(folder)
        there.create_dir(root, recursive=True)
        name = f"{root}/{field}-segment-0-0-{z0}-{label}.mesh"
        part = f"{name}.{uuid.uuid4().hex}"
        with there.open_output_stream(part) as f:
            f.write(a.tobytes())
        there.move(part, name)
        return pa.table({"path": [name], "bytes": pa.array([a.nbytes], pa.int64())})

    return grid.select(*AXES, F.col(field).cast("double").alias(field), F.expr(f"z div {layers}").alias("_s")).groupBy("_s").applyInArrow(run, "path string, bytes long")


def read_raw(spark: SparkSession, folder: str, spec: GridSpec, field: str, label: str = "0", kind: str = "<f8") -> DataFrame:
    """Files of write_raw, or one file with the whole field, to a grid."""
    nx, ny, _ = spec.n

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                z0 = int(path.rsplit("/", 1)[-1].split("-segment-")[1].split("-")[2]) if "-segment-" in path else 0
                a = np.frombuffer(content.as_buffer(), kind).reshape(-1, ny, nx)
                for k, plane in enumerate(a):
                    y, x = np.indices(plane.shape).reshape(2, -1).astype(np.int32)
                    yield pa.record_batch([pa.array(x), pa.array(y), pa.array(np.full(x.size, z0 + k, np.int32)), pa.array(plane.ravel().astype(float))], names=[*AXES, field])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{field}-segment-*-{label}.mesh").load(folder)
    return files.select("path", "content").mapInArrow(run, f"x int, y int, z int, `{field}` double")


def read_interleaved(spark: SparkSession, path: str, spec: GridSpec, fields: Sequence[str], ghosts: int = 3, kind: str = "<f8") -> DataFrame:
    """Files of all fields one after another, each with its ghost cells, which are left out."""
    nx, ny, nz = spec.n
    full = [n + 2 * ghosts for n in (nz, ny, nx)]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                a = np.frombuffer(content.as_buffer(), kind, len(fields) * int(np.prod(full))).reshape(len(fields), *full)
                a = a[:, ghosts : ghosts + nz, ghosts : ghosts + ny, ghosts : ghosts + nx]
                for z in range(nz):
                    y, x = np.indices((ny, nx)).reshape(2, -1).astype(np.int32)
                    yield pa.record_batch([pa.array(x), pa.array(y), pa.array(np.full(x.size, z, np.int32)), *(pa.array(a[k, z].ravel().astype(float)) for k in range(len(fields)))], names=[*AXES, *fields])

    schema = "x int, y int, z int" + "".join(f", `{f}` double" for f in fields)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def parse_config(text: str) -> dict:
    """`keyword = value` by line: whole numbers, reals, true/false, lists in braces or brackets; // and # begin comments."""
    def value(s: str):
        s = s.strip()
        if s[:1] in "{[(" and s[-1:] in "}])":
            return [value(x) for x in s[1:-1].split(",") if x.strip()]
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s.strip("\"'")

    out = {}
    for line in text.splitlines():
        line = line.split("//")[0].split("#")[0]
        k, eq, v = line.partition("=")
        if eq and k.strip() and v.strip():
            out[k.strip()] = value(v)
    return out


def write_config(values: dict) -> str:
    show = lambda v: "{" + ", ".join(map(show, v)) + "}" if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v)
    return "".join(f"{k} = {show(v)}\n" for k, v in values.items())


def wave_profile(spark: SparkSession, n: int, axis: str, kind: str = "sine", amplitude: float = 1.0, waves: int = 1) -> DataFrame:
    """A profile of a sine, a cosine or a constant."""
    p = F.lit(2 * np.pi * waves / n) * F.col("id")
    v = {"sine": F.sin(p), "cosine": F.cos(p), "constant": F.lit(1.0)}[kind] * amplitude
    return spark.range(n).select(F.col("id").cast("int").alias(axis), v.alias("value"))
