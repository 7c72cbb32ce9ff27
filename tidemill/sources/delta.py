"""Delta tables, read without a package: the log is replayed with Spark's own readers.

The state of a version is the newest checkpoint at or before it and the commits after that. Of each data file the latest action counts
(add or remove), found in one aggregation over the actions, so the log may be of any length; what reaches the driver is a
row for each live file. Partition values come from the log, by a join on the file's path, not from folder names.
Tables that need what this reader doesn't know (deletion vectors in use, column mapping, newer reader features) are refused.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.joins import unused

#: Reader features whose tables can be read as they are, as long as no file has a deletion vector.
KNOWN_FEATURES = {"deletionVectors", "timestampNtz", "v2Checkpoint", "vacuumProtocolCheck", "variantType"}
_ACTIONS = (
    "add struct<path: string, partitionValues: map<string, string>, deletionVector: struct<storageType: string>>, remove struct<path: string>, "
    "metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>, protocol struct<minReaderVersion: int, readerFeatures: array<string>>"
)


def _log(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_delta_log")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"{path} is no Delta table")
    return sorted(str(s.getPath()) for s in fs.listStatus(where) if s.isFile())


def _actions(spark: SparkSession, path: str, version: int | None) -> tuple[DataFrame, int]:
    """Actions with the version they are of, and the version that is read."""
    shape = T.StructType.fromDDL(_ACTIONS)
    commits, checkpoints = {}, {}
    for file in _log(spark, path):
        name = file.rsplit("/", 1)[1]
        number = name.split(".")[0]
        if not number.isdigit():
            continue
        if name == f"{number}.json":
            commits[int(number)] = file
        elif ".checkpoint." in name and name.endswith(".parquet"):
            checkpoints.setdefault(int(number), []).append(file)
    newest = max([*commits, *checkpoints], default=None)
    if newest is None or (version is not None and version not in commits and version not in checkpoints):
        raise LookupError(f"{path} has no version {version}" if newest is not None else f"{path} has an empty log")
    at = newest if version is None else version
    base = max((v for v in checkpoints if v <= at and _whole(checkpoints[v])), default=None)
    later = [v for v in range(0 if base is None else base + 1, at + 1)]
    if missing := [v for v in later if v not in commits]:
        raise LookupError(f"version {missing[0]} is missing from the log of {path}")
    parts = []
    if base is not None:
        held = spark.read.parquet(*checkpoints[base])
        names = [f.name for f in shape.fields if f.name in held.columns]
        slim = held.select(*[F.from_json(F.to_json(n), f.dataType).alias(n) for n in names for f in [shape[n]]])
        parts.append(slim.withColumn("version", F.lit(base).cast("long")))
    if later:
        text = spark.read.schema(shape).json([commits[v] for v in later])
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
        parts.append(text.withColumn("version", number))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, at


def _whole(files: list[str]) -> bool:
    """A checkpoint of several parts names their number; all must be there."""
    names = [f.rsplit("/", 1)[1].split(".") for f in files]
    return any(len(n) == 3 for n in names) or any(len(n) == 5 and int(n[3]) == len(files) for n in names)


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as of a version (the newest, if none is given)."""
    actions, _ = _actions(spark, path, version)
    for kind in ("add", "remove", "metaData", "protocol"):
        if kind not in actions.columns:
            actions = actions.withColumn(kind, F.lit(None).cast(T.StructType.fromDDL(_ACTIONS)[kind].dataType))
    latest = lambda c: actions.where(F.col(c).isNotNull()).orderBy(F.desc("version")).select(f"{c}.*").first()
    meta, protocol = latest("metaData"), latest("protocol")
    if meta is None:
        raise LookupError(f"the log of {path} has no metadata")
    if protocol and (unknown := set(protocol.readerFeatures or ()) - KNOWN_FEATURES):
        raise NotImplementedError(f"reader features {', '.join(sorted(unknown))} aren't supported")
    if (meta.configuration or {}).get("delta.columnMapping.mode", "none") != "none":
        raise NotImplementedError("column mapping isn't supported")
    schema = T.StructType.fromJson(json.loads(meta.schemaString))
    file = F.coalesce("add.path", "remove.path")
    changes = actions.where("add is not null or remove is not null").select(file.alias("path"), "add", "version", F.col("add").isNotNull().alias("live"))
    # In one version a file may be removed and added again; the add holds.
    state = changes.groupBy("path").agg(F.max_by(F.struct("add", "live"), F.struct("version", "live")).alias("s")).where("s.live").select("path", "s.add.partitionValues", "s.add.deletionVector")
    files = state.collect()  # a row for each live file
    if any(f.deletionVector is not None for f in files):
        raise NotImplementedError("deletion vectors aren't supported")
    if not files:
        return spark.createDataFrame([], schema)
    root = path.rstrip("/")
    absolute = {f.path: p if ":/" in (p := unquote(f.path)) or p.startswith("/") else f"{root}/{p}" for f in files}
    keys = list(meta.partitionColumns or ())
    stored = T.StructType([f for f in schema.fields if f.name not in keys])
    data = spark.read.schema(stored).parquet(*absolute.values()) if stored.fields else spark.read.parquet(*absolute.values())
    if not keys:
        return data.select(*[f"`{f.name}`" for f in schema.fields])
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: str(jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).makeQualified(jvm.org.apache.hadoop.fs.Path(p)).toUri().getPath())
    at, values = unused(spark.createDataFrame([], schema), "at", "values")
    of = spark.createDataFrame([(place(absolute[f.path]), dict(f.partitionValues or {})) for f in files], f"`{at}` string, `{values}` map<string, string>")
    own = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    wide = data.withColumn(at, own).join(of, at)  # Spark broadcasts the files only under its checked threshold
    columns = [F.nullif(F.col(values)[f.name], F.lit("")).cast(f.dataType).alias(f.name) if f.name in keys else F.col(f"`{f.name}`") for f in schema.fields]
    return wide.select(*columns)
