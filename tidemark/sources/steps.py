"""Steps that are computed once and read until something they depend on changes.

A step's key is a digest of its version, its parameters, the content of its input tables and, for each
step it needs, that step's key and the digest of its result. So a change anywhere gives new keys to what
depends on it and to nothing else. A result is written to a folder of its own, then described
by a manifest; results without one are not seen, and two writers don't overwrite each other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "step string, key string, path string, digest string, rows long, written string, number long"


def content_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order and partitions, and of its schema: the number of
    rows and the sums of two hashes of each, which combine before the shuffle. Maps count by their entries in order."""
    plain = [F.array_sort(F.map_entries(c)) if t.startswith("map<") else F.col(c) for c, t in ((f"`{c}`", t) for c, t in df.dtypes)]
    body = F.to_json(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(plain)]), {"ignoreNullFields": "false"})
    found = df.select(body.alias("b")).agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), "b").cast("decimal(38,0)")) for seed in (1, 2)]).first() if plain else (df.count(), 0, 0)
    return _digest([df.schema.jsonValue(), *(str(x) for x in found)])


def _digest(x) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Step:
    """make gets the tables named in ``inputs`` and ``needs``, by name. A ``view`` is derived from
    others and cheap: it can be made anew alone."""

    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: int = 1
    view: bool = False


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All results that were finished under the root; none if there is no such folder."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except Exception as missing:  # the reader names a missing path in its own error class
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def intact(spark: SparkSession, found: dict) -> DataFrame | None:
    """The result of a manifest, or None if its folder is gone or its content is no longer what was written."""
    try:
        df = spark.read.parquet(found["path"])
        return df if content_digest(df) == found["digest"] else None
    except Exception as broken:
        if not any(x in str(broken) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "FileNotFound")):
            raise
        return None


def completed(spark: SparkSession, root: str) -> dict[str, str]:
    """The newest intact result of each step: name and key."""
    out: dict[str, str] = {}
    for m in sorted((r.asDict() for r in manifests(spark, root).collect()), key=lambda m: -m["number"]):  # a row a finished step
        if m["step"] not in out and intact(spark, m) is not None:
            out[m["step"]] = m["key"]
    return out


def run_graph(spark: SparkSession, root: str, steps: Iterable[Step], inputs: dict[str, DataFrame], again: Iterable[str] = (), views_only: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of all steps and what became of each: ``read``, ``made``, or ``absent``.

    ``steps`` come in an order in which each needs earlier ones only. Steps named in ``again`` are made whatever is there.
    ``views_only`` makes views and reads the newest result of all other steps, whatever the inputs are now; what was never made is absent."""
    done = [r.asDict() for r in manifests(spark, root).orderBy("number").collect()]
    number = max([m["number"] for m in done], default=0)
    tables, digests, keys, became = {}, {}, {}, {}
    contents = {name: content_digest(df) for name, df in inputs.items()}
    for step in steps:
        if missing := [n for n in step.needs if n not in became]:
            raise ValueError(f"step {step.name} needs {missing}, which come later or not at all")
        if any(became[n] == "absent" for n in step.needs):
            became[step.name] = "absent"
            continue
        parts = [step.name, step.version, step.params, {n: contents[n] for n in step.inputs}, {n: [keys[n], digests[n]] for n in step.needs}]
        keys[step.name] = _digest(parts)[:24]
        old = views_only and not step.view
        fits = [m for m in done if m["step"] == step.name and (old or m["key"] == keys[step.name])]
        df, key = next(((df, m["key"]) for m in reversed(fits) if (df := intact(spark, m)) is not None), (None, keys[step.name])) if step.name not in again else (None, keys[step.name])
        keys[step.name] = key  # of a result that was read whatever its inputs, its own
        if df is None and old:
            became[step.name] = "absent"
            continue
        became[step.name] = "read" if df is not None else "made"
        if df is None:
            path = f"{root}/{step.name}/{keys[step.name]}-{uuid.uuid4().hex[:8]}"
            step.make(**{n: inputs[n] for n in step.inputs}, **{n: tables[n] for n in step.needs}).write.parquet(path)
            df, number = spark.read.parquet(path), number + 1
            row = (step.name, keys[step.name], path, content_digest(df), df.count(), json.dumps(step.params, sort_keys=True, default=str), number)
            spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
        tables[step.name], digests[step.name] = df, content_digest(df)
    return tables, became


def prune(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes all but the newest ``keep`` results of each step, and their place in the list; returns how many."""
    found = sorted((r.asDict() for r in manifests(spark, root).collect()), key=lambda m: -m["number"])
    stay, gone = [], []
    for m in found:
        (stay if sum(x["step"] == m["step"] for x in stay) < keep else gone).append(m)
    if gone:
        # the list first: a result that is still listed must still be there
        fresh = f"{root}/manifest-{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([tuple(m.values()) for m in stay], MANIFEST).coalesce(1).write.json(fresh)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(root).getFileSystem(conf)
        fs.delete(path(f"{root}/manifest"), True)
        fs.rename(path(fresh), path(f"{root}/manifest"))
        for m in gone:
            fs.delete(path(m["path"]), True)
    return len(gone)
