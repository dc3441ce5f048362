"""A workspace as a folder: tables in Parquet, their recipes, the team, and a manifest with digests that do not depend on the order of rows.

The manifest is written last, so a folder without one is no bundle. On import each table's rows are
counted and hashed again; one that differs from its digest is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import sets
from siltstone.operators.query import ROW
from siltstone.plans import recipe
from siltstone.plans.recipe import Dataset

KIND, VERSION = "siltstone workspace", 1


@dataclass(frozen=True)
class Bundle:
    datasets: list[Dataset]
    recipes: dict[str, list[tuple]] = field(default_factory=dict)
    changelogs: dict[str, list[str]] = field(default_factory=dict)
    team: list[dict] = field(default_factory=list)


def digest(df: DataFrame) -> dict[str, str | int]:
    """Rows, and the sums of both row hashes: equal for equal rows in any order and split, and repeated rows count. One pass, no shuffle of rows."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    h1, h2 = sets.row_hash(flat, flat.columns)
    n, a, b = flat.select(h1.cast("decimal(38,0)").alias("a"), h2.cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return {"rows": n, "hash": f"{int(a or 0) % 2**64:016x}{int(b or 0) % 2**64:016x}"}


def save(spark: SparkSession, path: str, datasets: list[Dataset], team: list[dict] = ()) -> None:
    """Write a bundle into a new folder; an existing one is an error."""
    listed = []
    for k, ds in enumerate(datasets):
        rows = ds.df.drop(ROW)
        # by place, as names may differ in case alone or hold signs that Parquet refuses
        rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).write.parquet(f"{path}/tables/{k}")
        written = spark.read.parquet(f"{path}/tables/{k}")
        listed.append({"name": ds.name, "columns": rows.columns, "types": [t for _, t in rows.dtypes], "recipe": json.loads(recipe.to_json(ds.name, list(ds.ops))), "changelog": ds.changelog(), "truncated": ds.truncated} | digest(written))
    manifest = {"kind": KIND, "version": VERSION, "datasets": listed, "team": list(team)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str, team: list[dict] = ()) -> Bundle:
    """Read and check a bundle; members whose mail address is in ``team`` already are not added again."""
    try:
        manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))
    except Exception as e:
        raise ValueError(f"no workspace bundle at {path}") from e
    if manifest.get("kind") != KIND or manifest.get("version") != VERSION:
        raise ValueError(f"no workspace bundle of version {VERSION} at {path}")
    out = Bundle([], team=list(team))
    for k, d in enumerate(manifest["datasets"]):
        rows = spark.read.parquet(f"{path}/tables/{k}")
        found = digest(rows)
        if found != {"rows": d["rows"], "hash": d["hash"]} or [t for _, t in rows.dtypes] != d["types"]:
            raise ValueError(f"{d['name']} is not as it was written: {found['rows']} rows for {d['rows']}" if found["rows"] != d["rows"] else f"{d['name']} is not as it was written")
        out.datasets.append(Dataset.of(d["name"], rows.toDF(*d["columns"]), truncated=d["truncated"]))
        out.recipes[d["name"]] = recipe.from_json(json.dumps(d["recipe"]))[1]
        out.changelogs[d["name"]] = d["changelog"]
    known = {m.get("email") for m in out.team}
    for m in manifest["team"]:
        if m.get("email") and m["email"] not in known:
            known.add(m["email"])
            out.team.append(m)
    return out
