"""Named datasets: cleaned views for SQL, projects on disk, and exports."""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.clean import Pipeline, Step
from sparkloom.plans.storage import delete_folder, exists, move_folder
from sparkloom.sources.readers import slug

SCHEMA_VERSION = 1
SHARE_LIMIT = 32_000


@dataclass
class Registry:
    """Datasets with their cleaning pipelines; SQL sees each as a lazy temporary view of its cleaned rows."""

    spark: SparkSession
    sets: dict[str, tuple[DataFrame, str, Pipeline]] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, order: str) -> str:
        key, k = slug(name) or "dataset", 2
        unique = key
        while unique in self.sets:
            unique, k = f"{key}_{k}", k + 1
        self.sets[unique] = (df, order, Pipeline())
        self._publish(unique)
        return unique

    def remove(self, key: str) -> None:
        if len(self.sets) == 1:
            raise ValueError("the last dataset stays")
        del self.sets[key]
        self.spark.catalog.dropTempView(key)

    def step(self, key: str, step: Step) -> DataFrame:
        df, order, pipeline = self.sets[key]
        self.sets[key] = (df, order, pipeline.add(step))
        return self._publish(key)

    def move(self, key: str, by: int) -> DataFrame:
        """Undo (by -1) or redo (by 1)."""
        df, order, pipeline = self.sets[key]
        self.sets[key] = (df, order, pipeline.goto(pipeline.cursor + by))
        return self._publish(key)

    def view(self, key: str) -> DataFrame:
        df, order, pipeline = self.sets[key]
        return pipeline.apply(df, order)

    def _publish(self, key: str) -> DataFrame:
        out = self.view(key)
        out.createOrReplaceTempView(key)
        return out

    def close(self) -> None:
        """Take the views out of the session; DataFrames made from them stay."""
        for key in self.sets:
            self.spark.catalog.dropTempView(key)

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)

    def save(self, folder: str) -> None:
        """A Parquet table for each dataset and a manifest of the pipelines (one row).

        The tables of a save go into a folder of their own, then the manifest is switched, then the tables of the save before
        are deleted: a project may be saved over the one it was loaded from, and a save that breaks off leaves the old one whole.
        The datasets of this registry read the new tables afterwards; other DataFrames over the old ones end with them.
        """
        before, version, held = _manifest(self.spark, folder), uuid.uuid4().hex, []
        for key, (df, order, p) in self.sets.items():
            df.write.parquet(f"{folder}/{version}/{key}.parquet")
            held.append({"id": key, "order": order, "cursor": p.cursor, "steps": [s.__dict__ for s in p.steps]})
        text = json.dumps({"schemaVersion": SCHEMA_VERSION, "tables": version, "datasets": held})
        delete_folder(self.spark, f"{folder}/manifest.new")
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/manifest.new")
        delete_folder(self.spark, f"{folder}/manifest.old")
        move_folder(self.spark, f"{folder}/manifest", f"{folder}/manifest.old")
        move_folder(self.spark, f"{folder}/manifest.new", f"{folder}/manifest")
        for key, (_, order, p) in list(self.sets.items()):
            self.sets[key] = (self.spark.read.parquet(f"{folder}/{version}/{key}.parquet"), order, p)
            self._publish(key)
        delete_folder(self.spark, f"{folder}/manifest.old")
        if before is not None:
            delete_folder(self.spark, f"{folder}/{before['tables']}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Registry:
        told = _manifest(spark, folder)
        if told is None:
            raise ValueError(f"no project in {folder}")
        if told["schemaVersion"] > SCHEMA_VERSION:
            raise ValueError("the project is of a newer version")
        ids = [d["id"] for d in told["datasets"]]
        if len(set(ids)) < len(ids):
            raise ValueError("repeated dataset ids")
        out = cls(spark)
        for d in told["datasets"]:
            steps = tuple(Step(s["op"], s["col"], s["params"]) for s in d["steps"])
            out.sets[d["id"]] = (spark.read.parquet(f"{folder}/{told['tables']}/{d['id']}.parquet"), d["order"], Pipeline(steps, d["cursor"]))
            out._publish(d["id"])
        return out


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the manifest says; the one before if a save broke off between the two; None where nothing was saved."""
    for name in ("manifest", "manifest.old"):
        if exists(spark, f"{folder}/{name}"):
            return json.loads(spark.read.text(f"{folder}/{name}").first().value)
    return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def json_quoted_lines(df: DataFrame) -> DataFrame:
    """CSV lines whose texts are quoted as JSON texts, numbers raw, nulls empty."""
    cells = [F.coalesce(F.substring(F.to_json(F.struct(F.col(c).alias("v"))), 6, 1 << 30), F.lit("")) if df.schema[c].dataType.typeName() == "string" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    cells = [F.regexp_replace(x, r"\}$", "") if df.schema[c].dataType.typeName() == "string" else x for c, x in zip(df.columns, cells)]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def export_quoted(df: DataFrame, path: str) -> bool:
    """Write a header line of JSON-quoted names, then the lines of ``json_quoted_lines``, as text files in order of their names; False, and nothing written, where there is no row."""
    if df.isEmpty():
        return False
    names = df.sparkSession.createDataFrame([(",".join(json.dumps(c, ensure_ascii=False) for c in df.columns),)], "line string").coalesce(1)
    names.union(json_quoted_lines(df)).write.text(path)  # a union keeps the order of its partitions
    return True


def share_link(spec: dict) -> str:
    """A spec (never data) as text for a url; raises ValueError if it is too long."""
    raw = json.dumps(spec, separators=(",", ":")).encode()
    squeezer = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = "z" + base64.urlsafe_b64encode(squeezer.compress(raw) + squeezer.flush()).rstrip(b"=").decode()
    if len(packed) > SHARE_LIMIT:
        raise ValueError("tooLarge")
    return packed


def read_share_link(text: str) -> dict:
    raw = base64.urlsafe_b64decode(text[1:] + "=" * (-len(text[1:]) % 4))
    return json.loads(zlib.decompress(raw, -15) if text[0] == "z" else raw)
