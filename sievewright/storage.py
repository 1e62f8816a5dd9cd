"""Tables in the folder that a cluster's machines share: scratch tables, and tables that change together."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temp folder is set only where that is unset and Spark is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a stream or a set of tables."""
    return f"{shared_root(spark)}/streams/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: what follows starts from the files, also after a lost executor."""
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_joined(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """A narrow table of :func:`written`, marked for broadcast if it has no more than ``rows`` rows; larger ones are joined by shuffle."""
    return F.broadcast(table) if table.count() <= rows else table.hint("merge")


class CommitConflict(RuntimeError):
    """Another commit came first: read again and fold anew."""


class TableSet:
    """Tables below ``root`` that change together.

    A commit writes new folders of files first and its manifest last, under the next number, by a rename that fails if that number
    is taken. Readers take the latest manifest, so they see all of a commit or nothing; folders of a commit that failed are named by no manifest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """Number of the latest commit, 0 before the first."""
        folder = self._path("manifests")
        files = folder.getFileSystem(self._conf)
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max([0, *(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0])

    def read(self, manifest: dict, name: str) -> DataFrame | None:
        """A table as of a manifest, null where it has none."""
        entry = manifest["tables"].get(name)
        if entry is None:
            return None
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(*entry["paths"])

    def commit(self, manifest: dict, append: dict[str, DataFrame], replace: dict[str, DataFrame]) -> dict:
        """Add to and replace tables on top of ``manifest``; returns the new one."""
        tables, version = dict(manifest["tables"]), manifest["version"] + 1
        for name, df in [*append.items(), *replace.items()]:
            path = f"{self.root}/{name}/{version:09d}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            had = tables[name]["paths"] if name in append and name in tables else []
            tables[name] = {"schema": json.loads(df.schema.json()), "paths": [*had, path]}
        new = {"version": version, "tables": tables}
        self._publish(new)
        return new

    def _publish(self, manifest: dict) -> None:
        draft, final = self._path(f"manifests/{uuid.uuid4().hex}.draft"), self._path(f"manifests/{manifest['version']:09d}.json")
        files = draft.getFileSystem(self._conf)
        files.mkdirs(draft.getParent())
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._fs.FileContext.getFileContext(files.getUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            if isinstance(e, PySparkException) or "FileAlreadyExists" in str(e):
                files.delete(draft, False)
                raise CommitConflict(f"commit {manifest['version']} exists") from e
            raise
