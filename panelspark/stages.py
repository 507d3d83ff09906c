"""Resumable stage outputs: written once, reused by later runs, removed when no longer wanted.

A ``StageStore`` keeps the output of each named stage as Parquet below one folder. A manifest per
stage (fingerprint, folder, rows) is committed last, by a rename, so an output is either whole
and listed or not used. The fingerprint covers the stage's plan, the names, sizes and times of
the files it reads, and a version given by the caller. A stage that is run again with the same
fingerprint is read back; any change of its plan or of its input files makes it run anew, and
with it the stages that read it, as their input files have changed.

A plan does not show what Python functions do, rows that the driver sent along, the options of a
text scan or the files of other sources; a stage with any of these must name a ``version``, or it
is an error. The folder belongs to the store (it refuses
one that holds other files) and to one run at a time.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import file_system

MARK = "_stage_store"
HIDDEN = re.compile(r"LocalRelation|LogicalRDD|ExternalRDD|MapIn(Arrow|Pandas)|MapInPython|FlatMap|Python|"
                    r"InMemoryRelation|ScalaUDF|RelationV2|\] (csv|json|text|xml|avro)\b")


def plan_text(df: DataFrame) -> str:
    """The analysed plan with its expressions numbered from zero and all fields shown."""
    conf = df.sparkSession.conf
    key, before = "spark.sql.debug.maxToStringFields", conf.get("spark.sql.debug.maxToStringFields", None)
    conf.set(key, str(2**31 - 1))
    try:
        text = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return text


def files_digest(df: DataFrame) -> str:
    """Number of files a plan reads and a sum of hashes of their names, sizes and times (one row
    reaches the driver; contents are not read)."""
    files = df.inputFiles()
    if not files:
        return "none"
    info = df.sparkSession.read.format("binaryFile").load(files).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"bit_xor(xxhash64(path, length, modificationTime, {seed}))").alias(f"h{seed}") for seed in (1, 2)])
    return ",".join(map(str, info.first()))


class StageStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.at = file_system(self.folder)
        self.used: set[str] = set()      # stages asked for in this run
        self.reused: set[str] = set()    # those that were read back
        self.fs.create_dir(self.at, recursive=True)
        if self.fs.get_file_info(f"{self.at}/{MARK}").type == pafs.FileType.NotFound:
            if self._names():
                raise ValueError(f"{folder} holds files that are not a stage store's")
            self._put(MARK, {"layout": 1})

    def stage(self, name: str, df: DataFrame, version: str = "") -> DataFrame:
        """The stage's output: what an earlier run left if nothing has changed, else ``df`` written now."""
        if not re.fullmatch(r"[A-Za-z][\w\-]*", name):
            raise ValueError(f"{name!r} is not a name for a stage (letters, digits, _ and -)")
        if name in self.used:
            raise ValueError(f"the stage {name} is there already")
        mark, before = self.fingerprint(df, version), self.manifest(name)
        self.used.add(name)
        if before and before["fingerprint"] == mark and self._whole(before):
            self.reused.add(name)
            return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{before['output']}")
        output = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{output}")
        found = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{output}")
        self._put(f"{name}.json", {"fingerprint": mark, "output": output, "rows": found.count(), "version": version})
        if before:
            self._remove(before["output"])
        return found

    def fingerprint(self, df: DataFrame, version: str = "") -> str:
        text = plan_text(df)
        hidden = HIDDEN.search(text)
        if hidden and not version:
            raise ValueError(f"the plan does not show all it does ({hidden.group()}): name a version of the stage")
        parts = (text, df.schema.json(), files_digest(df), version)
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def manifest(self, name: str) -> dict | None:
        path = f"{self.at}/{name}.json"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_file(path) as f:
            return json.loads(f.read())

    def prune(self) -> list[str]:
        """Remove the stages this run has not asked for, and outputs that no manifest names (those of
        runs that ended early). Returns what was removed."""
        gone = []
        for name in self._names():
            if name.endswith(".json") and name[:-5] not in self.used:
                self.fs.delete_file(f"{self.at}/{name}")
                gone.append(name)
        for name in self._names():
            if name == MARK or name.endswith(".json"):
                continue
            listed = (self.manifest(name) or {}).get("output")
            for x in self.fs.get_file_info(pafs.FileSelector(f"{self.at}/{name}")) if not name.startswith(".") else ():
                output = f"{name}/{posixpath.basename(x.path)}"
                if output != listed:
                    self._remove(output)
                    gone.append(output)
            if name.startswith("."):
                self.fs.delete_file(f"{self.at}/{name}")
            elif not listed:
                self.fs.delete_dir(f"{self.at}/{name}")
        return gone

    def clean(self) -> None:
        """Remove all outputs and manifests: the folder is empty."""
        self.used.clear()
        self.reused.clear()
        self.prune()
        self.fs.delete_file(f"{self.at}/{MARK}")

    def _names(self) -> list[str]:
        return sorted(posixpath.basename(x.path) for x in self.fs.get_file_info(pafs.FileSelector(self.at)))

    def _whole(self, manifest: dict) -> bool:
        """The output is there with all its rows (by the files' footers)."""
        path = manifest["output"]
        if self.fs.get_file_info(f"{self.at}/{path}/_SUCCESS").type == pafs.FileType.NotFound:
            return False
        return self.spark.read.parquet(f"{self.folder}/{path}").count() == manifest["rows"]

    def _remove(self, output: str) -> None:
        if self.fs.get_file_info(f"{self.at}/{output}").type == pafs.FileType.Directory:
            self.fs.delete_dir(f"{self.at}/{output}")

    def _put(self, name: str, content: dict) -> None:
        passing = f"{self.at}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(passing) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(passing, f"{self.at}/{name}")
