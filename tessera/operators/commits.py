"""Tables that several writers add to: numbered commits name the folders of rows that count.

A writer puts its rows into a new folder and then makes the next numbered file in commits/, which
fails if another writer has made it first; then it takes the next number and tries again. So every
commit has its own number and none is lost. What no commit names does not count. A commit may also
start anew (compaction): what the ones before it named counts no more, but stays for readers that
began earlier until the compaction after next.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"


class Commits:
    """The commits of a table below path (a URI)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(p)
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, at: str) -> list[str]:
        found = self.fs.globStatus(self._path(f"{at}/*")) or []
        return sorted(f.getPath().getName() for f in found)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self._list(f"{self.path}/{COMMITS}") if n.endswith(".json")]

    def snapshot(self) -> tuple[int, list[str]]:
        """(last number, the folders that count): what a reader keeps to see the table as it is now."""
        numbers = self.numbers()
        live: list[str] = []
        for n in numbers:
            said = self._read(n)
            live = ([] if said["anew"] else live) + said["add"]
        return numbers[-1] if numbers else 0, live

    def _read(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{COMMITS}/{n:012d}.json", wholetext=True).first()[0])

    def read(self, schema: str, live: list[str] | None = None) -> DataFrame:
        live = self.snapshot()[1] if live is None else live
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}" for name in live))

    def commit(self, rows: Callable[[int, list[str]], DataFrame | None], anew: bool = False) -> int | None:
        """Add rows(number, folders that count so far) as the next commit; its number, or None if there are no rows to add."""
        while True:
            last, live = self.snapshot()
            df = rows(last + 1, live)
            if df is None:
                return None
            name = f"rows-{last + 1:012d}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{name}")
            if self._create(last + 1, {"add": [name], "anew": anew}):
                return last + 1
            self.fs.delete(self._path(f"{self.path}/{name}"), True)  # someone was faster: again with the next number

    def _create(self, n: int, said: dict) -> bool:
        """Make a commit file with its content, unless there is one of that number."""
        at, draft = f"{self.path}/{COMMITS}/{n:012d}.json", f"{self.path}/{COMMITS}/.{uuid.uuid4().hex}"
        self.fs.mkdirs(self._path(f"{self.path}/{COMMITS}"))
        out = self.fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if self.path.startswith("file:") or "://" not in self.path:  # a rename would replace the other's file there
            plain = lambda p: p.removeprefix("file://").removeprefix("file:")
            try:
                os.link(plain(draft), plain(at))
                made = True
            except FileExistsError:
                made = False
            self.fs.delete(self._path(draft), False)
            return made
        made = self.fs.rename(self._path(draft), self._path(at))
        if not made:
            self.fs.delete(self._path(draft), False)
        return made

    def compact(self, schema: str, kept: Callable[[DataFrame], DataFrame], parts: int = 1) -> None:
        """Write anew what counts. Folders that ceased to count before the last compaction go."""
        def rows(number: int, live: list[str]) -> DataFrame | None:
            return kept(self.read(schema, live)).coalesce(parts) if live else None

        before = [n for n in self.numbers() if self._read(n)["anew"]]
        gone = {name for n in self.numbers() if before and n < before[-1] for name in self._read(n)["add"]}
        if self.commit(rows, anew=True) is not None:
            for name in sorted(gone):
                self.fs.delete(self._path(f"{self.path}/{name}"), True)


def committed(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The rows that count of all tables whose paths fit a pattern, as one DataFrame."""
    said = spark.read.text(f"{pattern}/{COMMITS}/*.json", wholetext=True)
    at = F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*)/{COMMITS}/(\d+)[.]json$", 1)
    number = F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*)/{COMMITS}/(\d+)[.]json$", 2).cast("long")
    parsed = said.select(at.alias("table"), number.alias("n"), F.from_json("value", "add array<string>, anew boolean").alias("c"))
    since = parsed.groupBy("table").agg(F.coalesce(F.max(F.when(F.col("c.anew"), F.col("n"))), F.lit(0)).alias("since"))
    live = parsed.join(since, "table").where("n >= since").select(F.explode(F.expr("transform(c.add, x -> concat(table, '/', x))")).alias("folder"))
    rows = spark.read.schema(schema).parquet(f"{pattern}/rows-*").withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
    return rows.join(live, "folder", "left_semi").drop("folder")
