"""Tables that are written whole and read after that: a change becomes visible at once or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.schema import Table


class ConstraintError(Exception):
    """Rows that break a condition of their table; counts says how many break which."""

    code = "23514"

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{name}: {n}" for name, n in counts.items()))
        self.counts = counts


class Store:
    """A folder of tables. Each table is a folder of versions and a small file that names the present one.

    A version is written beside the others and takes effect by the renaming of that file over the old one: readers see the old rows or the
    new ones, and a write that fails leaves the old ones. There is one writer of a table at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _present(self, name: str) -> dict | None:
        path = f"{self.root}/{name}/present.json"
        if not self._files(path).exists(self._path(path)):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))

    def _name(self, name: str, present: dict) -> None:
        """Make a version the present one, by one rename."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        staged, final = f"{self.root}/{name}/.{uuid.uuid4().hex}", f"{self.root}/{name}/present.json"
        out = self._files(staged).create(self._path(staged), True)
        try:
            out.write(bytearray(json.dumps(present).encode()))
        finally:
            out.close()
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files(final).getUri(), sc._jsc.hadoopConfiguration())
        context.rename(self._path(staged), self._path(final), options)

    def exists(self, name: str) -> bool:
        return self._present(name) is not None

    def read(self, name: str) -> DataFrame:
        """The table's present rows. A frame read before a publication keeps the rows of its time until tidy()."""
        present = self._present(name)
        if present is None:
            raise FileNotFoundError(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{present['version']}")

    def publish(self, name: str, df: DataFrame, table: Table | None = None) -> DataFrame:
        """Write df as the table's rows and read them again. With a table its conditions on rows are counted in the same pass; if a row
        breaks one, ConstraintError is raised and the old rows stay."""
        version = uuid.uuid4().hex
        seen = Observation()
        if table:
            rules = [F.col(c).isNull() for c in table.not_null] + [~F.expr(c) for c in table.checks]
            df = df.observe(seen, *[F.count_if(rule).alias(str(k)) for k, rule in enumerate(rules)])
        path = f"{self.root}/{name}/{version}"
        try:
            df.write.parquet(path)
            names = [f"not null {c}" for c in table.not_null] + [f"check {c}" for c in table.checks] if table else []
            broken = {n: seen.get[str(k)] for k, n in enumerate(names) if seen.get[str(k)]} if table else {}
            if broken:
                raise ConstraintError(broken)
        except BaseException:
            self._files(path).delete(self._path(path), True)
            raise
        self._name(name, {"version": version})
        return self.read(name)

    def tidy(self, name: str) -> None:
        """Remove versions that are no longer present. Frames that read them must be done with."""
        keep = {"present.json", (self._present(name) or {}).get("version")}
        folder = f"{self.root}/{name}"
        for found in self._files(folder).listStatus(self._path(folder)):
            if found.getPath().getName() not in keep:
                self._files(folder).delete(found.getPath(), True)
