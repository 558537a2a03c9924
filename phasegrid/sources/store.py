"""A stored table of configurations that is replaced as a whole: readers see a version, old or new, never a mixture.

A version is a folder of its own.  It counts from the moment a numbered pointer to it
exists, which a rename creates, and a rename gives one of two writers an error, who
then starts from the other's version.  Works on any store with such renames, through
Spark's file systems.
"""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from phasegrid.sources.config import latest_config

BLOBS = "intersection_id string, config_json string, updated_at double"
#: Versions that stay for those who still read them.
KEPT = 3


class ConfigStore:
    """Configurations (intersection_id, config_json, updated_at), one for each id, below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._where("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _where(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, folder) of all versions, the newest last."""
        if not self._fs.exists(self._where("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._where("versions"))]
        return sorted((int(n.split("=")[0]), n.split("=")[1]) for n in names if "=" in n)

    def version(self) -> int:
        """The number of the version that counts; 0 before the first."""
        return max((n for n, _ in self._pointers()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The version that counts, or an earlier one that is still there; nothing before the first."""
        found = dict(self._pointers())
        if not found:
            return self.spark.createDataFrame([], BLOBS)
        return self.spark.read.schema(BLOBS).parquet(f"{self.path}/data/{found[version or max(found)]}")

    def upsert(self, updates: DataFrame, tries: int = 10) -> int:
        """Puts configurations in, the newest ``updated_at`` of an id winning over what is there; returns the new version's number."""
        for _ in range(tries):
            base = self.version()
            current = self.read(base or None)
            folder = uuid.uuid4().hex
            latest_config(current, updates.select(*current.columns)).write.parquet(f"{self.path}/data/{folder}")
            if self._claimed(base + 1, folder):
                self._swept()
                return base + 1
            self._fs.delete(self._where(f"data/{folder}"), True)
        raise RuntimeError(f"{self.path}: other writers came first {tries} times")

    def _claimed(self, number: int, folder: str) -> bool:
        """Makes a version count, unless another one has its number: a folder by that number is made by one writer only."""
        self._fs.mkdirs(self._where("versions"))
        self._fs.mkdirs(self._where("claims"))
        self._fs.create(self._where(f"claims/{folder}")).close()
        context = self._hadoop.FileContext.getFileContext(self._where("").toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:  # fails where the number is taken
            context.rename(self._where(f"claims/{folder}"), self._where(f"claims/number-{number}"), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(self._where(f"claims/{folder}"), False)
            return False
        self._fs.create(self._where(f"versions/{number:012d}={folder}")).close()
        return True

    def _swept(self) -> None:
        for number, folder in self._pointers()[:-KEPT]:
            self._fs.delete(self._where(f"versions/{number:012d}={folder}"), False)
            self._fs.delete(self._where(f"data/{folder}"), True)
