"""Parquet tables: plain folders, and versioned sets that change together."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

MANIFEST = "version long, table_name string, part string, path string"
WHOLE = ""


def read_or_empty(spark, path, schema):
    """The table at `path`, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class VersionedTables:
    """Several tables published as one version.

    Each version is a set of folders, one or more per table and part. A small manifest
    table names the folders of every version, and the greatest version is the current one.
    Its rows are written last, in one file, so readers see the old set or the new set and
    never a mix. A candidate that is not published is overwritten by the next attempt.

    The current version is read once per object; a new object sees later versions.
    """

    def __init__(self, spark, root):
        self.spark = spark
        self.root = root.rstrip("/")
        self._manifest = f"{self.root}/_manifest"
        self._state = None

    def _load(self):
        rows = read_or_empty(self.spark, self._manifest, MANIFEST)
        newest = rows.agg(F.max("version")).scalar()
        version, folders = 0, {}
        for entry in rows.filter(F.col("version") == newest).orderBy("table_name", "path").collect():
            version = entry["version"]
            parts = folders.setdefault(entry["table_name"], {})
            parts.setdefault(entry["part"], []).append(entry["path"])
        return version, folders

    def current(self):
        """(version, {table: {part: folders}}); version 0 before the first publish."""
        if self._state is None:
            self._state = self._load()
        return self._state

    def read(self, name, schema, parts=None):
        """The current table, or only some of its parts; no rows where there are none."""
        known = self.current()[1].get(name, {})
        chosen = known if parts is None else [p for p in known if p in parts]
        folders = [path for part in chosen for path in known[part]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def candidate_path(self, name):
        return f"{self.root}/v{self.current()[0] + 1:08d}/{name}"

    def stage(self, name, frame):
        """Write a table of the next version and read it back; nothing is published yet."""
        path = self.candidate_path(name)
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def stage_parts(self, name, frame, column):
        """As `stage`, in one folder per value of `column`, which says where rows belong.

        Returns the rows and the folder of every part that has rows.
        """
        path = self.candidate_path(name)
        frame.write.mode("overwrite").partitionBy(column).parquet(path)
        staged = self.spark.read.schema(frame.schema).parquet(path)
        parts = [str(row[0]) for row in staged.select(column).distinct().collect()]
        return staged.drop(column), {part: f"{path}/{column}={part}" for part in parts}

    def publish(self, replaced=(), extended=(), parts=None):
        """Make staged tables current; tables that are not named keep their folders.

        `replaced` tables consist of the staged folder alone and `extended` tables gain it.
        `parts` maps a table to all folders of each changed part; a part without any goes.
        """
        version, known = self.current()
        tables = {name: dict(folders) for name, folders in known.items()}
        for name in replaced:
            tables[name] = {WHOLE: [self.candidate_path(name)]}
        for name in extended:
            folders = tables.setdefault(name, {})
            folders[WHOLE] = [*folders.get(WHOLE, []), self.candidate_path(name)]
        for name, changed in (parts or {}).items():
            folders = tables.get(name, {}) | changed
            tables[name] = {part: paths for part, paths in folders.items() if paths}
        rows = [
            (version + 1, name, part, path)
            for name, folders in tables.items()
            for part, paths in folders.items()
            for path in paths
        ]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(
            self._manifest
        )
        self._state = (version + 1, tables)
        return version + 1


def clustered(frame, column):
    """Evenly sized files, each holding few values of `column` in order.

    Rebalancing splits a value that holds a large share of the rows over several files.
    """
    return frame.hint("rebalance", F.col(column)).sortWithinPartitions(column)
