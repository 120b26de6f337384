"""Small helpers that every text operator uses."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import functions as F

import ordermill


def packed(docs, **inputs):
    """One column `row` with the untouched input row, and the named inputs beside it.

    Own columns of an operator cannot clash with columns of its input this way, and
    `select("row.*")` gives the input back. An input may be a column or its name.
    """
    return docs.select(F.struct("*").alias("row"), *[_column(c).alias(name) for name, c in inputs.items()])


def _column(source):
    return F.col(source) if isinstance(source, str) else source


def beside(frame, *names):
    """The input row of `packed` and the named own columns after it.

    An own name that the input has too, in any case of letters, gets underscores at its end until it is free.
    """
    taken = {x.lower() for x in frame.schema["row"].dataType.names}
    own = []
    for name in names:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        own.append(F.col(name).alias(free))
    return frame.select("row.*", *own)


def shared_folder(spark):
    """The folder that `spark.checkpoint.dir` names; without that setting, as in tests, one in the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def saved(frame):
    """Cut the lineage by a table in the shared folder; a lost executor costs nothing that is saved."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def table(spark, folder, name):
    """A given table, stored as one file or as a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reread(frame):
    """Write a frame as Parquet into the shared folder, and read it."""
    folder = f"{shared_folder(frame.sparkSession)}/stage-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


_SHIPPED = "_ordermill_shipped"


def ship(spark):
    """Give the package to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(ordermill.__file__).parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here; tasks fetch it from the driver
    archive = shutil.make_archive(f"{folder}/ordermill", "zip", root.parent, root.name)
    context.addPyFile(archive)
    setattr(context, _SHIPPED, True)
