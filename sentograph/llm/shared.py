"""The folder that all executors share, and tables and files in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no folder, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints/sentograph"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a default where it is unset and all runs on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = DEFAULT_SHARED
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that this process has made and not removed.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all intermediate folders that this process made, for when its results are no longer read. Returns how many."""
    gone = 0
    while _made:
        files, path = open_fs(_made.pop())
        if files.get_file_info(path).type.name == "Directory":
            files.delete_dir(path)
            gone += 1
    return gone


#: Bytes of an Arrow batch that goes to Python, for operators over texts; Spark's own bound is 64 MiB, for each of several buffers a task.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Lowers the session's bound of bytes in a batch, so that memory doesn't follow the length of texts. It stays lowered, as a plan reads it only when it
    runs; a session that wants larger batches for other work sets ``spark.sql.execution.arrow.maxBytesPerBatch`` again before that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: a cut lineage that outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_texts(df: DataFrame, name: str) -> DataFrame:
    """The same for rows with whole texts or other large columns, which a slower codec makes smaller by a fifth to a third."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """A pyarrow file system and the path in it; works on the driver and on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Draft:
    """A file under a name of its own that takes its place when it is closed: a task that runs twice leaves one whole file."""

    def __init__(self, uri: str):
        self.files, self.path = open_fs(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft, self.size = f"{self.path}.{uuid.uuid4().hex}.draft", 0
        self.out = self.files.open_output_stream(self.draft, compression=None)

    def write(self, data) -> int:
        """Adds the bytes; returns where they begin."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> int:
        self.out.close()
        try:
            self.files.move(self.draft, self.path)
        except OSError:  # some stores don't replace a file that an earlier run of the task left
            self.files.delete_file(self.path)
            self.files.move(self.draft, self.path)
        return self.size


def publish(uri: str, chunks) -> int:
    """Writes the chunks as a whole file. Returns its size."""
    out = Draft(uri)
    for chunk in chunks:
        out.write(chunk)
    return out.close()
