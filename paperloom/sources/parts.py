"""Format ``zipparts``: the parts of ZIP packages (office documents) as rows. A predicate on the part's name decides which
parts are inflated; files are the partitions."""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from paperloom.plans.workspace import ship

SCHEMA = "path string, part string, size long, content binary"


class Package(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


class PartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            own = f.attribute == ("part",)
            if own and isinstance(f, EqualTo):
                self.tests.append(("in", (f.value,)))
            elif own and isinstance(f, In):
                self.tests.append(("in", tuple(f.value)))
            elif own and isinstance(f, (StringStartsWith, StringEndsWith)):
                self.tests.append(("starts" if isinstance(f, StringStartsWith) else "ends", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Package(self.path)]
        base = root.rstrip("/")
        found = sorted(x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob))
        return [Package(self.path.rstrip("/") + p[len(base) :]) for p in found]

    def wanted(self, name: str) -> bool:
        return all(name in v if how == "in" else name.startswith(v) if how == "starts" else name.endswith(v) for how, v in self.tests)

    def read(self, partition: Package | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no files
            return
        store, path = _store(partition.path)
        with store.open_input_file(path) as stream:
            try:
                package = zipfile.ZipFile(stream)
            except zipfile.BadZipFile:
                return
            for info in package.infolist():
                if not info.is_dir() and self.wanted(info.filename):
                    yield partition.path, info.filename, info.file_size, package.read(info)


class FilesWriter(DataSourceWriter):
    """One file a row, by its name; a name is taken as given, so names are made unique first."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for row in rows:
            name = row["name"].replace("/", "_")
            with store.open_output_stream(f"{root}/.{name}.part") as out:
                out.write(bytes(row["content"]))
            store.move(f"{root}/.{name}.part", f"{root}/{name}")  # whole or not at all, also if a task runs again
        return WriterCommitMessage()


class PartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipparts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filerows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def read_parts(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """Parts of the packages under ``path``. Spark keeps predicates that were pushed down for later queries of the same table,
    so call this anew for each."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PartsSource)
    return spark.read.format("zipparts").options(path=path, glob=glob).load()


def write_files(files: DataFrame, path: str) -> None:
    """(name, content) to a folder, one file a row."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(FilesSink)
    files.select("name", "content").write.format("filerows").option("path", path).mode("append").save()
