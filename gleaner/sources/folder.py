"""A folder of files and its manifest as a data source: spark.read.format("gleaner_folder").load(root)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "gleaner_folder"
#: Suffixes of documents, names that a manifest beside them may have, and the fields of its entries.
SUFFIXES, MANIFESTS = (".htm", ".html", ".markdown", ".md", ".pdf", ".txt"), ("_sources.yaml", "_sources.yml")
FIELDS = ("source_id", "authority", "status", "language", "url", "version")
COLUMNS = ("rel_path", "suffix", *FIELDS, "text")
#: Bytes of files, and files, of one partition; bytes of text of one batch.
PART_BYTES, PART_FILES, BATCH_BYTES = 32 << 20, 1000, 4 << 20


def _suffix(name: str) -> str:
    stem, dot, end = name.rpartition(".")
    return "." + end.lower() if dot and stem else ""


def _place(path: str) -> tuple[files.FileSystem, str]:
    if "://" in path and not path.startswith("file://"):
        return files.FileSystem.from_uri(path)
    return files.LocalFileSystem(), path.removeprefix("file://").rstrip("/") or "/"


def manifest_entries(text: str) -> dict[str, dict]:
    """The fields of each path of a YAML manifest, which may hold them under `sources`; a path listed twice is an error."""
    import yaml

    def unique(node) -> None:
        if isinstance(node, yaml.MappingNode):
            names = [k.value for k, _ in node.value]
            again = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
            if again:
                raise ValueError(f"a manifest names {again[0]!r} more than once")
            for _, v in node.value:
                unique(v)

    unique(yaml.compose(text, Loader=yaml.SafeLoader))
    listed = yaml.safe_load(text) or {}
    entries = listed.get("sources", listed) if isinstance(listed, dict) else None
    if not isinstance(entries, dict) or not all(isinstance(v, dict) for v in entries.values()):
        raise ValueError("a manifest maps paths to fields")
    return entries


@dataclass
class Files(InputPartition):
    """Files of one task: (full path, values of the columns but the text)."""

    rows: list[tuple[str, tuple]]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.language = options.get("language", "fr")
        self.required = str(options.get("required", "false")).lower() == "true"
        self.part_bytes = int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Files]:
        fs, root = _place(self.root)
        if fs.get_file_info(root).type != files.FileType.Directory:
            if self.required:
                raise FileNotFoundError(f"{self.root} does not exist: make it before it is read")
            return [Files([])]
        found = sorted((f for f in fs.get_file_info(files.FileSelector(root, recursive=True)) if f.type == files.FileType.File), key=lambda f: f.path)
        beside = [f.path for f in found if f.path in {f"{root.rstrip('/')}/{m}" for m in MANIFESTS}]
        if len(beside) > 1:
            raise ValueError(f"{self.root} has several manifests: " + ", ".join(p.rpartition("/")[2] for p in beside))
        entries = {}
        if beside:
            with fs.open_input_stream(beside[0]) as f:
                entries = manifest_entries(f.read().decode())
        out, own, size = [], [], 0
        for f in found:
            name, suffix = f.base_name, _suffix(f.base_name)
            if suffix not in SUFFIXES or name.startswith("."):
                continue
            rel = f.path[len(root.rstrip("/")) + 1 :]
            given = {k: None if v is None else str(v) for k, v in entries.get(rel, {}).items()}
            default = {"source_id": rel[: len(rel) - len(suffix)], "authority": "official", "status": "review_required", "language": self.language}
            own.append((f.path, (rel, suffix, *(given.get(c) or default.get(c) for c in FIELDS))))
            size += f.size or 0
            if size >= self.part_bytes or len(own) >= PART_FILES:
                out.append(Files(own))
                own, size = [], 0
        return [*out, Files(own)] if own or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.root)
        kind = pa.schema([(c, pa.string()) for c in COLUMNS])
        rows, size = [], 0
        for path, values in partition.rows:
            text = None
            if values[1] != ".pdf":  # no text of its own
                with fs.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
            rows.append((*values, text))
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=kind)


class Folder(DataSource):
    """The documents of a folder, each with its manifest's fields or their defaults.

    Options: `language`, the default language; `required`, by which a folder that does not exist is an error
    and not empty; `partBytes`, the bytes of files of one task. Files of other suffixes and hidden ones are passed
    over. Several manifests in the root, a path listed twice, and a manifest of another shape are errors. An entry
    without its file counts for nothing. Bytes that are no UTF-8 become U+FFFD; a PDF has a null text.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def paths(root: str) -> list[str]:
    """The paths below root of the files that Folder reads, in order; names only, nothing is read."""
    return [values[0] for part in FolderReader({"path": root}).partitions() for _, values in part.rows]


def read_folder(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The rows of Folder, which is registered with the session first."""
    spark.dataSource.register(Folder)
    return spark.read.format(FORMAT).options(**options).load(root)
