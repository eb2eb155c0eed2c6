"""Registered readers: analyzer reports, exported graphs and git files as Spark data sources, ``spark.read.format("loom-sarif").load(path)``.

A format is a class of ``FORMATS`` with a schema and a function from a file's bytes to rows; ``register`` makes all of them, or a caller's own,
known to a session. Files are listed once and dealt into partitions of about ``bytesPerPartition``; equalities on ``report``, the file's path, leave
out files before they are read, those on other columns rows before they leave the worker. Paths are any that Arrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import dims
from ..shipping import ship


@dataclass
class Files(InputPartition):
    paths: list[str]


class FileFormat(DataSource):
    """Options: path, pattern (of file names), bytesPerPartition, mode (``failfast``, or ``permissive``: a file that can't be read gives no rows)."""

    kind, columns, pattern = "", "", "*"

    @classmethod
    def name(cls) -> str:
        return f"loom-{cls.kind}"

    def schema(self) -> str:
        return f"report string, {self.columns}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema.fields], type(self))

    @staticmethod
    def rows(content: bytes) -> Iterator[dict]:
        raise NotImplementedError


class _Reader(DataSourceReader):
    def __init__(self, options, names: list[str], form: type[FileFormat]):
        self.options, self.names, self.form = dict(options), names, form
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.tests[name] = self.tests[name] & values if name in self.tests else values
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(base)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file]
        pattern, most = self.options.get("pattern", self.form.pattern), int(self.options.get("bytesperpartition", self.options.get("bytesPerPartition", 32 << 20)))
        out, held = [], most
        for x in sorted(found, key=lambda x: x.path):
            name = posixpath.basename(x.path)
            if not fnmatch.fnmatch(name, pattern) or name[:1] in "._" and name != pattern or "report" in self.tests and x.path not in self.tests["report"]:
                continue
            if held + x.size > most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(x.path)
            held += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.options["path"])[0] if partition.paths else None
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            try:
                rows = list(self.form.rows(content))
            except (ValueError, ElementTree.ParseError, KeyError, TypeError, AttributeError):
                if self.options.get("mode", "failfast").lower() == "permissive":
                    continue
                raise
            for r in rows:
                r["report"] = path
                if all(r.get(name) in values for name, values in self.tests.items()):
                    yield tuple(r.get(n) for n in self.names)


class Sarif(FileFormat):
    kind, pattern = "sarif", "*.sarif"
    columns = "run int, ord int, rule_id string, level string, file string, line int, col int, rel_file string, rel_line int, rel_col int"

    @staticmethod
    def rows(content: bytes) -> Iterator[dict]:
        def place(x: dict, prefix: str) -> dict:
            p = (x or {}).get("physicalLocation") or {}
            uri, region = (p.get("artifactLocation") or {}).get("uri"), p.get("region") or {}
            uri = re.sub(r"^(\./|/)+", "", re.sub(r"^file:(//)?", "", uri).replace("\\", "/")) if uri is not None else None
            return {f"{prefix}file": uri, f"{prefix}line": region.get("startLine"), f"{prefix}col": max((region.get("startColumn") or 1) - 1, 0) if p else None}

        for i, run in enumerate(json.loads(content).get("runs") or []):
            for k, r in enumerate(run.get("results") or []):
                if r.get("locations"):
                    yield {"run": i, "ord": k, "rule_id": r.get("ruleId"), "level": r.get("level")} | place(r["locations"][0], "") | place(next(iter(r.get("relatedLocations") or []), {}), "rel_")


class GraphML(FileFormat):
    """Nodes (id, props) and edges (src, dst, edge_type, props) of one file; keys are resolved to attribute names."""

    kind, pattern = "graphml", "*.graphml"
    columns = "kind string, id string, src string, dst string, edge_type string, props map<string,string>"

    @staticmethod
    def rows(content: bytes) -> Iterator[dict]:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        tree = list(ElementTree.fromstring(content).iter())
        names = {e.get("id"): e.get("attr.name") or e.get("id") for e in tree if local(e) == "key"}
        for e in tree:
            if local(e) in ("node", "edge"):
                props: dict[str, str] = {}
                for d in e:
                    if local(d) == "data":
                        name = names.get(d.get("key"), d.get("key"))
                        props[name] = min(props.get(name, d.text or ""), d.text or "")
                label = props.get("labelE", props.get("label", ""))
                edge = {"src": e.get("source"), "dst": e.get("target"), "edge_type": dims.EDGE_LABELS.get(label.upper(), "AST_CHILD")} if local(e) == "edge" else {}
                yield {"kind": local(e), "id": e.get("id"), "props": props} | edge


class GitModules(FileFormat):
    kind, pattern, columns = "gitmodules", ".gitmodules", "name string, path string, url string, branch string"

    @staticmethod
    def rows(content: bytes) -> Iterator[dict]:
        here: dict | None = None
        for line in [*content.decode("utf-8", "replace").split("\n"), "[end]"]:
            head, pair = re.match(r"\s*\[\s*(\w+)(?:\s+\"([^\"]*)\")?", line), re.match(r"[ \t]*(\w+)[ \t]*=[ \t]*(.*?)[ \t\r]*$", line)
            if head:
                if here is not None:
                    yield here
                here = {"name": head[2], "path": "", "url": "", "branch": ""} if head[1] == "submodule" and head[2] is not None else None
            elif pair and here is not None and pair[1] in ("path", "url", "branch") and not here[pair[1]]:
                here[pair[1]] = pair[2]


class GitIndex(FileFormat):
    """Entries of binary git indexes, versions 2 to 4: what ls-tree would list if it could be asked."""

    kind, pattern, columns = "gitindex", "index", "path string, mode int, sha string, stage int"

    @staticmethod
    def rows(content: bytes) -> Iterator[dict]:
        if content[:4] != b"DIRC" or len(content) < 12:
            raise ValueError("no git index")
        version, count = int.from_bytes(content[4:8], "big"), int.from_bytes(content[8:12], "big")
        if version not in (2, 3, 4):
            raise ValueError(f"git index of version {version}")
        at, name = 12, b""
        for _ in range(count):
            begin = at
            mode, sha, flags = int.from_bytes(content[at + 24 : at + 28], "big"), content[at + 40 : at + 60], int.from_bytes(content[at + 60 : at + 62], "big")
            at += 64 if version > 2 and flags & 0x4000 else 62
            if version == 4:  # the name repeats all but so many bytes of the one before
                drop, more = content[at] & 0x7F, content[at] & 0x80
                at += 1
                while more:
                    drop, more = (drop + 1 << 7) | content[at] & 0x7F, content[at] & 0x80
                    at += 1
                name = name[: len(name) - drop]
            else:
                name = b""
            end = content.index(b"\0", at)
            name += content[at:end]
            at = end + 1 if version == 4 else begin + (end - begin + 8) // 8 * 8
            yield {"path": name.decode("utf-8", "replace"), "mode": mode, "sha": sha.hex(), "stage": flags >> 12 & 3}


FORMATS: dict[str, type[FileFormat]] = {f.kind: f for f in (Sarif, GraphML, GitModules, GitIndex)}


def register(spark: SparkSession, *formats: type[FileFormat]) -> SparkSession:
    """Make the formats, all of FORMATS by default, known to the session, with filters passed to them."""
    ship(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in formats or FORMATS.values():
        spark.dataSource.register(f)
    return spark
