"""Framed binary files of problems, results and grids: a data source that reads problems by byte ranges and writes them.

All values are little-endian and unpadded. A file is its total length (u64),
then the fields of HEADER in order; a string is a u64 count and its bytes, a
list or map a u64 count and its entries, a grid three i32 and a list of blocks of
three i32 and 64 doubles.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

VERSION = (3, 1)
SHAPE = (4, 4, 4)
CELLS = "path string, i int, j int, k int, density double"
FORCES = "path string, seq long, i int, j int, k int, fx double, fy double, fz double"
DIRICHLET = "path string, i int, j int, k int, axis int, value double"
HEADER = "path string, name string, value string"
RESIDUALS = "path string, step long, residual double"
DISPLACEMENTS = "path string, i int, j int, k int, u0 double, u1 double, u2 double"
KINDS = {"density": CELLS, "mu": CELLS.replace("density", "mu"), "lambda": CELLS.replace("density", "lambda"), "forces": FORCES, "dirichlet": DIRICHLET, "dirichlet_cells": DIRICHLET, "header": HEADER}
RESULTS = {"displacements": DISPLACEMENTS, "residual_field": CELLS.replace("density", "residual"), "residuals": RESIDUALS, "header": HEADER}
GRIDS = {"double": "<f8", "float": "<f4", "uint8": "u1"}
BLOCK = [("base", "<i4", 3), ("data", "<f8", 64)]
FORCE, CONDITION = [("at", "<i4", 3), ("f", "<f8", 3)], [("at", "<i4", 3), ("axis", "<i4"), ("value", "<f8")]


class Cursor:
    """Reads values one after another from a file, of which it holds a window."""

    def __init__(self, file, window: int = 1 << 16) -> None:
        self.file, self.window, self.at, self.begin, self.held = file, window, 0, 0, b""

    def bytes(self, n: int) -> bytes:
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(max(n, self.window))
        self.at += n
        return self.held[self.at - n - self.begin : self.at - self.begin]

    def take(self, form: str) -> tuple:
        return struct.unpack(f"<{form}", self.bytes(struct.calcsize(f"<{form}")))

    def text(self) -> str:
        (n,) = self.take("Q")
        return self.bytes(n).decode()

    def place(self, fields: list) -> tuple[int, int]:
        """(offset, count) of a list of records, which is skipped."""
        (n,) = self.take("Q")
        at, self.at = self.at, self.at + n * np.dtype(fields).itemsize
        return at, n

    def records(self, fields: list) -> np.ndarray:
        at, n = self.place(fields)
        end, self.at = self.at, at
        return np.frombuffer(self.bytes(end - at), np.dtype(fields), n)

    def grid(self, form: str = "<f8", values: int = 64) -> np.ndarray:
        self.take("iii")
        return self.records([("base", "<i4", 3), ("data", form, values)])

    def named(self, header: dict[str, object], names: str, form: str) -> None:
        header.update(zip(names.split(), self.take(form), strict=True))


def _opened(file) -> Cursor:
    """A file's values after its length; a wrong length stops."""
    file = io.BytesIO(file) if isinstance(file, bytes) else file
    c = Cursor(file)
    if c.take("Q")[0] != file.seek(0, 2):
        raise ValueError("the file's length isn't the one that it names")
    return c


def _begun(file) -> tuple[Cursor, dict[str, object]]:
    """What problems and results begin with: version and extra values."""
    c, header = _opened(file), {}
    if c.take("ii") != VERSION:
        raise ValueError("unknown version")
    for kind, form in (("string", None), ("int", "i"), ("double", "d")):
        for _ in range(c.take("Q")[0]):
            name = c.text()
            header[f"extra {kind} {name}"] = c.take(form)[0] if form else c.text()
    return c, header


def layout(file, settings: bool = False) -> tuple[dict[str, object], dict[str, tuple[int, int]]]:
    """(header, (offset, count) of each list) of a problem; reads the values between the lists alone.

    A file of densities has a grid density, another one two grids mu and lambda. Stops at a wrong length or version.
    With ``settings`` the header also has what stands after the lists.
    """
    c, header = _begun(file)
    c.named(header, "dx preserved_buffer_size use_density_only", "dQ?")
    out = dict.fromkeys(("density", "mu", "lambda"), (0, 0))
    if header["use_density_only"]:
        c.named(header, "global_mu global_lambda", "dd")
    for name in ("density",) if header["use_density_only"] else ("mu", "lambda"):
        c.take("iii")
        out[name] = c.place(BLOCK)
    c.named(header, "mg_level explicit_mg_level pre_and_post_smoothing_iter bottom_smoothing_iter jacobi_damping", "iiiid")
    c.named(header, "resolution_x resolution_y resolution_z", "iii")
    out |= {"forces": c.place(FORCE), "dirichlet": c.place(CONDITION), "dirichlet_cells": c.place(CONDITION)}
    if settings:
        c.named(header, "krylov_tolerance krylov_max_iterations krylov_restart krylov_print", "dii?")
        header["caller_method"] = c.text()
    return header, out


def parse_results(data: bytes) -> dict[str, object]:
    """Displacements, residuals and header of one result; stops at a wrong length or version."""
    c, header = _begun(data)
    out = {"displacements": c.grid("<f8", 4 * 64), "residual_field": c.grid()}
    header["info"] = c.text()
    out["residuals"] = c.records([("residual", "<f8")])["residual"]
    c.named(header, "error_code success", "i?")
    return out | {"header": header}


def cells_of(found: np.ndarray, names: list[str], width: int = 1) -> pd.DataFrame:
    """The cells of blocks where a value isn't 0; each has ``width`` values, of which the first get the names."""
    at = (found["base"][:, None, :] + np.stack(np.unravel_index(np.arange(64), SHAPE), 1)).reshape(-1, 3)
    value = found["data"].reshape(-1, width)[:, : len(names)].astype(np.float64)
    some = (value != 0).any(1)
    return pd.concat([pd.DataFrame(at[some], columns=["i", "j", "k"]), pd.DataFrame(value[some], columns=names)], axis=1)


def rows_of(kind: str, path: str, found: object, first: int = 0) -> pd.DataFrame:
    """The rows of a list, whose first record is number ``first``."""
    if kind == "header":
        out = pd.DataFrame({"name": list(found), "value": [str(v) for v in found.values()]}, dtype=object)
    elif kind == "residuals":
        out = pd.DataFrame({"step": np.arange(len(found)), "residual": found})
    elif kind == "displacements":
        out = cells_of(found, ["u0", "u1", "u2"], 4)
    elif kind in ("density", "mu", "lambda", "residual_field"):
        out = cells_of(found, ["residual" if kind == "residual_field" else kind])
    else:
        out = pd.DataFrame(found["at"], columns=["i", "j", "k"])
        if kind == "forces":
            out.insert(0, "seq", first + np.arange(len(out)))
            out[["fx", "fy", "fz"]] = found["f"]
        else:
            out["axis"], out["value"] = found["axis"], found["value"]
    out.insert(0, "path", path)
    return out


def _each_file(spark: SparkSession, path: str, rows: object, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield rows(p, content)

    return files.mapInPandas(run, schema)


def record(kind: str) -> list:
    return FORCE if kind == "forces" else CONDITION if kind.startswith("dirichlet") else BLOCK


@dataclass
class Range(InputPartition):
    """``count`` records of a file's list from number ``first`` on, at a byte offset; the header is one range of its own."""

    path: str
    offset: int = 0
    first: int = 0
    count: int = 0


class ProblemReader(DataSourceReader):
    def __init__(self, path: str, kind: str, size: int) -> None:
        self.path, self.kind, self.size = path, kind, size

    def partitions(self) -> list[Range]:
        store, top = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(top)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(top))
        out = []
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if self.kind == "header":
                out.append(Range(f.path))
                continue
            with store.open_input_file(f.path) as file:
                offset, count = layout(file)[1][self.kind]
            each = np.dtype(record(self.kind)).itemsize
            out += [Range(f.path, offset + n * each, n, min(self.size, count - n)) for n in range(0, count, self.size)]
        return out or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            if self.kind == "header":
                found = layout(file, settings=True)[0]
            else:
                kind = np.dtype(record(self.kind))
                file.seek(partition.offset)
                found = np.frombuffer(file.read(partition.count * kind.itemsize), kind, partition.count)
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in KINDS[self.kind].split(", "))])
        yield pa.RecordBatch.from_pandas(rows_of(self.kind, partition.path, found, partition.first), schema=schema, preserve_index=False)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class ProblemWriter(DataSourceWriter):
    """Tasks stream their files into a staging folder; the commit moves whole files, an abort removes the folder."""

    def __init__(self, path: str) -> None:
        self.path, self.name = path, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        store, top = fs.FileSystem.from_uri(self.path)
        folder = posixpath.join(top, self.name, str(TaskContext.get().taskAttemptId()))
        file, at, done = None, None, []
        try:
            for row in iterator:
                name = posixpath.basename(row["path"])
                if name != at:
                    if file:
                        file.close()
                    store.create_dir(folder, recursive=True)
                    at, file = name, store.open_output_stream(posixpath.join(folder, name))
                    done.append((posixpath.join(folder, name), posixpath.join(top, name)))
                file.write(row["chunk"])
        finally:
            if file:
                file.close()
        return Staged(done)

    def _clear(self) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        folder = posixpath.join(top, self.name)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for staged, final in m.files if m else ():
                store.move(staged, final)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()


class ProblemFiles(DataSource):
    """Options: path (a file or a folder, of any store that pyarrow knows), kind (of KINDS), records (a task's most)."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_problems"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "density")]

    def reader(self, schema) -> ProblemReader:
        return ProblemReader(self.options["path"], self.options.get("kind", "density"), int(self.options.get("records", 1 << 15)))

    def writer(self, schema, overwrite: bool) -> ProblemWriter:
        return ProblemWriter(self.options["path"])


def read(spark: SparkSession, path: str, kind: str = "density", records: int = 1 << 15) -> DataFrame:
    """A table of KINDS of all problem files of a path; a task reads ``records`` blocks, forces or conditions at most."""
    spark.dataSource.register(ProblemFiles)
    return spark.read.format("voxmill_problems").option("kind", kind).option("records", records).load(path)


def read_results(spark: SparkSession, path: str, kind: str = "displacements") -> DataFrame:
    """A table of RESULTS of all result files of a path; a file is read in one task."""
    return _each_file(spark, path, lambda p, content: rows_of(kind, p, parse_results(content)[kind]), RESULTS[kind])


def read_grid(spark: SparkSession, path: str, form: str = "float") -> DataFrame:
    """(path, i, j, k, value) of all files of a path that hold one grid of doubles, floats or bytes; values of 0 are left out."""

    def rows(p: str, content: bytes) -> pd.DataFrame:
        out = cells_of(_opened(content).grid(GRIDS[form]), ["value"])
        out.insert(0, "path", p)
        return out

    return _each_file(spark, path, rows, CELLS.replace("density", "value"))


def last_file(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    """The file of a folder whose name comes last, None if there is none; the contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).agg(F.max("path")).first()[0]


def _texts(settings: dict[str, object], counts: dict[str, int]) -> list[bytes]:
    """What stands before, between and after the lists of a problem, in order; the file's length is first of all."""
    text = lambda x: struct.pack("<Q", len(x.encode())) + x.encode()
    value = lambda names: [settings.get(n, 0) for n in names.split()]
    out = [struct.pack("<ii", *VERSION)]
    for kind, form in (("string", None), ("int", "<i"), ("double", "<d")):
        extra = sorted((k.removeprefix(f"extra {kind} "), v) for k, v in settings.items() if k.startswith(f"extra {kind} "))
        out += [struct.pack("<Q", len(extra)), *(text(k) + (struct.pack(form, v) if form else text(v)) for k, v in extra)]
    grids = [k for k in ("density", "mu", "lambda") if k in counts]
    shape, dense = struct.pack("<iii", *value("resolution_x resolution_y resolution_z")), grids == ["density"]
    out.append(struct.pack("<dQ?", *value("dx preserved_buffer_size"), dense) + (struct.pack("<dd", *value("global_mu global_lambda")) if dense else b""))
    parts = [b"".join(out) + shape, *[shape] * (len(grids) - 1)]
    parts.append(struct.pack("<iiiid", *value("mg_level explicit_mg_level pre_and_post_smoothing_iter bottom_smoothing_iter jacobi_damping")) + shape)
    lists = [*grids, "forces", "dirichlet", "dirichlet_cells"]
    parts += [b"", b""]
    parts = [p + struct.pack("<Q", counts[k]) for p, k in zip(parts, lists, strict=True)]
    parts.append(struct.pack("<dii?", *value("krylov_tolerance krylov_max_iterations krylov_restart krylov_print")) + text(settings.get("caller_method", "")))
    size = 8 + sum(map(len, parts)) + sum(counts[k] * np.dtype(record(k)).itemsize for k in lists)
    parts[0] = struct.pack("<Q", size) + parts[0]
    return parts


def encoded(cells: DataFrame | tuple[DataFrame, DataFrame], forces: DataFrame, dirichlet: DataFrame, dirichlet_cells: DataFrame, settings: dict[str, object]) -> DataFrame:
    """(path, chunk): the bytes of a problem file for each path of the tables of KINDS, a file's chunks in order in one partition.

    ``cells`` are densities, or two tables of mu and lambda. Blocks are ordered by
    coordinates, forces by seq, conditions by node, axis and value. ``settings`` are what
    is read as header; what is missing is 0 or empty. Only counts are gathered for a file; a
    task holds a batch of it.
    """
    tables = {"density": blocks(cells, "path")} if isinstance(cells, DataFrame) else {k: blocks(df.withColumnRenamed(k, "density"), "path") for k, df in zip(("mu", "lambda"), cells, strict=True)}
    tables |= {"forces": forces, "dirichlet": dirichlet, "dirichlet_cells": dirichlet_cells}
    order = {"forces": ["seq"], "dirichlet": ["i", "j", "k", "axis", "value"], "dirichlet_cells": ["i", "j", "k", "axis", "value"]}
    out = "path string, part int, key array<double>, chunk binary"

    def records(kind: str, part: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = np.zeros(len(pdf), record(kind))
                found[found.dtype.names[0]] = pdf[["i", "j", "k"]].to_numpy().reshape(-1, 3)
                if kind == "forces":
                    found["f"] = pdf[["fx", "fy", "fz"]].to_numpy()
                elif "data" in found.dtype.names:
                    found["data"] = np.stack(pdf["data"].to_numpy()) if len(pdf) else found["data"]
                else:
                    found["axis"], found["value"] = pdf["axis"], pdf["value"]
                yield pd.DataFrame({"path": pdf["path"], "part": part, "key": pdf["key"], "chunk": [r.tobytes() for r in found]})

        return run

    chunks, counts = None, None
    for n, (kind, df) in enumerate(tables.items()):
        key = F.array(*(F.col(c).cast("double") for c in order.get(kind, ["i", "j", "k"]))).alias("key")
        own = df.select(*df.columns, key).mapInPandas(records(kind, 2 * n + 1), out)
        many = df.groupBy("path").agg(F.count("*").alias(kind))
        chunks, counts = (own, many) if chunks is None else (chunks.union(own), counts.join(many, "path", "full"))

    names = list(tables)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r["path"], 2 * n, [0.0], b) for r in pdf.fillna(0).to_dict("records") for n, b in enumerate(_texts(settings, {k: int(r[k]) for k in names}))]
            yield pd.DataFrame(rows, columns=["path", "part", "key", "chunk"])

    chunks = chunks.union(counts.mapInPandas(between, out))
    return chunks.repartition("path").sortWithinPartitions("path", "part", "key").select("path", "chunk")


def write(files: DataFrame, folder: str) -> None:
    """The rows (path, chunk) of ``encoded`` as files of the paths' last names in a folder; files stand there whole or not at all."""
    files.sparkSession.dataSource.register(ProblemFiles)
    files.write.format("voxmill_problems").mode("append").save(folder)


def blocks(cells: DataFrame, *by: str) -> DataFrame:
    """(i, j, k, data), after the columns ``by``: cells in blocks of 64 values, as files hold them; missing cells are 0."""
    base = [(F.floor(F.col(c) / 4) * 4).cast("int").alias(c) for c in "ijk"]
    at = F.pmod("i", F.lit(4)) * 16 + F.pmod("j", F.lit(4)) * 4 + F.pmod("k", F.lit(4))
    return cells.groupBy(*by, *base).agg(*(F.max(F.when(at == n, F.col("density"))).alias(f"v{n}") for n in range(64))).select(*by, "i", "j", "k", F.array(*(F.coalesce(f"v{n}", F.lit(0.0)) for n in range(64))).alias("data"))
