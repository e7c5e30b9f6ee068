"""GeoTIFF files as a data source: `spark.dataSource.register(GeoTiff)`, then read or write format("geotiff").

Reading gives a row a file: name, size, bands, the affine transform, bounds, nodata and all tags, from the header alone;
with option pixels=true also the values. Files are listed once in the driver and dealt over partitions; filters on `name` prune
the list before any file is opened. Writing takes rows of name, width, height, x, y, pixel, nodata, values (one band of doubles) and makes
one little-endian file a row, of one uncompressed strip. Paths go through pyarrow's file systems, so they may be in any store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

# TIFF's field types, and the tags that are read.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT, PIXEL, TIE, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339, 33550, 33922, 42113
#: What is read of a file at first; a directory further in is read on its own.
HEAD = 4096

COLUMNS = "name string, width int, height int, bands int, pixel_x double, pixel_y double, x double, y double, left double, bottom double, right double, top double, nodata string, tags map<int, string>"


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header(file) -> dict[int, list]:
    """Tags of the first directory."""
    head = file.read(HEAD)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    at = struct.unpack(f"{order}I", head[4:8])[0]

    def read(begin: int, size: int) -> bytes:
        if begin + size <= len(head):
            return head[begin : begin + size]
        file.seek(begin)
        return file.read(size)

    tags = {}
    (n,) = struct.unpack(f"{order}H", read(at, 2))
    entries = read(at + 2, 12 * n)
    for i in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", entries[12 * i : 12 * i + 8])
        if kind not in KINDS:
            continue
        form, size = KINDS[kind]
        raw = entries[12 * i + 8 : 12 * i + 8 + size * count] if size * count <= 4 else read(struct.unpack(f"{order}I", entries[12 * i + 8 : 12 * i + 12])[0], size * count)
        tags[tag] = [raw.rstrip(b"\0").decode("latin-1")] if form == "s" else list(struct.unpack(f"{order}{count}{form}", raw))
    return tags


def row(name: str, tags: dict[int, list]) -> tuple:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    px, py = (tags.get(PIXEL) or [1.0, 1.0, 0.0])[:2]
    tie = tags.get(TIE) or [0.0] * 6
    x, y = tie[3] - tie[0] * px, tie[4] + tie[1] * py
    text = {k: " ".join(map(str, v)) for k, v in tags.items() if k not in (OFFSETS, COUNTS)}
    return (name, width, height, tags.get(SAMPLES, [1])[0], px, py, x, y, x, y - height * py, x + width * px, y, (tags.get(NODATA) or [None])[0], text)


def encoded(width: int, height: int, x: float, y: float, pixel: float, nodata: float | None, values: list[float]) -> bytes:
    data = struct.pack(f"<{width * height}d", *values)
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [64]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0]), (SAMPLES, 3, [1]), (ROWS, 4, [height]), (COUNTS, 4, [len(data)]), (FORMAT, 3, [3]), (PIXEL, 12, [pixel, pixel, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, x, y, 0.0])]
    if nodata is not None:
        fields.append((NODATA, 2, f"{nodata:g}\0".encode()))
    place = 8 + 2 + 12 * len(fields) + 4
    out, beyond = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    sizes = sum(len(v) * KINDS[k][1] for _, k, v in fields if len(v) * KINDS[k][1] > 4)
    for tag, kind, v in fields:
        v = [place + sizes] if tag == OFFSETS else v
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{KINDS[kind][0]}", *v)
        out += struct.pack("<HHI", tag, kind, len(v))
        if len(raw) > 4:
            out += struct.pack("<I", place + len(beyond))
            beyond += raw
        else:
            out += raw.ljust(4, b"\0")
    return out + b"\0" * 4 + beyond + data


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pixels, self.tests = options["path"], options.get("pixels", "false") == "true", []
        self.each = int(options.get("files_per_partition", 256))

    def pushFilters(self, filters: list) -> Iterator:
        """Takes tests of a file's name; Spark applies the others to the rows."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.tests.append({f.value}.__contains__)
            elif isinstance(f, In) and f.attribute == ("name",):
                self.tests.append(set(f.value).__contains__)
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.tests.append(lambda name, start=f.value: name.startswith(start))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = store(self.path)
        found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.extension in ("tif", "tiff"))
        names = [n for n in found if all(test(n) for test in self.tests)]
        return [Files(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, path = store(self.path)
        for name in partition.names:
            with system.open_input_file(f"{path}/{name}") as file:
                tags = header(file)
                out = row(name, tags)
                if self.pixels:
                    file.seek(tags[OFFSETS][0])
                    out += (list(struct.unpack(f"<{out[1] * out[2]}d", file.read(tags[COUNTS][0]))),)
            yield out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    """Files get their name when whole, so a repeated task leaves the same files."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Written:
        system, path = store(self.path)
        system.create_dir(path, recursive=True)
        names = []
        for r in iterator:
            with system.open_output_stream(f"{path}/.{r.name}.part") as file:
                file.write(encoded(r.width, r.height, r.x, r.y, r.pixel, r.nodata, r["values"]))
            system.move(f"{path}/.{r.name}.part", f"{path}/{r.name}")
            names.append(r.name)
        return Written(names)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return COLUMNS + (", values array<double>" if self.options.get("pixels", "false") == "true" else "")

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark) -> None:
    """Make the format known, and let filters reach it."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
