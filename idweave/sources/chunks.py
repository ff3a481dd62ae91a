"""A data source of byte chunks: recorded camera streams in a folder, read in pieces of a fixed size, as a table or a stream.

``spark.dataSource.register(ChunkSource)``, then ``spark.readStream.format("chunks").option("path", folder)``. Files may grow while
they are read: of one whose name ends in ``growing`` only whole chunks are handed out, of any other its last, shorter one as well.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK_BYTES = 4096
CHUNKS_A_PARTITION = 4096


class Piece(InputPartition):
    """Chunks ``first`` to ``end`` (exclusive) of one file."""

    def __init__(self, file: str, first: int, end: int, size: int):
        self.file, self.first, self.end, self.size = file, first, end, size


def opened(path: str) -> tuple:
    """The file system that a path names, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def sizes(path: str) -> dict[str, int]:
    """The folder's files with their sizes in bytes."""
    from pyarrow import fs

    system, at = opened(path)
    return {f.path: f.size for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.is_file}


def chunk_count(name: str, size: int, chunk: int, growing: str) -> int:
    return size // chunk if growing and name.endswith(growing) else -(-size // chunk)


def pieces(before: dict[str, int], after: dict[str, int], chunk: int, at_most: int) -> list[Piece]:
    return [Piece(f, k, min(k + at_most, end), chunk) for f, end in sorted(after.items()) for k in range(before.get(f, 0), end, at_most)]


def chunks(path: str, piece: Piece | None) -> Iterator[tuple]:
    """Rows of a piece; what a file holds beyond it is not read. Spark reads no piece where a folder holds nothing."""
    if piece is None:
        return
    system, _ = opened(path)
    with system.open_input_file(piece.file) as data:
        data.seek(piece.first * piece.size)
        for k in range(piece.first, piece.end):
            yield piece.file, k, k * piece.size, data.read(piece.size)


class ChunkSource(DataSource):
    """Options: path; chunk (bytes, 4096); chunks (in a partition, 4096); growing (suffix of files still being written, ``.part``)."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "file string, chunk_no long, position long, data binary"

    def settings(self) -> tuple[str, int, int, str]:
        return self.options["path"], int(self.options.get("chunk", CHUNK_BYTES)), int(self.options.get("chunks", CHUNKS_A_PARTITION)), self.options.get("growing", ".part")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(*self.settings())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChunkStream(*self.settings())


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, at_most: int, growing: str):
        self.path, self.chunk, self.at_most, self.growing = path, chunk, at_most, growing

    def partitions(self) -> list[Piece]:
        whole = {f: chunk_count(f, n, self.chunk, self.growing) for f, n in sizes(self.path).items()}
        return pieces({}, whole, self.chunk, self.at_most)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return chunks(self.path, partition)


class ChunkStream(DataSourceStreamReader):
    """Offsets are the number of chunks handed out of each file, so a stream that starts again goes on where it was."""

    def __init__(self, path: str, chunk: int, at_most: int, growing: str):
        self.path, self.chunk, self.at_most, self.growing = path, chunk, at_most, growing

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: chunk_count(f, n, self.chunk, self.growing) for f, n in sorted(sizes(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(start, end, self.chunk, self.at_most)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return chunks(self.path, partition)
