"""The contract of a reading engine, and how crops are read by one: Arrow batches, one engine a worker, a row for every crop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MOST_BYTES = 8 << 20  #: of crops that an engine is handed at a time
READING = T.StructType([T.StructField("raw", T.StringType()), T.StructField("conf", T.DoubleType()), T.StructField("error", T.StringType())])
_made: dict[str, Engine] = {}


class Engine(Protocol):
    """Reads crops of one kind (number, date, text, free); a reading is a text or None, and a confidence from 0 to 1."""

    def read(self, images: list[bytes], kind: str) -> list[tuple[str | None, float]]: ...


def the_engine(make: Callable[[], Engine]) -> Engine:
    """This worker's engine, made when it first reads; models are loaded once a worker, not once a batch or task."""
    name = f"{make.__module__}.{make.__qualname__}"
    if name not in _made:
        _made[name] = make()
    return _made[name]


def groups(images: list[bytes | None], kinds: list[str], most: int) -> Iterator[list[int]]:
    """Places of crops of one kind that are read together: ``most`` bytes at most, or one larger crop; lost crops are in none."""
    open_: dict[str, list[int]] = {}
    size: dict[str, int] = {}
    for k, (image, kind) in enumerate(zip(images, kinds)):
        if not image:
            continue
        if open_.get(kind) and size[kind] + len(image) > most:
            yield open_.pop(kind)
            size[kind] = 0
        open_.setdefault(kind, []).append(k)
        size[kind] = size.get(kind, 0) + len(image)
    yield from open_.values()


def read_all(engine: Callable[[], Engine], images: list[bytes | None], kinds: list[str], most: int = MOST_BYTES) -> tuple[list, list, list]:
    raw: list[str | None] = [None] * len(images)
    conf, error = [0.0] * len(images), [None if i else "no_crop" for i in images]

    def put(at: list[int], read: list[tuple[str | None, float]]) -> None:
        if len(read) != len(at):
            raise ValueError("an engine must return a reading for every crop")
        for k, (text, sure) in zip(at, read):
            raw[k], conf[k] = text, float(sure or 0.0)

    for at in groups(images, kinds, most):
        kind = kinds[at[0]]
        try:
            put(at, engine().read([images[k] for k in at], kind))
        except Exception:  # one crop fails its group, so each is read alone and only those that fail again are lost
            for k in at:
                try:
                    put([k], engine().read([images[k]], kind))
                except Exception as failed:
                    raw[k], conf[k], error[k] = None, 0.0, f"{type(failed).__name__}: {failed}"
    return raw, conf, error


def read_crops(crops: DataFrame, make: Callable[[], Engine], image: str = "image", kind: str = "kind", most: int = MOST_BYTES) -> DataFrame:
    """crops without their images, and raw, conf, error as the engine that make() gives reads them; one row for each crop.

    A null or empty image reads as nothing and has the error ``no_crop``; a crop that the engine fails on has the failure's
    name and text. make must be importable by name where workers run. Columns called raw, conf or error are replaced.
    """
    return read_by(crops, {"": (make, None)}, image, kind, most)


def read_by(crops: DataFrame, makes: dict[str, tuple[Callable[[], Engine], set[str] | None]], image: str = "image", kind: str = "kind", most: int = MOST_BYTES) -> DataFrame:
    """As ``read_crops``, by several engines in one pass: their columns begin with the names in ``makes``.

    An engine with a set of kinds is not asked for crops of others, for which its columns are null, 0 and null.
    """
    added = [T.StructField(name + f.name, f.dataType) for name in makes for f in READING.fields]
    kept = [c for c in crops.columns if c != image and c not in {f.name for f in added}]
    schema = T.StructType([*[crops.schema[c] for c in kept], *added])
    types = (pa.string(), pa.float64(), pa.string())

    def asked(make: Callable[[], Engine], only: set[str] | None, images: list[bytes | None], kinds: list[str]) -> tuple[list, list, list]:
        if only is None:
            return read_all(lambda: the_engine(make), images, kinds, most)
        at = [k for k, kind_ in enumerate(kinds) if kind_ in only]
        full = tuple([none] * len(kinds) for none in (None, 0.0, None))
        for own, read in zip(full, read_all(lambda: the_engine(make), [images[k] for k in at], [kinds[k] for k in at], most)):
            for k, value in zip(at, read):
                own[k] = value
        return full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images, kinds = batch[image].to_pylist(), batch[kind].to_pylist()
            read = [pa.array(v, t) for make, only in makes.values() for v, t in zip(asked(make, only, images, kinds), types)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *read], schema.names)

    return crops.mapInArrow(run, schema)
