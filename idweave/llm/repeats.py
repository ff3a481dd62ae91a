"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every window of bytes has an anchor, a gram found from the window alone, and the windows of one anchor in a row are a
run. Anchors are screened first: only runs whose anchor stands in several documents can repeat. Their bytes are fetched
and dealt by anchor; each task makes Burrows-Wheeler transforms of bounded shards of the different ones and merges these
by interleave refinement, whose intervals of equal windows, with their least documents, decide. Equal bytes are one
content: where documents of one task share it, only the least of them is dealt on, as the others repeat all of it. Two
contents can share a window only where they agree to both sides of their anchor for a window's length; the transforms
leave out contents that agree so far with no other. Runs
of a hot anchor, which very many documents hold, are cut into their windows, which are dealt by their own bytes. No window
is decided by a hash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idweave.llm.anchors import GRAM, WINDOW, anchors
from idweave.llm.bwt import intervals
from idweave.llm.common import Staged, small_batches

BUCKET_BYTES = 6 << 20  #: of text whose anchors a bucket holds, about
PART_BYTES = 4 << 20  #: of text that a task of the later passes holds, about
FLUSH_BYTES = 6 << 20
SHARD_BYTES = 1 << 19
HOT, PER_ROW = 1_024, 16  #: rows in its bucket that make an anchor hot; documents of a flush that hold it count as a row for so many
MOST_HOT = 1_000_000  #: anchors that are told to all tasks (8 MB), those of most rows; further ones keep their runs whole
SIX = "six bytes"  #: anchors travel as 48 bits; what only these have in common is told apart by the bytes
LOW = np.uint64((1 << 48) - 1)
ANCHOR = [("h", SIX), ("doc", np.int64)]
RUN = [("doc", np.int64), ("first", np.int64), ("n", np.int32), ("anchor", np.int16)]
ALONE = -1  #: in place of an anchor: windows of hot anchors, which are equal or share nothing
SPAN = [("doc", np.int64), ("start", np.int64), ("end", np.int64)]


def packed(key: str, groups: np.ndarray, columns: list[np.ndarray], kinds: list[tuple], **more: list) -> pa.RecordBatch:
    """A row for each group: the columns' values of the group as bytes."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    at = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.empty(0, int)
    ends = np.append(at[1:], len(groups))
    arrays = [pa.array(groups[at].astype(np.int32), pa.int32())]
    for column, (_, kind) in zip(columns, kinds):
        column = column[order]
        column = np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]) if kind == SIX else column.astype(kind)
        arrays.append(pa.array([column[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, [key, *(name for name, _ in kinds)])


def unpacked(table: pa.Table, kinds: list[tuple]) -> list[np.ndarray]:
    data = [b"".join(x for x in table[name].to_pylist() if x) for name, _ in kinds]
    six = lambda b: np.pad(np.frombuffer(b, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()
    return [six(b) if kind == SIX else np.frombuffer(b, kind) for b, (_, kind) in zip(data, kinds)]


def schema(key: str, kinds: list[tuple]) -> str:
    return ", ".join([f"{key} int", *(f"{name} binary" for name, _ in kinds)])


def recorded(buckets: int, parts: int):
    """Each document's anchors by their bucket. Anchors that documents read together share are noted at once, under
    negative numbers of the documents' parts, and go to their bucket once for all of these: a bucket gets few rows even of
    an anchor that most documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
            h, doc = h[~again], doc[~again]
            after = np.concatenate([[False], h[1:] == h[:-1]])
            shared = after | np.append(after[1:], False)
            bucket = ((h >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            one = np.flatnonzero(~after)
            one = np.repeat(one, 1 + np.diff(np.append(one, len(h))) // PER_ROW)
            return packed("bucket", np.concatenate([bucket[one], -1 - doc[shared] % parts]), [np.concatenate([h[one], h[shared]]), np.concatenate([doc[one], doc[shared]])], ANCHOR)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                if doc is None or len(data) < WINDOW:
                    continue
                h = anchors(data)[0] & LOW
                held.append((h, np.full(len(h), doc)))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def shared(parts: int, hot: int):
    """Anchors of several documents, by the documents' part; those of ``hot`` rows or more, with their rows, as part -1."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h, doc = unpacked(table, ANCHOR)
        if key[0].as_py() < 0:
            return pa.Table.from_batches([packed("part", np.full(len(h), -1 - key[0].as_py()), [h, doc], ANCHOR)])
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        after = np.concatenate([[False], h[1:] == h[:-1]])
        twin = after | np.append(after[1:], False)
        first = np.flatnonzero(~after)
        rows = np.diff(np.append(first, len(h)))
        many, rows = h[first[rows >= hot]], rows[rows >= hot]
        h, doc = h[twin], doc[twin]
        return pa.Table.from_batches([packed("part", np.concatenate([doc % parts, np.full(len(many), -1)]), [np.concatenate([h, many]), np.concatenate([doc, rows])], ANCHOR)])

    return run


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot anchors with their rows, one by one."""
    for batch in batches:
        h, rows = unpacked(pa.Table.from_batches([batch]), ANCHOR)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(rows, pa.int64())], ["h", "rows"])


def spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by their start."""
    if not len(first):
        return first, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of h are in a list in order."""
    at = np.searchsorted(ordered, h)
    return ordered[np.minimum(at, len(ordered) - 1)] == h if len(ordered) else np.zeros(len(h), bool)


def slices(doc: np.ndarray) -> dict[int, tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, int)
    return dict(zip(doc[at].tolist(), zip(at.tolist(), np.append(at[1:], len(doc)).tolist())))


def fetched(id: str, text: str, tasks: int, hot: Broadcast):
    """Runs of shared anchors with their bytes, by the anchor's task; spans already known under negative task numbers.

    Windows of hot anchors stand for themselves, by their bytes' task.

    Of the documents here that hold a content the least one's runs are dealt on; the others repeat the whole of it.
    """

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        noted_h, noted_doc = unpacked(notes, ANCHOR)
        order = np.argsort(noted_doc, kind="stable")
        noted_h, noted_doc = noted_h[order], noted_doc[order]
        at = slices(noted_doc)
        done: set[int] = set()
        held: dict[tuple[int, bytes], list[int]] = {}  # the least document, the anchor's place, then where its runs of this content begin
        known: tuple[list[int], list[int], list[int]] = ([], [], [])

        def repeated(doc: int, firsts: list[int], n: int) -> None:
            for first in firsts:
                for values, value in zip(known, (doc, first, first + n)):
                    values.append(value)

        for own, value in zip(docs[id].to_pylist(), docs[text].to_pylist()):
            if own not in at or own in done:
                continue
            done.add(own)
            data = (value or "").encode("utf-8", "surrogatepass")
            h, first, last, where = anchors(data)
            h = h & LOW
            near = np.isin(h, noted_h[slice(*at[own])])
            many = near & among(h, hot.value)
            near &= ~many
            found = list(zip(h[near].tolist(), first[near].tolist(), (last[near] + WINDOW).tolist(), (where - first)[near].tolist()))
            found += [(zlib.crc32(data[k : k + WINDOW]) << 16, k, k + WINDOW, ALONE) for i, j in zip(first[many].tolist(), last[many].tolist()) for k in range(i, j + 1)]
            for x, a, b, at_ in found:
                content = (x, data[a:b])
                before = held.setdefault(content, [own, at_])
                if own < before[0]:
                    repeated(before[0], before[2:], b - a)
                    held[content] = [own, at_, a]
                elif own > before[0]:
                    repeated(own, [a], b - a)
                else:
                    before.append(a)
        out = []
        if known[0]:
            doc, a, b = (np.array(x, np.int64) for x in known)
            order = np.lexsort((a, doc))
            doc, a, b = doc[order], a[order], b[order]
            rows = [(np.full(j - i, d), *spans(a[i:j], b[i:j])) for d, (i, j) in slices(doc).items()]
            doc, (a, b) = np.concatenate([np.full(len(x), d[0]) for d, x, _ in rows]), (np.concatenate([r[k] for r in rows]) for k in (1, 2))
            batch = packed("task", np.full(len(doc), -1 - key[0].as_py()), [doc, a, b], SPAN)
            out.append(padded(batch, {f"s_{n}": batch[n] for n, _ in SPAN}))
        if held:
            contents = list(held)
            order = np.argsort((np.array([x for x, _ in contents], np.uint64) >> np.uint64(20)) % np.uint64(tasks), kind="stable")
            task, rows, pieces = [], ([], [], [], []), []
            for k in order.tolist():
                (x, content), (own, at_, *firsts) = contents[k], held[contents[k]]
                for i, first in enumerate(firsts):  # a run of no bytes has those of the last one before it that has some
                    for values, value in zip(rows, (own, first, 0 if i else len(content), at_)):
                        values.append(value)
                task += [(x >> 20) % tasks] * len(firsts)
                pieces.append((task[-1], content))
            batch = packed("task", np.array(task), [np.array(x) for x in rows], RUN)
            dealt = np.array([t for t, _ in pieces])
            cut = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
            out.append(padded(batch, {k: batch[k] for k, _ in RUN} | {"bytes": pa.array([b"".join(c for _, c in pieces[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())}))
        return pa.Table.from_batches(out) if out else pa.table({k: pa.array([], t) for k, t in FETCHED}, schema=pa.schema(FETCHED))

    return run


FETCHED = [("task", pa.int32()), *[(k, pa.binary()) for k, _ in RUN], ("bytes", pa.binary()), *[(f"s_{k}", pa.binary()) for k, _ in SPAN]]


def padded(batch: pa.RecordBatch, have: dict[str, pa.Array]) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([batch["task"], *[have.get(k, none) for k, _ in FETCHED[1:]]], schema=pa.schema(FETCHED))


def repeated_spans(contents: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content number, start and end of all that stands in a content of smaller least document as well, by merged transforms."""
    n = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    cuts = off[1:-1][np.diff((off[1:] - 1) // SHARD_BYTES).astype(bool)] if len(n) > 1 else np.empty(0, np.int64)
    at, interval = intervals(data, cuts, WINDOW)
    content = np.repeat(np.arange(len(n)), n)
    valid = (np.arange(len(data)) - off[:-1][content]) <= n[content] - WINDOW
    keep = valid[at]
    at, interval = at[keep], interval[keep]
    new = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    own = least[content[at]]
    at = np.sort(at[own > np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(at))))])
    c = content[at]
    begin = at - off[:-1][c]
    cut = np.concatenate([[True], (c[1:] != c[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.empty(0, bool)
    ends = np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1) if len(at) else np.empty(0, int)
    return c[cut], begin[cut], begin[ends] + WINDOW


def may_share(contents: list[bytes], anchor: np.ndarray) -> np.ndarray:
    """Contents that agree with another one for a window's length around their anchors, each side's most taken together."""

    def most(own: list[bytes]) -> np.ndarray:
        rows = np.array(own, f"S{WINDOW}")
        order = np.argsort(rows)
        letters = rows[order].view(np.uint8).reshape(len(rows), WINDOW)
        differ = letters[1:] != letters[:-1]
        common = np.where(differ.any(1), differ.argmax(1), WINDOW)
        out = np.empty(len(rows), np.int64)
        out[order] = np.maximum(np.append(common, 0), np.concatenate([[0], common]))
        return out

    side = [k for k, a in enumerate(anchor.tolist()) if a != ALONE]
    after = most([contents[k][anchor[k] : anchor[k] + WINDOW] for k in side])
    before = most([contents[k][max(0, anchor[k] + GRAM - WINDOW) : anchor[k] + GRAM][::-1] for k in side])
    return np.array(side, np.int64)[after + before - GRAM >= WINDOW] if side else np.empty(0, np.int64)


def looked_at(parts: int):
    """Spans of repeated windows among the fetched runs, by their documents' part; spans already known pass through.

    Of the documents that hold a content all but the least repeat the whole of it.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            doc, a, b = unpacked(table, [(f"s_{k}", v) for k, v in SPAN])
            return pa.Table.from_batches([packed("part", doc % parts, [doc, a, b], SPAN)])
        doc, first, n, anchor = unpacked(table, RUN)
        data = b"".join(x for x in table["bytes"].to_pylist() if x)
        has = np.flatnonzero(n > 0)
        ends = np.cumsum(n[has], dtype=np.int64)
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(data[i:j], len(number)) for i, j in zip((ends - n[has]).tolist(), ends.tolist())])
        of = own[np.cumsum(n > 0) - 1]  # of every run the number of its content
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, of, doc)
        contents = list(number)
        length = np.array([len(c) for c in contents], np.int64)
        again = doc > least[of]
        at = np.zeros(len(contents), np.int64)
        at[of] = anchor
        some = may_share(contents, at)
        c, begin, end = repeated_spans([contents[k] for k in some.tolist()], least[some]) if len(some) else (np.empty(0, np.int64),) * 3
        c = some[c]
        times = np.bincount(c, minlength=len(contents))
        rest = np.flatnonzero(~again)
        copies = times[of[rest]]
        run_of = np.repeat(rest, copies)
        span = np.arange(len(run_of)) - np.repeat(np.cumsum(copies) - copies, copies) + (np.cumsum(times) - times)[of[run_of]]
        owner = np.concatenate([doc[again], doc[run_of]])
        start = np.concatenate([first[again], first[run_of] + begin[span]])
        stop = np.concatenate([first[again] + length[of[again]], first[run_of] + end[span]])
        return pa.Table.from_batches([packed("part", owner % parts, [owner, start, stop], SPAN)])

    return run


def cut_out(id: str, text: str, names: list[str], out: pa.Schema):
    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        doc, a, b = unpacked(found, SPAN)
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        at, n_bytes, own_spans, kept = slices(doc), [], [], []
        for own, value in zip(docs[id].to_pylist(), docs[text].to_pylist()):
            data = (value or "").encode("utf-8", "surrogatepass")
            i, j = at.get(own, (0, 0))
            first, end = spans(a[i:j], b[i:j])
            n_bytes.append(len(data))
            own_spans.append([{"start": x, "end": y} for x, y in zip(first.tolist(), end.tolist())])
            edge = [0, *np.column_stack([first, end]).ravel().tolist(), len(data)]
            kept.append(b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2])))
        table = docs.select(names)
        for name, values in (("n_bytes", n_bytes), ("spans", own_spans), ("kept", kept)):
            table = table.append_column(name, pa.array(values, out.field(name).type))
        return table.cast(out)

    return run


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """df with n_bytes, spans (array of start and end, in bytes) and kept (the bytes left); columns of those names are replaced.

    A text's UTF-8 bytes go where a string of ``WINDOW`` bytes covers them that also starts in a row of smaller id, as
    the input has it; matches never cross texts. Null texts are empty, and shorter ones lose nothing, nor do rows with a
    null id, which no other row is compared with. An id names one text; repeated rows lose the same bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    small_batches(spark)
    df = df.drop("n_bytes", "spans", "kept")
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets, parts = max(32, total // BUCKET_BYTES), max(31, total // PART_BYTES) | 1
    own = df.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias(text), *[c for c in df.columns if c not in (id, text)])
    names = own.columns
    records = own.select(id, text).mapInArrow(recorded(buckets, parts), schema("bucket", ANCHOR))
    notes = Staged(records.groupBy("bucket").applyInArrow(shared(parts, hot), schema("part", ANCHOR)), "notes").df
    many = notes.where("part = -1").mapInArrow(listed, "h long, rows long").orderBy(F.desc("rows"), "h").limit(MOST_HOT).select("h")
    told = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in many.collect()], np.int64).astype(np.uint64)))
    notes = notes.where("part >= 0")
    part = f"part_{uuid.uuid4().hex}"
    dealt = own.withColumn(part, F.coalesce(F.pmod(F.col(id), F.lit(parts)), F.pmod(F.xxhash64(text), F.lit(parts))).cast("int"))
    fetched_ddl = ", ".join(f"{k} {'int' if t == pa.int32() else 'binary'}" for k, t in FETCHED)
    found = dealt.groupBy(part).cogroup(notes.groupBy("part")).applyInArrow(fetched(id, text, buckets, told), fetched_ddl)
    gone = found.groupBy("task").applyInArrow(looked_at(parts), schema("part", SPAN))  # in one plan with what follows, texts are dealt once
    out = T.StructType([*own.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType.fromJson({"type": "struct", "fields": [{"name": k, "type": "long", "nullable": True, "metadata": {}} for k in ("start", "end")]}))), T.StructField("kept", T.BinaryType())])
    return dealt.groupBy(part).cogroup(gone.groupBy("part")).applyInArrow(cut_out(id, text, names, to_arrow_schema(out)), out)
