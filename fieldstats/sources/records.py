"""CSV records that may hold line breaks, from files cut anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.session import ensure_checkpoint_dir

#: From inside a quoted cell to behind its closing quote; doubled quotes are part of the cell.
_CLOSE = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Does a quoted cell stay open at the end of the line, if one is or is not open at its start? A quote opens a cell only as its first
    character; what follows a closing quote belongs to the cell up to the separator."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSE.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(separator, at) + 1
        if not at:
            return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of a batch by the part of the file they come from."""
    block = batch["block"].to_numpy(zero_copy_only=False)
    file = batch["file"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (file[1:] != file[:-1])]) if len(block) else []
    for a, b in zip(start, [*start[1:], len(block)], strict=False):
        yield (batch["file"][int(a)].as_py(), int(block[a])), batch["value"].slice(int(a), int(b - a))


def _quotes(lines: pa.Array, separator: str) -> tuple[np.ndarray, np.ndarray]:
    """How many quotes each line has, and whether their number alone tells what becomes of the state at its start, for either state (two rows).

    It does if every quote that opens a cell, the first, third, … seen from outside, stands at the start of the line, behind a separator
    or behind the quote that closed (a doubled quote)."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    at = np.flatnonzero(data[offsets[0] :] == ord('"')) + offsets[0]
    line = np.searchsorted(offsets, at, side="right") - 1
    count = np.bincount(line, minlength=len(lines))
    rank = np.arange(len(at)) - (np.cumsum(count) - count)[line]
    before = data[at - 1]
    odd = (at != offsets[line]) & (before != ord(separator)) & (before != ord('"'))
    plain = np.ones((2, len(lines)), bool)
    for state in (0, 1):
        plain[state, line[odd & ((rank + state) % 2 == 0)]] = False
    return count, plain


def _inside(lines: pa.Array, state: bool, separator: str) -> tuple[np.ndarray, bool]:
    """For each line whether it begins inside a quoted cell, and whether the last one ends there. Lines are read one by one only where a
    quote stands in the middle of a cell without quotes."""
    if pa.types.is_large_string(lines.type):
        lines = lines.cast(pa.string())
    count, plain = _quotes(lines, separator)
    before = np.empty(len(lines), bool)
    done = 0
    while done < len(lines):
        states = np.cumsum(count[done:]) % 2 == 1
        states = np.r_[False, states[:-1]] ^ state
        stray = np.flatnonzero(~np.where(states, plain[1, done:], plain[0, done:]))
        upto = done + int(stray[0]) if len(stray) else len(lines)
        before[done:upto] = states[: upto - done]
        if len(stray):
            before[upto] = states[upto - done]
            state = ends_inside(lines[upto].as_py() or "", bool(before[upto]), separator)
            done = upto + 1
        else:
            return before, bool(before[-1] ^ (count[-1] % 2 == 1)) if len(lines) else state
    return before, state


def _scout(separator: str):
    """mapInArrow: for each part of a file, what becomes of either state at its start, and whether a record begins in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[list[bool]]] = {}
        for batch in batches:
            for part, lines in _runs(batch):
                for fact in found.setdefault(part, [[False, False], [True, False]]):
                    before, fact[0] = _inside(lines, fact[0], separator)
                    fact[1] = fact[1] or bool((~before).any())
        rows = [(*part, *out, *into) for part, (out, into) in found.items()]
        names = ["file", "block", "out_end", "out_begins", "in_end", "in_begins"]
        kinds = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def _cut(opened: dict[tuple[str, int], int], separator: str, whole: bool):
    """mapInArrow: the records of each part. ``opened`` has the parts that begin inside a record, with the part in which it began. ``whole`` asks for
    records that lie in one part, else for the pieces of those that do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[str, int] | None = None
        state, begun, header, held = False, True, False, []

        def out(texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([texts], ["record"])

        def piece(origin: int) -> pa.RecordBatch:
            cells = [pa.array([here[0]]), pa.array([origin]), pa.array([here[1]]), pa.array(["\n".join(held)], pa.string()), pa.array([begun and header])]
            return pa.RecordBatch.from_arrays(cells, ["file", "origin", "block", "record", "header"])

        def closed() -> Iterator[pa.RecordBatch]:
            """The part is over: what is held belongs to a record that goes on, or is the end of one that began before."""
            if here is not None and held and not whole:
                yield piece(here[1] if begun else opened[here])

        for batch in batches:
            for part, lines in _runs(batch):
                if part != here:
                    yield from closed()
                    here, held = part, []
                    state, begun, header = part in opened, part not in opened, part[1] == 0
                before, end = _inside(lines, state, separator)
                starts = np.flatnonzero(~before)
                if held or (state and not begun):  # goes on with a record from before this batch
                    last = int(starts[0]) if len(starts) else len(lines)
                    held += lines.slice(0, last).to_pylist()
                    if len(starts) or not end:
                        if not begun:
                            if not whole:
                                yield piece(opened[here])
                        elif header:
                            header = False
                        elif whole:
                            yield out(pa.array(["\n".join(held)], pa.string()))
                        held, begun = [], True
                stop = len(lines)
                if end and len(starts):
                    stop = int(starts[-1])
                    held = lines.slice(stop).to_pylist()
                    starts = starts[:-1]
                state = end
                if not len(starts) or (not whole and not header):
                    continue
                cuts = pa.array(np.r_[starts, stop].astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(cuts, lines), "\n")
                texts = texts.filter(pc.not_equal(texts, ""))
                if header and len(texts):
                    header, texts = False, texts.slice(1)
                if whole and len(texts):
                    yield out(texts)
        yield from closed()

    return run


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The records of CSV files in a column ``record``, header records and empty lines left out; line breaks in quoted cells become ``\\n``.
    A quoted cell that is never closed is the rest of its file, without the last line break.

    Files are cut by size into parts, read as lines, as Spark cuts plain text. A first pass tells for each part whether it leaves a quoted
    cell open, for either state at its start; a run over these facts, two bits a part, gives the state at every start. Then each part
    yields its records by itself. Records that cross parts are few: their pieces are put together by one group-by, kept in the
    checkpoint folder and come last. Quotes are counted over whole batches of lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    slim = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    shape = "file string, block bigint, out_end boolean, out_begins boolean, in_end boolean, in_begins boolean"
    opened: dict[tuple[str, int], int] = {}
    file, inside, origin = None, False, 0
    for r in sorted(slim.mapInArrow(_scout(separator), shape).collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside = r["file"], False
        if inside:
            opened[file, r["block"]] = origin
        begins = r["in_begins"] if inside else r["out_begins"]
        inside = r["in_end"] if inside else r["out_end"]
        if inside and begins:
            origin = r["block"]
    records = lines.mapInArrow(_cut(opened, separator, True), "record string")
    if not opened:
        return records
    ensure_checkpoint_dir(spark)
    pieces = lines.mapInArrow(_cut(opened, separator, False), "file string, origin bigint, block bigint, record string, header boolean")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n")
    whole = pieces.groupBy("file", "origin").agg(joined.alias("record"), F.bool_or("header").alias("header")).where("not header")
    return records.unionAll(whole.select("record").checkpoint())
