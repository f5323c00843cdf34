r"""Records of delimited text whose quoted values hold line breaks, put together from lines that are read in splits.

A line either starts outside of quotes or inside a quoted value, and ends in one of the two. For each split the two ends
(from outside, from inside) are worked out by streaming through its lines; put one after the other, they say where every
split of a file starts. Then each split gives its whole records, and what is left at its edges, the end of a record that
began before and the start of one that goes on after, meets by file, a few pieces a split. So no file is read by one task.

A quote opens a value only at its start, and a doubled quote inside is one quote, as in the reader of Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.staging import staged

SEPARATORS = "\x1e\x1d\x1c\x1f"  # between records, the first that no line holds


def _patterns(sep: str) -> tuple[str, str]:
    """Lines that end inside a quoted value: when they start outside, when they start inside."""
    s = re.escape(sep)
    inside = '(?:[^"]++|"")*+'
    value = f'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+|)'
    return f'^(?:{value}{s})*+"{inside}\\z', f'^{inside}(?:"[^{s}]*+{s}(?:{value}{s})*+"{inside})?\\z'


def ends_inside(line: Column, sep: str) -> Column:
    """Whether a line that starts outside of quotes ends inside."""
    return line.rlike(_patterns(sep)[0])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where it starts in the file) and value of each line; lines of a split stay in order."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict] | None]]:
    """(key, rows) in order, and (key, None) after the last rows of a split."""
    now = None
    for batch in batches:
        part: list[dict] = []
        for r in batch.to_pylist():
            key = (r["file"], r["split"])
            if key != now:
                if part:
                    yield now, part
                    part = []
                if now is not None:
                    yield now, None
                now = key
            part.append(r)
        if part:
            yield now, part
    if now is not None:
        yield now, None


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, out = [False, True], []
    for (file, split), rows in _runs(batches):
        if rows is None:
            out.append({"file": file, "split": split, "outside": state[0], "inside": state[1]})
            state = [False, True]
        for r in rows or ():
            state = [r["inside"] if s else r["outside"] for s in state]
    if out:
        yield pa.RecordBatch.from_pylist(out)


def _starts(of_file: pa.Table) -> pa.Table:
    """Whether each split of a file starts inside a quoted value."""
    rows, inside, out = sorted(of_file.to_pylist(), key=lambda r: r["split"]), False, []
    for r in rows:
        out.append({"file": r["file"], "split": r["split"], "starts": inside})
        inside = r["inside"] if inside else r["outside"]
    return pa.Table.from_pylist(out)


PIECE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the edges of each split: `head` ends a record, `tail` starts one, `middle` does neither."""
    held: list[str] = []
    out: list[tuple[str, str]] = []
    inside, begun, header = None, False, False  # a value is open; the record that is held began in this split; it is the first of a file
    for (file, split), rows in _runs(batches):
        for r in rows or ():
            if inside is None:
                inside, begun, header = r["starts"], not r["starts"], split == 0
            held.append(r["value"])
            inside = r["inside"] if inside else r["outside"]
            if not inside:
                value = "\n".join(held).removesuffix("\r")
                if not header:
                    out.append(("whole" if begun else "head", value))
                header = header and not value
                held, begun = [], True
        if rows is None:
            if held:
                out.append(("tail" if begun else "middle", "\n".join(held)))
            held, inside = [], None
        if out:
            yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "kind": k, "value": v} for k, v in out], PIECE)
            out = []


def _joined(of_file: pa.Table) -> pa.Table:
    """Records that cross the borders of splits."""
    held, out = [], []
    order = {"head": 0, "middle": 1, "tail": 2}
    for r in sorted(of_file.to_pylist(), key=lambda r: (r["split"], order[r["kind"]])):
        held.append(r["value"])
        if r["kind"] == "head":
            out.append("\n".join(held).removesuffix("\r"))
            held = []
    return pa.table({"value": pa.array(out + (["\n".join(held)] if held else []), pa.string())})


def records(text: DataFrame, sep: str) -> DataFrame:
    """value: one whole record, line breaks included, from the frame of `lines`, without the header of each file."""
    outside, inside = _patterns(sep)
    marked = text.withColumns({"outside": F.col("value").rlike(outside), "inside": F.col("value").rlike(inside)})
    ends = marked.drop("value").mapInArrow(_ends, "file string, split long, outside boolean, inside boolean")
    starts = staged(ends.groupBy("file").applyInArrow(_starts, "file string, split long, starts boolean"))
    pieces = staged(marked.join(F.broadcast(starts), ["file", "split"])  # a row for each split of the input
                    .mapInArrow(_pieces, "file string, split long, kind string, value string"))
    crossing = pieces.filter("kind <> 'whole'").groupBy("file").applyInArrow(_joined, "value string")
    return pieces.filter("kind = 'whole'").select("value").unionByName(crossing)


def fields(line: Column, sep: str) -> Column:
    """The number of values of a whole record."""
    plain = F.regexp_replace(line, f'(?<=^|{re.escape(sep)})"(?:[^"]++|"")*+"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
