"""Loading delimited records in bulk and setting aside those that fail, with the reason."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

#: Fixed values of the record format: field names in order, and the accepted form of each value.
FIELDS = ["posi", "allele1", "freq", "strand", "allele2", "note"]
POSI, ALLELE, FREQ, STRAND = r"[0-9]+", r"[ACGTacgt]", r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", r"[+-]"
BLANKS = " \t"

_POSI, _ALLELE, _FREQ, _STRAND = (re.compile(x) for x in (POSI, ALLELE, FREQ, STRAND))
_PARSE = pacsv.ParseOptions(quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False)
_CONVERT = pacsv.ConvertOptions(column_types=dict.fromkeys(FIELDS, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False, check_utf8=False)
#: Blocks no longer than this are not halved again: a vectorised test of their shape picks the records that the reader can take.
LEAF = 1024


def split_record(line: str) -> list[str] | None:
    """The fields of one record, quotes resolved and blanks around unquoted values removed; None for broken quoting."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, value = i + 1, []
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                value.append(line[i:j])
                if line[j + 1 : j + 2] == '"':
                    value.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != ",":
                return None
            fields.append("".join(value))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            value = line[i:j]
            if '"' in value:
                return None
            fields.append(value.strip(BLANKS))
            i = j
        if i >= n:
            return fields
        i += 1


def diagnose(line: str | None) -> tuple[str | None, list | None]:
    """The first reason why a record fails, or None and its typed values.  A null record has no fields: ``column_count``."""
    if line is None:
        return "column_count", None
    fields = split_record(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", None
    if len(fields) != len(FIELDS):
        return "column_count", None
    posi, a1, freq, strand, a2, note = fields
    if not _POSI.fullmatch(posi) or not posi.strip("0"):
        return "posi", None
    if not _ALLELE.fullmatch(a1):
        return "allele1", None
    if not _FREQ.fullmatch(freq) or not 0 <= float(freq) <= 1:
        return "freq", None
    if not _STRAND.fullmatch(strand):
        return "strand", None
    if not _ALLELE.fullmatch(a2):
        return "allele2", None
    # beyond 18 digits the position has no 64-bit value; the record is valid all the same
    return None, [int(posi) if len(posi.lstrip("0")) <= 18 else None, a1.upper(), float(freq), strand, a2.upper(), note]


_FIELD = '(?:"(?:[^"]|"")*"|[^",][^",]*|)'
_SHAPE = f"^(?:{_FIELD},){{{len(FIELDS) - 1}}}{_FIELD}$"
#: Blanks inside quotes do belong to the data, and columns no longer show which values were quoted.
_INNER_BLANKS = f'(?:^|,)"[{BLANKS}]|[{BLANKS}]"(?:,|$)'
_TYPES = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]


def _read(lines: pa.Array) -> pa.Table | None:
    """The block's columns as strings, or None if the columnar reader refuses it."""
    try:
        data = "\n".join(lines.to_pylist()).encode("utf-8", "surrogatepass")
        t = pacsv.read_csv(io.BytesIO(data), pacsv.ReadOptions(column_names=FIELDS, use_threads=False, block_size=len(data) + 64), _PARSE, _CONVERT)
    except (pa.ArrowInvalid, UnicodeError):
        return None
    return t if t.num_rows == len(lines) else None


def _bisect(lines: pa.Array, at: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Columns of the records that the reader takes, with their positions: a block that it refuses is halved, one of at most LEAF
    records is read without those of a broken shape."""
    if not len(at):
        return
    if (t := _read(lines)) is not None:
        yield t, at
    elif len(at) > LEAF:
        half = len(at) // 2
        yield from _bisect(lines[:half], at[:half])
        yield from _bisect(lines[half:], at[half:])
    else:
        sound = np.asarray(pc.match_substring_regex(lines, _SHAPE))
        if not sound.all():
            yield from _bisect(lines.filter(pa.array(sound)), at[sound])


def _floats(text: pa.Array) -> pa.Array:
    try:
        return pc.cast(text, pa.float64())
    except pa.ArrowInvalid:  # beyond the range of a double
        return pa.array([None if x is None else float(x) for x in text.to_pylist()], pa.float64())


def _typed(t: pa.Table) -> tuple[list[pa.Array], np.ndarray]:
    """Typed columns of a block, and which of its records are beyond doubt valid."""
    cols = [pc.utf8_trim(c.combine_chunks(), BLANKS) for c in t.columns]
    good = None
    for k, form in enumerate(("[0-9]{1,18}", ALLELE, FREQ, STRAND, ALLELE)):
        m = pc.match_substring_regex(cols[k], f"^(?:{form})$")
        good = m if good is None else pc.and_(good, m)
    posi, a1, freq, strand, a2, note = cols
    none = pa.scalar(None, pa.string())
    posi, freq = pc.cast(pc.if_else(good, posi, none), pa.int64()), _floats(pc.if_else(good, freq, none))
    good = pc.fill_null(pc.and_(good, pc.and_(pc.greater_equal(posi, 1), pc.less_equal(freq, 1.0))), False)
    return [posi, pc.utf8_upper(a1), freq, strand, pc.utf8_upper(a2), note], np.asarray(good)


def parse_block(lines: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """Typed columns and reasons (null where valid) of a block: read in bulk, halved where the reader refuses it; only the records that the
    columns show to be doubtful are diagnosed one by one."""
    n = len(lines)
    plain = pc.replace_substring_regex(lines, "\r$", "")
    doubt = np.asarray(pc.fill_null(pc.match_substring_regex(plain, "[\n\r]"), True))
    quoted = np.asarray(pc.fill_null(pc.match_substring(plain, '"'), False)) & ~doubt
    if quoted.any():
        # the reader is lenient about text after a closing quote and quotes inside a field
        q = plain.filter(pa.array(quoted))
        doubt[np.flatnonzero(quoted)] = ~np.asarray(pc.match_substring_regex(q, _SHAPE)) | np.asarray(pc.match_substring_regex(q, _INNER_BLANKS))
    parts: list[list[pa.Array]] = []
    places = []
    done = np.zeros(n, bool)
    read = list(_bisect(plain.filter(pa.array(~doubt)), np.flatnonzero(~doubt)))
    if read:
        where = np.concatenate([at for _, at in read])
        cols, good = _typed(pa.concat_tables([t for t, _ in read]))
        done[where[good]] = True
        parts.append([c.filter(pa.array(good)) for c in cols])
        places.append(where[good])
    rest = np.flatnonzero(~done)
    found = [diagnose(x) for x in lines.take(pa.array(rest)).to_pylist()]
    rows = [v or [None] * len(FIELDS) for _, v in found]
    parts.append([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)])
    places.append(rest)
    back = pa.array(np.argsort(np.concatenate(places), kind="stable"))
    reason = pa.concat_arrays([pa.nulls(n - len(rest), pa.string()), pa.array([r for r, _ in found], pa.string())])
    return [pa.concat_arrays(x).take(back) for x in zip(*parts)], reason.take(back)


def parse_records(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",), block: int = 8192) -> DataFrame:
    """Every input row once: ``keep`` columns, the typed fields, and ``reason`` (null where the record is valid).

    Blocks of up to ``block`` records go through a columnar CSV reader.  A block that it refuses is halved until the records of a broken shape
    stand alone; tests over whole columns then tell which values are doubtful, and only such records are diagnosed strictly one by
    one.  Valid rows have typed fields, failing rows nulls and the first reason that holds: quoting, column_count, posi, allele1,
    freq, strand, allele2.  Null and empty records fail with column_count; repeated records all count; records of any length
    are read whole; columns not in ``keep`` are ignored.  There is no shuffle: each input partition is read once.
    """
    kept = df.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["posi bigint, allele1 string, freq double, strand string, allele2 string, note string, reason string"])
    names = [f.name for f in kept] + FIELDS + ["reason"]
    if len(set(names)) != len(names):
        raise ValueError(f"keep must not hold {FIELDS} or reason")
    n_keep = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                cols, reason = parse_block(part.column(n_keep).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n_keep)), *cols, reason], names)

    return df.select(*keep, df[line].alias("__line")).mapInArrow(run, schema)
