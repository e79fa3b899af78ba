"""Line protocol: quote-aware records, a strict csv reader for their cells, typed values.

A line is `measurement[,tag=value...] field=value[,field=value...] [timestamp]`; a backslash escapes
the next character, and blanks and commas inside quoted field values do not separate.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Nanoseconds in one unit of each precision spelling.
PRECISION_NS = {"n": 1, "ns": 1, "u": 10**3, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
BOOLEANS = {"t": True, "T": True, "true": True, "True": True, "TRUE": True, "f": False, "F": False, "false": False, "False": False, "FALSE": False}

_HEAD = re.compile(r"(?:[^\\ ]|\\.|\\\Z)*", re.S)
_COMMA = re.compile(r"((?:[^\\,]|\\.|\\\Z)*)(,|\Z)", re.S)
_NAME = re.compile(r"((?:[^\\=]|\\.)*)=", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def _plain(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


#: One cell of the field part: a quoted value with whatever follows it up to a separator, or plain text.
_CELL = re.compile(r'([^\\=, "]*(?:\\.[^\\=, "]*)*)(=?)(?:("(?:[^\\"]|\\.)*(?:"|\\?\Z))((?:[^\\, ]|\\.|\\\Z)*)|((?:[^\\, ]|\\.|\\\Z)*))([, ]|\Z)', re.S)
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_SIGNED = re.compile(r"[+-]?[0-9]+i")
_UNSIGNED = re.compile(r"\+?[0-9]+u")
_STAMP = re.compile(r"[+-]?[0-9]+")


class ColumnCountError(ValueError):
    """The record has not the parts, names or values it should have."""


@dataclass
class Point:
    measurement: str
    tags: dict[str, str] = field(default_factory=dict)
    fields: dict[str, object] = field(default_factory=dict)
    timestamp: int | None = None


class UInt(int):
    """An unsigned 64-bit value."""


def _cells(rest: str) -> tuple[list[tuple[str, str, str]], str]:
    """Cut the text behind the measurement into cells (name, value, separator behind it).

    The cells' values then go through the strict csv reader, which raises csv.Error where a quote
    doesn't close right before a separator or the end. A quote inside a plain cell is raised here.
    """
    cells, at, n = [], 0, len(rest)
    while True:
        m = _CELL.match(rest, at)
        if m is None:  # a lone backslash at the end of a name
            name, eq, quoted, behind, plain, sep = rest[at:], "", None, None, "", ""
            end = n
        else:
            name, eq, quoted, behind, plain, sep = m.groups()
            end = m.end()
        if quoted is not None:
            if not eq:
                raise csv.Error("a quote opens elsewhere than right after =")
            if behind[:1] == '"':  # the reader would take it for a doubled quote
                raise csv.Error("a quote opens right behind another")
            cells.append((name, quoted + behind, sep))
        else:
            if '"' in plain and _bare_quote(plain):
                raise csv.Error("a quote inside a plain value")
            cells.append((name, plain, sep) if eq else (name + plain, None, sep))
        if end >= n and not sep:
            return cells, ""
        at = end


def _bare_quote(text: str) -> bool:
    return '"' in re.sub(r"\\.", "", text, flags=re.S)


def _strict(values: list[str]) -> list[str]:
    """The values as the strict csv reader gives them: quotes taken off, escapes resolved."""
    text = "".join(values)
    mark = "\x1f" if "\x1f" not in text else next(c for c in map(chr, range(0xE000, 0x20000)) if c not in text)
    # a lone backslash at the end of a value stays one; the reader would take the mark for escaped
    if "\\" in text:
        values = [v + "\\" if (len(v) - len(v.rstrip("\\"))) % 2 else v for v in values]
    row = mark.join(values)
    if not row:
        return [""]
    # the reader takes newlines for ends of rows, also within one
    stand_ins = {}
    for ch in "\r\n":
        if ch in row:
            stand_ins[ch] = next(c for c in map(chr, range(0xE000, 0x20000)) if c not in row)
            row = row.replace(ch, stand_ins[ch])
    cells = next(csv.reader([row], delimiter=mark, quotechar='"', escapechar="\\", doublequote=True, strict=True))
    for ch, instead in stand_ins.items():
        cells = [c.replace(instead, ch) for c in cells]
    return cells


def typed(text: str):
    """A plain field value as boolean, int (`i`), UInt (`u`) or float; ValueError otherwise."""
    if text in BOOLEANS:
        return BOOLEANS[text]
    if _DECIMAL.fullmatch(text):
        return float(text)
    if _SIGNED.fullmatch(text) and -(2**63) <= (n := int(text[:-1])) < 2**63:
        return n
    if _UNSIGNED.fullmatch(text) and (n := int(text[:-1])) < 2**64:
        return UInt(n)
    raise ValueError(f"no field value: {text[:40]}")


def parse(line: str) -> Point | None:
    """One line; None for blank lines and comments.

    Raises csv.Error for broken quoting, else ColumnCountError, else ValueError for a bad value.
    A name given twice keeps its last value.
    """
    line = line.rstrip(" \r\n")
    if not line.strip() or line.startswith("#"):
        return None
    head = _HEAD.match(line).group()
    rest = line[len(head) + 1 :] if len(head) < len(line) else None
    cells = _cells(rest)[0] if rest is not None else []
    values = [v for _, v, _ in cells if v is not None]
    texts = iter(_strict(values) if values else [])
    if rest is None:
        raise ColumnCountError("one part")
    parts, current = [], []
    for name, value, sep in cells:
        current.append((name, value, None if value is None else next(texts)))
        if sep != ",":
            parts.append(current)
            current = []
    if current or len(parts) > 2:
        raise ColumnCountError("a value is missing at the end, or parts are too many")
    point = Point("")
    pieces = [m.group(1) for m in _COMMA.finditer(head)][: head.count(",") + 1]
    point.measurement = _plain(pieces[0])
    if not point.measurement:
        raise ColumnCountError("no measurement")
    used = len(pieces[0])
    for piece in pieces[1:]:
        if used >= len(head):
            break
        used += 1 + len(piece)
        m = _NAME.match(piece)
        if not m or not m.group(1) or m.end() == len(piece):
            raise ColumnCountError("a tag lacks its name, = or value")
        point.tags[_plain(m.group(1))] = _plain(piece[m.end() :])
    for name, value, _ in parts[0]:
        if not name or not value:
            raise ColumnCountError("a field lacks its name, = or value")
    stamp = None
    if len(parts) == 2:
        if len(parts[1]) != 1:
            raise ValueError("no timestamp")
        name, value, _ = parts[1][0]
        stamp = name if value is None else f"{name}={value}"
        if not stamp:
            raise ColumnCountError("an empty part")
    for name, value, text in parts[0]:
        point.fields[_plain(name)] = text if value[0] == '"' else typed(value)
    if stamp is not None:
        if not _STAMP.fullmatch(stamp) or not -(2**63) <= int(stamp) < 2**63:
            raise ValueError("no timestamp")
        point.timestamp = int(stamp)
    return point


def _open_quote(line: str) -> bool:
    """Whether a quoted field value begins in the line and does not end in it."""
    if '"' not in line or line.startswith("#"):
        return False
    at = len(_HEAD.match(line).group()) + 1
    while at < len(line):
        m = _CELL.match(line, at)
        if m is None:
            return False
        quoted = m.group(3)
        if quoted is not None and m.group(2) and (len(quoted) == 1 or quoted[-1] != '"' or re.fullmatch(r'"(?:[^\\"]|\\.)*', quoted, re.S)):
            return True
        if m.end() >= len(line) and not m.group(6):
            return False
        at = m.end()
    return False


def records(lines: Iterable[str]) -> Iterator[tuple[int, str]]:
    """(number of its first line, record) from lines without their ends; a newline within a quoted field
    value belongs to the record.

    A quote that is never closed, or not as it should be, fails its own line alone: the lines behind it
    are records again. Each line is looked at twice at most for every quote.
    """
    waiting: list[str] = []
    first = 0
    source = iter(lines)
    ahead: list[str] = []  # lines to be looked at again
    at = 0

    def following() -> str | None:
        nonlocal at
        at += 1
        return ahead.pop() if ahead else next(source, None)

    while (line := following()) is not None:
        first = at - 1
        if not _open_quote(line):
            yield first, line
            continue
        waiting = [line]
        whole = None
        while (more := following()) is not None:
            waiting.append(more)
            if re.search(r'(?<!\\)(?:\\\\)*"', more):  # the quote ends here, rightly or not
                joined = "\n".join(waiting)
                if not _open_quote(joined):
                    try:
                        parse(joined)
                        whole = joined
                    except csv.Error:
                        pass
                    except ValueError:
                        whole = joined
                    break
        if whole is not None:
            yield first, whole
        else:
            yield first, line
            ahead.extend(reversed(waiting[1:]))
            at -= len(waiting) - 1 + (more is None)


def check(line: str) -> tuple[Point | None, str | None]:
    """(point, None), (None, reason) or (None, None) for a line that neither loads nor fails."""
    try:
        return parse(line), None
    except csv.Error:
        return None, "quoting"
    except ColumnCountError:
        return None, "column_count"
    except ValueError:
        return None, "value"


def failed_batches(batches: Iterator) -> Iterator:
    """mapInArrow body: line_id, line to line_id, reason of the lines that fail."""
    import pyarrow as pa

    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        ids, reasons = [], []
        for i, line in zip(batch.column("line_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if line is not None and (reason := check(line)[1]):
                ids.append(i)
                reasons.append(reason)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reasons, pa.string())], ["line_id", "reason"])


#: Columns `parse_batches` adds. Fields are split by type, as a Parquet column has one.
PARSED = (
    "reason string, database string, table string, tags map<string,string>, floats map<string,double>, "
    "ints map<string,bigint>, uints map<string,decimal(20,0)>, strings map<string,string>, booleans map<string,boolean>, time bigint"
)


def parse_batches(batches: Iterator) -> Iterator:
    """mapInArrow body: line_id, db_name, precision, received_ns, line to line_id + PARSED.

    Blank lines, comments and null lines give no row. The time is scaled to nanoseconds by the
    precision (null or unknown: ns), the receive time where the line has none, null beyond 64 bits.
    A database named before the measurement's first dot counts where db_name is null or empty.
    """
    import pyarrow as pa
    from decimal import Decimal

    csv.field_size_limit(sys.maxsize)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    maps = [pa.map_(pa.string(), k) for k in (pa.string(), pa.float64(), pa.int64(), pa.decimal128(20, 0), pa.string(), pa.bool_())]
    names = ["line_id", "reason", "database", "table", "tags", "floats", "ints", "uints", "strings", "booleans", "time"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for i, db, precision, received, line in zip(*(batch.column(c).to_pylist() for c in ("line_id", "db_name", "precision", "received_ns", "line")), strict=True):
            if line is None:
                continue
            point, reason = check(line)
            if point is None:
                if reason:
                    for column, v in zip(out, [i, reason, db or None, *[None] * 8], strict=True):
                        column.append(v)
                continue
            table = point.measurement
            if not db and "." in table:
                db, table = table.split(".", 1)
            split: dict[type, list] = {float: [], int: [], UInt: [], str: [], bool: []}
            for k, v in point.fields.items():
                split[type(v)].append((k, Decimal(v) if type(v) is UInt else v))
            time = received if point.timestamp is None else point.timestamp * PRECISION_NS.get(precision or "ns", 1)
            time = time if time is not None and -(2**63) <= time < 2**63 else None
            for column, v in zip(out, [i, None, db or "default", table, list(point.tags.items()), *split.values(), time], strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [*kinds, *maps, pa.int64()], strict=True)], names)
