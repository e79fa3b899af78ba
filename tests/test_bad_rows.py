import csv
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import bad_rows
from siltstone.sources.lineproto import ColumnCountError, check, parse

GOOD = {
    "m f=1": ("m", {}, {"f": 1.0}, None),
    "m,a=b f=1i 5": ("m", {"a": "b"}, {"f": 1}, 5),
    'm f="a b, c=d",g=t -5 \r': ("m", {}, {"f": "a b, c=d", "g": True}, -5),
    r"m\ x\,y,t=a\=b f\,k=.5": ("m x,y", {"t": "a=b"}, {"f,k": 0.5}, None),
    r'm f="say \"hi\"",g="C:\\tmp" 5': ("m", {}, {"f": 'say "hi"', "g": "C:\\tmp"}, 5),
    'm f="",g=5.,h=-1e+5,i=18446744073709551615u': ("m", {}, {"f": "", "g": 5.0, "h": -1e5, "i": 2**64 - 1}, None),
    "m,a=x=y f=FALSE": ("m", {"a": "x=y"}, {"f": False}, None),
    'm,a="q f=1': ("m", {"a": '"q'}, {"f": 1.0}, None),
}
BAD = {
    "quoting": ['m f="a', 'm f=a"', 'm f="a"x', 'm f="the "o" s"', 'm f="a" "b" 5', 'm f="a\\"', 'm f="a"",g=1', 'm f=b"c"', 'm "f"=1', 'm f=n/a,g="x'],
    "column_count": ["m", "m,a f=1", "m,=x f=1", "m,a= f=1", "m f", "m f=", "m =1", "m f=1,", "m f=1, 5", "m f=1,,g=2", "m f=1 5 6", "m  f=1", "m, f=1", "m,a=b -88", " f=1", "m f= 1", "m f=n/a,g"],
    "value": ["m f=n/a", "m f=1=2", "m f=9223372036854775808i", "m f=-5u", "m f=tRUE", "m f=NaN", "m f=.", "m f=1e", "m f=1 x", "m f=1 99999999999999999999", "m f=1 1.5", "m f=1 a=5", "m f=1_0", "m f=١"],
}


@pytest.mark.parametrize("line", GOOD)
def test_good(line):
    p = parse(line)
    assert (p.measurement, p.tags, p.fields, p.timestamp) == GOOD[line]


@pytest.mark.parametrize(("reason", "line"), [(r, x) for r, lines in BAD.items() for x in lines])
def test_bad(reason, line):
    assert check(line) == (None, reason)


@pytest.mark.parametrize("line", ["", "   ", "\r", "# m f=1", "#"])
def test_neither(line):
    assert check(line) == (None, None)


NAME = st.text(st.characters(exclude_characters="\\\r\n\x00", exclude_categories=["Cs"]), min_size=1, max_size=8)
VALUE = st.one_of(st.booleans(), st.floats(allow_nan=False, allow_infinity=False), st.integers(-(2**63), 2**63 - 1), st.text(st.characters(exclude_characters="\x00", exclude_categories=["Cs"]), max_size=12))


def escaped(text):
    return "".join("\\" + c if c in ',= "' else c for c in text)


def literal(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return f"{v}i" if isinstance(v, int) else repr(v)


@settings(max_examples=300, deadline=None)
@given(NAME, st.dictionaries(NAME, NAME, max_size=3), st.dictionaries(NAME, VALUE, min_size=1, max_size=3), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_what_is_formatted_is_parsed(measurement, tags, fields, stamp):
    if measurement.startswith("#") or not measurement.strip():
        return
    line = escaped(measurement) + "".join(f",{escaped(k)}={escaped(v)}" for k, v in tags.items())
    line += " " + ",".join(f"{escaped(k)}={literal(v)}" for k, v in fields.items()) + ("" if stamp is None else f" {stamp}")
    p = parse(line)
    assert (p.measurement, p.tags, p.fields, p.timestamp) == (measurement, tags, fields, stamp)
    assert {k: type(v) for k, v in p.fields.items()} == {k: type(v) for k, v in fields.items()}


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list('mf=," \\1i5t#x')), max_size=14))
def test_any_text_has_one_outcome(line):
    point, reason = check(line)
    assert point is None or reason is None
    if reason:
        error = {"quoting": csv.Error, "column_count": ColumnCountError, "value": ValueError}[reason]
        with pytest.raises(error):
            parse(line)


LINES = "line_id bigint, body_id bigint, db_name string, precision string, received_at timestamp_ntz, line string, reason string"
AT = datetime(2024, 1, 1)


def frame(spark, lines, db=None, precision=None):
    return spark.createDataFrame([(i, 1, db, precision, AT, line, "clash") for i, line in enumerate(lines)], LINES)


def test_frames(spark):
    long = 'm f="' + "x y," * 100_000 + '",g=1i 7'
    rows = {r.line_id: r for r in bad_rows.parse_lines(frame(spark, ["db.m,a=b f=1,g=2i,h=3u,i=t,j=\"s\" 7", None, "", "# c", "m f=", long, "m f=1", "m f=1"], precision="ms")).collect()}
    assert sorted(rows) == [0, 4, 5, 6, 7]
    r = rows[0]
    assert (r.database, r.table, r.tags, r.floats, r.ints, r.booleans, r.strings, r.time) == ("db", "m", {"a": "b"}, {"f": 1.0}, {"g": 2}, {"i": True}, {"j": "s"}, 7_000_000)
    assert int(r.uints["h"]) == 3
    assert rows[4].reason == "column_count" and rows[4].table is None
    assert len(rows[5].strings["f"]) == 400_000
    assert rows[6].time == 1704067200 * 10**9 and rows[6].database == "default"


def test_database_given_wins(spark):
    [r] = bad_rows.loaded_lines(frame(spark, ["db.m f=1 9223372036854775807"], db="own", precision="s")).collect()
    assert (r.database, r.table, r.time) == ("own", "db.m", None)


def test_control_characters_in_values():
    v = "a\x1f\x1e\x1d\ue000b\rc"
    assert parse(f'm f="{v}",g=t').fields == {"f": v, "g": True}
    assert parse("m f=\x1f").fields if check("m f=\x1f")[0] else check("m f=\x1f")[1] == "value"


def test_failed_and_loaded_are_one_parse(spark):
    lines = frame(spark, [*GOOD, *(x for xs in BAD.values() for x in xs), None, "# c"])
    whole = bad_rows.parse_lines(lines)
    assert sorted(map(tuple, bad_rows.failed_lines(lines).collect())) == sorted(map(tuple, whole.where("reason is not null").select("line_id", "reason").collect()))
    assert bad_rows.loaded_lines(lines).count() == len(GOOD)


def test_empty(spark):
    assert bad_rows.failed_lines(frame(spark, [])).count() == 0
