from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.operators import records as r

FORMS = [r.Format(1, ",", ("id", "n", "x", "at", "s"), ("bigint", "int", "double", "timestamp", "string")), r.Format(2, "\t", ("id", "s", "s"), ("string", "string", "string"))]
GOOD = ["1,2,3.5,2024-02-29 23:59:59,hello", '7,,,,"a ""b"", c"', '1,+5,-1e3,"2020-01-01 00:00:00",""', "1,2,.5,,x\r", '9,1,2.,,"line\nbreak"']
BAD = {
    ",2,3,,x": "empty_first_field", '"",2,3,,x': "empty_first_field", "1,2,3,,x,y": "field_count", "1,2": "field_count", "": "field_count",
    '1,2,3,,"x': "broken_quoting", '1,2,3,,"x" ': "broken_quoting", '1,2,3,,a"b': "broken_quoting", "x,2,3,,": "bad_bigint",
    "9223372036854775808,2,3,,": "bad_bigint", "1,2147483648,3,,": "bad_int", "1,0x1F,3,,": "bad_int", "1,１,3,,": "bad_int",
    "1,2,nan,,": "bad_double", "1,2,1e,,": "bad_double", "1,2,3,2023-02-30 00:00:00,": "bad_timestamp", "1,2,3,2024-01-01,": "bad_timestamp", "1,2,3,2024-01-01 24:00:00,": "bad_timestamp",
}


def test_reasons_and_values(spark):
    rows = [(i, 1, t) for i, t in enumerate([*GOOD, *BAD, *GOOD * 20])] + [(-1, 1, None), (-2, 9, "1"), (-3, None, "1"), (-4, 2, "a\tb\tc")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "line_id bigint, format_id int, text string, reason string")
    got = {x.line_id: x for x in r.parse_records(df, FORMS).collect()}
    for i, t, in enumerate([*GOOD, *BAD]):
        assert got[i].reason == BAD.get(t), t
        assert (got[i].fields is None) == (t in BAD)
    assert got[-1].reason == "empty_record" and got[-2].reason == got[-3].reason == "unknown_format" and got[-4].fields == ["a", "b", "c"]
    typed = {x["_line_id"]: x for x in r.typed_rows(r.parse_records(df, FORMS), FORMS[0]).collect()}
    assert typed[0].id == 1 and typed[0].n == 2 and typed[0].x == 3.5 and str(typed[0]["at"]) == "2024-02-29 23:59:59"
    assert typed[1].n is None and typed[1].s == 'a "b", c' and typed[2].n == 5 and typed[3].s == "x" and typed[4].s == "line\nbreak"
    assert r.typed_rows(r.parse_records(df, FORMS), FORMS[1]).columns == ["_line_id", "id", "s", "s_2"]
    assert r.typed_structs(r.parse_records(df, FORMS), FORMS).where("format_id = 2").first().row_2.s_2 == "c"
    assert r.parse_records(df.limit(0), FORMS).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a1,"\n. -', max_size=12), min_size=1, max_size=40))
def test_blocks_agree_with_the_strict_parser(texts):
    import pyarrow as pa

    form = r.Format(1, ",", ("a", "b"), ("string", "double"))
    out = [None] * len(texts)
    for first, fields, reasons, details in r._parse(pa.array(texts, pa.string()), form):
        for k, found in enumerate(zip(fields.to_pylist(), reasons, details, strict=True)):
            out[first + k] = found
    assert out == [r.diagnose(t, form) for t in texts]
