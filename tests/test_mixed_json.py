import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.mixed_json import json_types, read_json_typed


def _write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, lines in files.items():
        text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
        (folder / f"{name}.json").write_text(text + "\n")
    return str(folder)


def test_int_text_and_missing_in_three_files(spark, tmp_path):
    path = _write(
        tmp_path / "a",
        one=[{"id": 1, "user": 7, "v": 1}, {"id": 2, "user": 8, "v": 2.5}],
        two=[{"id": 3, "user": "u9", "v": None}, {"id": 4, "user": "10", "v": 3}],
        three=[{"id": 5, "extra": {"x": [1]}}, "not json", "", "  ", "[1]"],
    )
    got = read_json_typed(spark, path)
    assert got.schema["user"].dataType == T.StringType() and got.schema["id"].dataType == T.LongType()
    assert isinstance(got.schema["v"].dataType, T.DecimalType) and got.schema["extra"].dataType == T.VariantType()
    plain = got.select("id", "user", F.col("v").cast("double").alias("v"), F.to_json("extra").alias("extra"), "_unfit")
    assert rows(plain) == [
        (None, None, None, None, "[1]"),
        (None, None, None, None, "not json"),
        (1, "7", 1.0, None, None),
        (2, "8", 2.5, None, None),
        (3, "u9", None, None, None),
        (4, "10", 3.0, None, None),
        (5, None, None, '{"x":[1]}', None),
    ]
    typed = read_json_typed(spark, path, "id long, user int", path_column="file")
    assert rows(typed.withColumn("file", F.regexp_extract("file", r"(\w+)\.json", 1))) == [
        (None, None, "[1]", "three"),
        (None, None, "not json", "three"),
        (1, 7, '{"v":1}', "one"),
        (2, 8, '{"v":2.5}', "one"),
        (3, None, '{"user":"u9"}', "two"),
        (4, 10, '{"v":3}', "two"),
        (5, None, '{"extra":{"x":[1]}}', "three"),
    ]


@pytest.mark.parametrize(
    ("kind", "fit", "unfit"),
    [
        ("int", [3, "4", 5.0, 1e3], [2.5, True, 2**31, "x", "2.5", [1], {"a": 1}]),
        ("long", [2**62 + 1, "12"], [2**64, 0.5, False]),
        ("double", [1, 2.5, "1e3"], ["x", True, []]),
        ("decimal(6,2)", [1, 2.5, "3.25", 1000.01], [1.234, 123456, "x", False]),
        ("boolean", [True, "false"], [1, 0, "x", []]),
        ("date", ["2024-02-29"], ["2023-02-29", 5, True]),
        ("timestamp", ["2024-02-29 01:02:03"], ["soon", 5]),
        ("string", ["x", 1, True, [1], {"a": 1}], []),
        ("variant", ["x", 1, True, [1], {"a": 1}], []),
    ],
)
def test_what_fits(spark, tmp_path, kind, fit, unfit):
    path = _write(tmp_path / "k", a=[{"x": v} for v in [None, *fit, *unfit]] + [{}])
    got = read_json_typed(spark, path, f"x {kind}").select(F.col("x").isNotNull().alias("has"), "_unfit").collect()
    assert sum(r.has for r in got) == len(fit)
    assert [json.loads(r._unfit)["x"] for r in got if r._unfit is not None] == unfit
    assert not any(r.has and r._unfit is not None for r in got)


def test_odd_names_and_empty_input(spark, tmp_path):
    odd = {"a b": 1, "OBJECT<x": "t", "tick`": True, "dot.ted": None, "quo\"te'": 2, "": 3, "n": {"OBJECT<": 1}}
    path = _write(tmp_path / "odd", a=[odd, '{"a b": 1, "a b": 2}'])
    got = read_json_typed(spark, path)
    found = [r.asDict() for r in got.where("_unfit is null").collect()]
    assert {k: v for k, v in found[0].items() if k not in ("n", "_unfit")} == {k: v for k, v in odd.items() if k != "n"}
    assert rows(got.select("_unfit")) == [(None,), ('{"a b": 1, "a b": 2}',)]
    empty = read_json_typed(spark, _write(tmp_path / "empty", a=[]))
    assert empty.columns == ["_unfit"] and empty.isEmpty()
    assert json_types(spark.createDataFrame([("[1]",), (None,)], "value string")) == T.StructType([])
    with pytest.raises(ValueError, match="repeat a name"):
        read_json_typed(spark, path, "x int, _unfit string")
    with pytest.raises(ValueError, match="take VARIANT"):
        read_json_typed(spark, path, "x array<int>")
