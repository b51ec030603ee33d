import csv
import gzip
import io

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.sources.readers import read_csv_strings
from millrace.sources.records import read_csv_records, read_records


def _file(tmp_path, data, name="a.csv"):
    (tmp_path / name).write_bytes(data.encode())
    return str(tmp_path / name)


def _csv(records):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    return out.getvalue()


def test_one_file_of_many_blocks_equals_the_whole_file_reader(spark, tmp_path):
    cells = ["plain", "two\nlines", 'a "quoted"\n\n"cell"', "", ",", "\n" * 40, "x" * 150, '"', "é\nß"]
    table = [["id", " note ", "more"]] + [[str(i), cells[i % 9], cells[i * 7 % 5]] for i in range(1, 400)]
    path = _file(tmp_path, _csv(table))
    whole = rows(read_csv_strings(spark, path, multi_line=True))
    for size in (200, 4096, None):
        got = read_csv_records(spark, path, block_bytes=size)
        assert got.columns == ["id", "note", "more"]
        assert rows(got) == whole == sorted(tuple(r) for r in table[1:])
    assert read_records(spark, path, block_bytes=200).select("block").distinct().count() > 20


def test_a_record_over_many_blocks_and_the_order_of_records(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(100))
    path = _file(tmp_path, _csv([["a"], ["first"], [long], ["last"], [long]]))
    found = read_records(spark, path, block_bytes=32).orderBy("block", "no").collect()
    assert [r.record for r in found] == ["a", "first", f'"{long}"', "last", f'"{long}"']


def test_ends_of_lines_marks_and_ragged_rows(spark, tmp_path):
    path = _file(tmp_path, '﻿a, b ,c\r\n1,"x\r\ny",3,surplus\r\n\r\n   \r\n2\r\n,,\r\n"q"";",5,"6"')
    assert rows(read_csv_records(spark, path)) == [("", "", ""), ("1", "x\r\ny", "3"), ("2", "", ""), ('q";', "5", "6")]
    assert rows(read_csv_records(spark, _file(tmp_path, "a;b\n'x\n;y';2\n", "b.csv"), sep=";", quote="'")) == [("x\n;y", "2")]


def test_a_compressed_file_is_one_block(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(_csv([["a", "b"], *[[str(i), f"{i}\n\"{i}\""] for i in range(50)]]))
    got = read_csv_records(spark, str(tmp_path / "a.csv.gz"), block_bytes=64)
    assert rows(got) == sorted((str(i), f'{i}\n"{i}"') for i in range(50))


def test_other_marks(spark, tmp_path):
    for sep, quote in ((";", "$"), ("|", "\\"), ("\t", "'"), ("^", "]")):
        text = f"a{sep}b\n{quote}x{sep}\n{quote}{quote}y{quote}{sep}2\n"
        path = _file(tmp_path, text, f"marks{ord(quote)}.csv")
        assert [r.record for r in read_records(spark, path, sep, quote).orderBy("no").collect()] == text[:-1].split("\n", 1)


def test_many_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(5):
        _file(folder, _csv([["k", "v w"], [str(i), "a\nb"]] + [[str(i), "c"]] * i), f"{i}.csv")
    _file(folder, "", "empty.csv")
    got = rows(read_csv_records(spark, str(folder), block_bytes=16))
    assert got == sorted([(str(i), "a\nb") for i in range(5)] + [(str(i), "c") for i in range(5) for _ in range(i)])
    _file(folder, "k,other\n1,2\n", "odd.csv")
    with pytest.raises(ValueError, match="different headers"):
        read_csv_records(spark, str(folder))


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="inside quotes"):
        read_csv_records(spark, _file(tmp_path, 'a,b\n1,"open\n2,3\n'), block_bytes=4)
    stray = _file(tmp_path, 'a,b\n5" pipe,1\nplain,2\n6" pipe,3\n', "stray.csv")
    with pytest.raises(Exception, match="inside an unquoted cell"):
        read_csv_records(spark, stray).collect()
    even = _file(tmp_path, 'a,b\n5" x 6" pipe,1\n"x\ny",2\n', "even.csv")
    assert rows(read_csv_records(spark, even)) == [('5" x 6" pipe', "1"), ("x\ny", "2")]
    with pytest.raises(ValueError, match="empty"):
        read_csv_records(spark, _file(tmp_path, "", "none.csv"))
    with pytest.raises(ValueError, match="repeated"):
        read_csv_records(spark, _file(tmp_path, "a, a\n1,2\n", "twice.csv"))
    with pytest.raises(ValueError, match="one ASCII"):
        read_csv_records(spark, _file(tmp_path, "a\n1\n", "q.csv"), quote="")
    assert rows(read_csv_records(spark, _file(tmp_path, "a,b\n", "header.csv"))) == []


_CELL = st.text(alphabet='ab",\n', max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(_CELL, _CELL), max_size=12), st.integers(8, 40))
def test_any_table(spark, tmp_path_factory, table, size):
    path = _file(tmp_path_factory.mktemp("any"), _csv([["x", "y"], *table]))
    assert rows(read_csv_records(spark, path, block_bytes=size)) == sorted(table)
