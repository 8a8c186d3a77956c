"""CSV with line breaks in quotes against the reader that doesn't split files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from footfall import sources
from footfall.sources.readers import CSV_FORM
from footfall.sources.records import _lines, parsed, records, splits

KEY = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture(params=[37, 150, 1 << 20])
def split_size(spark, request):
    before = {k: spark.conf.get(k) for k in (KEY, OPEN_COST)}
    spark.conf.set(KEY, str(request.param))
    spark.conf.set(OPEN_COST, "1")
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def write(path, rows, line_end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return str(path)


def unsplit(spark, path):
    return spark.read.options(**CSV_FORM, mode="FAILFAST", multiLine=True).csv(path)


def split(spark, path):
    names = unsplit(spark, path).columns
    return parsed(records(spark, path), names, CSV_FORM)


def same(spark, path):
    found, expected = split(spark, path), unsplit(spark, path)
    assert found.columns == expected.columns
    key = lambda r: [(v is not None, v or "") for v in r]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


CELLS = ["x", "", "two\nlines", "\n", "a \"quoted\" one", '"', '""', "a,b", " blank ", "é中\n😀", "back\\slash", "\n\n\n" * 30,
         "line\nwith \"quotes\n\" over\nlines", "z" * 90]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_random_files(spark, tmp_path, split_size, seed, line_end):
    rng = random.Random(seed)
    rows = [["id", "name", "a note"]] + [[str(i), *rng.choices(CELLS, k=2)] for i in range(60)]
    same(spark, write(tmp_path / "t.csv", rows, line_end))


def test_a_file_is_read_by_several_tasks(spark, tmp_path, split_size):
    rows = [["id", "note"]] + [[str(i), f"one\ntwo {i}"] for i in range(200)]
    path = write(tmp_path / "t.csv", rows)
    n = splits(_lines(spark, path)).count()
    assert n > 15 or split_size > 200
    same(spark, path)
    found = split(spark, path).collect()
    assert sorted(int(r.id) for r in found) == list(range(200))


def test_several_files_and_a_record_longer_than_a_split(spark, tmp_path, split_size):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        rows = [["id", "note"], [f"{k}", "line\n" * 300], [f"{k}b", "plain"], [f"{k}c", "end\n"]]
        write(folder / f"{k}.csv", rows)
    same(spark, str(folder))


def test_header_over_two_lines(spark, tmp_path, split_size):
    same(spark, write(tmp_path / "t.csv", [["id", "a\nnote"], ["1", "x"], ["2", "y\nz"]]))


@pytest.mark.parametrize("text", ["id,note\n", "id,note", "id,note\n1,x", "id,note\n\n1,x\n\n", "﻿id,note\n1,x\n"])
def test_ends_of_files(spark, tmp_path, split_size, text):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    same(spark, str(path))


def test_records_of_another_length_fail(spark, tmp_path, split_size):
    for rows in ([["id", "a", "b"], ["1", "x\ny"]], [["id", "a"], ["1", "x\ny", "z"]]):
        path = write(tmp_path / f"{len(rows[1])}.csv", rows)
        with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
            split(spark, path).collect()
        with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
            split(spark, path).select("id").collect()


def test_another_header_fails(spark, tmp_path):
    folder = tmp_path / "two"
    folder.mkdir()
    write(folder / "a.csv", [["id", "note"], ["1", "x"]])
    write(folder / "b.csv", [["id", "other"], ["2", "y"]])
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        split(spark, str(folder)).collect()


def test_readers_use_it(spark, tmp_path, split_size):
    rows = [["user_id", "gender", "extra"]] + [[f"u{i}", "a\nb" if i % 2 else "NA", "x"] for i in range(50)]
    users = sources.read_users(spark, write(tmp_path / "users.csv", rows), multi_line=True)
    found = {r.user_id: r.gender for r in users.collect()}
    assert found == {f"u{i}": "a\nb" if i % 2 else None for i in range(50)}
