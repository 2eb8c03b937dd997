"""Quoted files cut in parallel, against a reader that goes from the first character to the last."""

import csv
import io
import random

import pytest

from tabscope import read_csv
from tabscope.sources.records import block_maps, open_after, open_blocks, records


def plainly_open(text):
    """Character by character: whether a quoted value is open at the end."""
    is_open, begins, i = False, True, 0
    while i < len(text):
        c = text[i]
        if is_open:
            if c == '"' and text[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                is_open = False
        elif c == '"' and begins:
            is_open = True
        begins = not is_open and c in ",\n"
        i += 1
    return is_open


def test_state_behind_a_line():
    draw = random.Random(6)
    for _ in range(4000):
        text = "".join(draw.choice('",a') for _ in range(draw.randint(0, 9)))
        assert open_after(text, False) == plainly_open(text), text
        assert open_after(text, True) == plainly_open('"' + text), text


def test_states_of_blocks(spark):
    """The composed maps give every block the state in which a scan from the start reaches it."""
    draw = random.Random(7)
    rows, want = [], set()
    for f in range(30):
        state = False
        for b in range(draw.randint(1, 12)):
            if state:
                want.add((f"f{f}", b))
            shut, was_open = draw.choice([(False, True), (False, False), (True, True), (True, False)])
            rows.append((f"f{f}", b, shut, was_open))
            state = was_open if state else shut
    maps = spark.createDataFrame(rows, "file string, block long, if_shut boolean, if_open boolean").repartition(5)
    assert {tuple(r) for r in open_blocks(maps).collect()} == want


def written(draw, n, end):
    """A file's text and its rows: quotes, separators and line breaks inside values, stray quotes, empty lines."""
    out, rows = io.StringIO(), []
    out.write("k,a,b" + end)
    for k in range(n):
        a = draw.choice(["plain", 'with "quotes"', "a,b", "line one\nline two", "\n\n", "x" * 300, 'ends in "'])
        cell = io.StringIO()
        csv.writer(cell, lineterminator="").writerow([a])
        b = draw.choice(['5" pipe', "6'", "z"])
        out.write(f"{k},{cell.getvalue()},{b}{end}")
        rows.append((k, a, b))
        if k % 50 == 7:
            out.write(end)
    return out.getvalue(), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_in_many_blocks(spark, tmp_path, end):
    draw = random.Random(8)
    want = []
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("a", "b"):
        text, rows = written(draw, 400, end)
        (folder / f"{name}.csv").write_bytes(text.encode())
        want += rows
    path = str(folder)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.text(path, lineSep="\n")
        assert lines.rdd.getNumPartitions() > 20
        assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == sorted(want)
        assert records(spark, path).count() == len(want)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_one_value_over_many_blocks(spark, tmp_path):
    long = "\n".join(["words"] * 3000)
    (tmp_path / "l.csv").write_text(f'﻿k,s\n1,"{long}"\n2,x\n', encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = read_csv(spark, str(tmp_path / "l.csv"))
        assert got.columns == ["k", "s"] and sorted(tuple(r) for r in got.collect()) == [(1, long), (2, "x")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_maps_of_a_file_without_quotes(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    lines = spark.read.text(str(tmp_path / "p.csv"), lineSep="\n").selectExpr("value", "_metadata.file_path AS file", "_metadata.file_block_start AS block")
    assert [(r.if_shut, r.if_open) for r in block_maps(lines).collect()] == [(False, True)]
