"""Readers and writers on small files."""

import struct

import numpy as np
import pytest

from gridloom.sources import sinks, tables


def test_csv_round_trip_with_other_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "k long, t string, v double")
    sinks.write_csv(df, f"{tmp_path}/x")
    got = tables.read_csv(spark, f"{tmp_path}/x", "k long, t string, v double", ["key", "text", "value"])
    assert got.columns == ["key", "text", "value"] and sorted(map(tuple, got.collect())) == [(1, "a,b", 0.5), (2, None, None)]


def test_parquet_tables_and_the_dataset_switch(spark, tmp_path):
    sinks.write_table(spark.range(3), f"{tmp_path}/three.parquet")
    assert tables.read_table(spark, str(tmp_path), "three").count() == 3
    tables.register("three", f"{tmp_path}/three.parquet")
    assert tables.dataset(spark, "three").count() == 3
    with pytest.raises(ValueError, match="unknown dataset"):
        tables.dataset(spark, "four")


def test_white_space_tables(spark, tmp_path):
    (tmp_path / "t.txt").write_text("lon lat  v\n1 2.5 x\n\n  3\t-4.0   y \n")
    got = tables.read_whitespace(spark, f"{tmp_path}/t.txt", [("lon", "int"), ("lat", "double"), ("v", "string")], header=True)
    assert sorted(map(tuple, got.collect())) == [(1, 2.5, "x"), (3, -4.0, "y")]


def test_matrix_checks_its_size(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    got = {(r.i, r.j): r.v for r in tables.read_matrix(spark, f"{tmp_path}/m.txt, 2, 3").collect()}
    assert got == {(i, j): float(3 * i + j + 1) for i in range(2) for j in range(3)}
    with pytest.raises(ValueError):
        tables.read_matrix(spark, f"{tmp_path}/m.txt,3,3")
    with pytest.raises(Exception, match="without 2 values"):
        tables.read_matrix(spark, f"{tmp_path}/m.txt,2,2").collect()


def test_command_line_settings_are_parsed_not_evaluated():
    c = tables.Config.parse("a 1\nb 2").override(["b=3", "name=__import__('os')", "empty="])
    assert c.integer("a") == 1 and c.integer("b") == 3 and c.text("name") == "__import__('os')" and c.text("empty") == ""
    for bad in ("b", "=3", "a b=1"):
        with pytest.raises(ValueError):
            c.override([bad])


def test_raster_cells(spark, tmp_path):
    v = np.arange(6 * 4, dtype="<u2").reshape(4, 6)
    strips = [v[:2].tobytes(), v[2:].tobytes()]
    tags = [(256, 3, 1, 6), (257, 3, 1, 4), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 2, None), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 2, None)]
    head = 8 + 2 + 12 * len(tags) + 4
    places = struct.pack("<II", head + 16, head + 16 + len(strips[0]))
    sizes = struct.pack("<II", len(strips[0]), len(strips[1]))
    entries = b"".join(struct.pack("<HHII", t, k, n, x if x is not None else head + (0 if t == 273 else 8)) for t, k, n, x in tags)
    (tmp_path / "r.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + places + sizes + b"".join(strips))
    got = {(r.ix, r.iy): r.v for r in tables.read_raster(spark, f"{tmp_path}/r.tif").collect()}
    assert got == {(x, y): int(v[y, x]) for y in range(4) for x in range(6)}


def test_fixed_text(spark, tmp_path):
    sinks.write_fixed(spark.createDataFrame([(1, 0.5, 2.0)], "k long, a double, b double"), f"{tmp_path}/f", ["k", "a", "b"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/f").collect()] == ["1\t0.5000000000\t2.0000000000"]
