"""The text functions on hand-made rows with expected values from plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import lookup
from tessera.plans import reports

ROWS = [
    ("", "e1\ne2\n", 1, "error: e1 e2", "e1 | e2"),
    ("  ", "x", 0, "ok", "ok"),
    ("", "", 0, "ok", "ok"),
    ("", "", 1, "error: ", "ok"),
    ("a\nb", "z", 0, "a", "a | b"),
    ("0\n1\n2\n3\n4\n5\n6\n7", "", 3, "error: 0 1 2 3 4 5 6 7", "0 | 1 | 2 | 3 | 4 | 5 | 6 | 7"),
    ("\tv1 \r\nv2\n", "", 0, "v1 ", "v1 \r | v2"),
    ("", "only err\n", 0, "only err", "only err"),
    ("a\n\n b \n", "", 0, "a", "a |  |  b"),
]
TAILS = [("e1\ne2\n", "e1 | e2"), ("", ""), ("  ", ""), ("0\n1\n2\n3\n4\n5\n6\n7", "3 | 4 | 5 | 6 | 7"), ("\tv1 \r\nv2\n", "v1  | v2"), ("a\n\n b \n", "a |  |  b")]


def test_outcome_and_flat(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(ROWS)], "i int, out string, err string, code int")
    got = df.select("i", text.outcome(F.col("out"), F.col("err"), F.col("code")), text.flat(F.col("out"), F.col("err"))).sort("i").collect()
    assert [tuple(r[1:]) for r in got] == [r[3:] for r in ROWS]


def test_tail(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TAILS)], "i int, t string")
    assert [r[1] for r in df.select("i", text.tail(F.col("t"))).sort("i").collect()] == [x for _, x in TAILS]


def test_strip_takes_all_white_space(spark):
    white = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    df = spark.createDataFrame([("".join(white) + "a b" + "".join(white),)], "t string")
    assert df.select(text.strip(F.col("t"))).first()[0] == "a b"


def test_nonblank_lines_are_kept_as_they_are(spark):
    df = spark.createDataFrame([("a\n \n\t\n  b \n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.nonblank(F.col("t"))).collect()] == [["a", "  b "], [], None]


@pytest.mark.parametrize("code, name", [(0, "CUDA_SUCCESS"), (7, "UNKNOWN"), (None, "UNKNOWN")])
def test_codes(spark, code, name):
    df = spark.createDataFrame([(code,)], "code int")
    row = df.select(text.named_code(F.col("code"), reports.CODES), text.exit_text(F.col("code"))).first()
    assert tuple(row) == (name, "missing" if code is None else f"exit={code}")


def test_version(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "/r", 0, " 4.1\n", ""), (3, "/r", 1, "x", "bad\n")], "i int, path string, code int, out string, err string")
    got = df.sort("i").select(text.version(*[F.col(c) for c in ("path", "code", "out", "err")])).collect()
    assert [r[0] for r in got] == ["missing", "4.1", "error: bad"]


def test_maps_and_paths(spark):
    df = spark.createDataFrame([({"k": "1"}, ["/a", "/b"], ""), ({"level": "9"}, [], "/old")], "m map<string,string>, parts array<string>, old string")
    got = df.select(text.put_if_absent(F.col("m"), "level", "2"), text.search_path(F.col("parts"), F.col("old"))).collect()
    assert [tuple(r) for r in got] == [({"k": "1", "level": "2"}, "/a:/b:"), ({"level": "9"}, "/old")]


def test_specifications(spark):
    df = spark.createDataFrame([("core", "numpy>=1.26"), ("ml", "tensorflow[and-cuda]>=2.16"), ("core", "# no"), ("core", ""), ("conda", "python=3.11"), ("core", "plain")], "group string, spec string")
    got = {r["package"]: (r["group"], r["extra"], r["op"], r["version"]) for r in reports.specifications(df).collect()}
    assert got == {"numpy": ("core", None, ">=", "1.26"), "tensorflow": ("ml", "and-cuda", ">=", "2.16"), "python": ("conda", None, "=", "3.11"), "plain": ("core", None, None, None)}


def test_package_report(spark):
    expected = spark.createDataFrame([(1, "scikit-learn", "sklearn"), (2, "numpy", "numpy"), (3, "torch", "torch")], "line int, dist string, module string")
    versions = spark.createDataFrame([("scikit-learn", "1.4"), ("torch", "2.2")], "dist string, version string")
    modules = spark.createDataFrame([("sklearn",), ("numpy",), ("numpy",)], "module string")
    got = reports.package_report(expected, versions, modules).sort("line").collect()
    assert [tuple(r)[1:] for r in got] == [("scikit-learn", "1.4", "ok"), ("numpy", "missing", "ok"), ("torch", "2.2", "missing")]


def test_tool_report(spark):
    expected = spark.createDataFrame([(1, "node", ["node", "--version"]), (2, "java", ["java"]), (3, "none", [])], "line int, name string, argv array<string>")
    results = spark.createDataFrame([("node", "v20\nmore", "", 0)], "program string, out string, err string, code int")
    assert [tuple(r)[1:] for r in reports.tool_report(expected, results).sort("line").collect()] == [("node", "v20"), ("java", "missing"), ("none", "missing")]


def test_device_report(spark):
    got = reports.device_report(
        spark.createDataFrame([(1, "/dev/a"), (2, "/dev/b")], "line int, path string"),
        spark.createDataFrame([("/dev/b",)], "path string"),
        spark.createDataFrame([(1, "smi", None, None, None), (2, "nvcc", 1, "", "x\ny")], "line int, name string, code int, out string, err string"),
        spark.createDataFrame([(1, "lib.so", 100, None), (2, "lib.so.1", None, "OSError: no file")], "line int, lib string, code int, error string"),
        spark.createDataFrame([(1, "tf", "a\n\n b\n", "", 0), (2, "torch", "", "1\n2\n3\n4\n5\n6\n", 1)], "source_no int, name string, out string, err string, code int"),
    )
    assert [r["line"] for r in got.sort("section_no", "line_no").collect()] == [
        "/dev/a\tmissing", "/dev/b\tpresent", "smi\tmissing\tmissing", "nvcc\texit=1\tx | y", "lib.so\tloaded; cuInit=100 (CUDA_ERROR_NO_DEVICE)", "lib.so.1\terror: OSError: no file", "a", " b", "torch\terror: exit=1; 2 | 3 | 4 | 5 | 6",
    ]


def test_set_difference_is_a_set(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "package string")
    b = spark.createDataFrame([("y",)], "package string")
    assert sorted(str(r[0]) for r in reports.to_install(a, b).collect()) == ["None", "x"]
    assert lookup.any_row(reports.to_install(b, b)).first()[0] == 0


def test_tsv_round_trip(spark, tmp_path):
    from tessera.sources.tables import read_lines, read_tsv, write_tsv

    df = spark.createDataFrame([("a", "1"), ("b", None)], "name string, version string")
    write_tsv(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in read_tsv(spark, str(tmp_path / "t"), "name string, version string").collect()) == [("a", "1"), ("b", "missing")]
    assert read_lines(spark, str(tmp_path / "t")).where("value like 'b%'").first()[0] == "b\tmissing"
