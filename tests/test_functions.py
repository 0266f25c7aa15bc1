from datetime import date

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import humanise, plain, text
from lodegraph.functions.spans import attribute_display, call_line, first_line, last_line


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (humanise.ordinal, 111, "111th"), (humanise.ordinal, 22, "22nd"), (humanise.intcomma, -1234567, "-1,234,567"), (humanise.intcomma, 1234.5667, "1,234.5667"), (humanise.intword, 999_999, "1.0 million"),
        (humanise.intword, -1_500_000, "-1.5 million"), (humanise.intword, 100, "100"), (humanise.digit_word, 5, "five"), (humanise.digit_word, 10, "10"), (humanise.naturalsize, 3000, "3.0 kB"), (humanise.naturalsize, 1, "1 Byte"),
        (humanise.scientific, 0.00012, "1.20 x 10⁻⁴"), (humanise.scientific, 0, "0.00 x 10⁰"), (humanise.metric, 1500, "1.50 k"), (humanise.metric, 2.3e8, "230 M"), (humanise.naturaldelta, 3700, "an hour"), (humanise.naturaldelta, 86400 * 400, "1 year, 1 month"),
    ],
)
def test_words(spark, f, value, want):
    assert one(spark, f(F.lit(value))) == want


def test_lists_clamps_and_fractions(spark):
    assert [one(spark, humanise.natural_list(F.array(*map(F.lit, items)))) for items in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]
    assert [one(spark, humanise.clamp(F.lit(v), 1, 9)) for v in (0, 5, 10)] == ["<1", "5", ">9"]
    assert [humanise.fraction(v) for v in (0.5, 1 / 3, 1.25, 3.0, -0.25, None)] == ["1/2", "1/3", "1 1/4", "3", "-1/4", None]


def test_spans_and_displays(spark):
    df = spark.createDataFrame([("3:1-9:2",), ("4:0",), ("7",), ("module",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(first_line(F.col("s")), last_line(F.col("s")), call_line(F.col("s"))).collect()]
    assert got == [(3, 9, 3), (4, 4, 4), (None, None, 7), (None, None, None), (None, None, None), (None, None, None)]
    d = spark.createDataFrame([("x (ast Attribute: a.b -> m.b)",), ("ast Attribute: a.b -> m.b (guess)",), ("none",)], "d string")
    assert [tuple(r) for r in d.select(*attribute_display(F.col("d"))).collect()] == [("a.b", "m.b"), ("a.b", "m.b"), ("", "")]


def test_names_and_types(spark):
    assert one(spark, text.slug(F.lit("__a b/c:d.e-f__"))) == "a_b_c:d.e-f" and one(spark, text.module_key(F.lit("a/b/__init__.py"))) == "a.b" and one(spark, text.n_tokens(F.lit("  "))) == 1
    assert [one(spark, text.core_type(F.lit(t))) for t in ("const struct node *", "unsigned  int[4]", "enum e")] == ["node", "unsigned int", "e"]
    assert one(spark, text.return_type(F.lit("int *(char, int)"))) == "int *" and one(spark, text.is_external_primitive(F.lit("size_t")))


def test_iso_texts():
    assert [plain.parse_date(t) for t in ("2025-03-04", "20250304", "2025-W10-2", "2025-063", "2025-03", "2025")] == [date(2025, 3, 4)] * 4 + [date(2025, 3, 1), date(2025, 1, 1)]
    assert plain.parse_time("10:30:15.5+02:00") == {"hour": 10, "minute": 30, "second": 15, "microsecond": 500_000, "zone_minutes": 120}
    assert plain.parse_duration("-P1Y2M3DT4H") == {"years": -1.0, "months": -2.0, "days": -4, "seconds": 72000, "microseconds": 0}
    assert plain.format_duration(1, 0, 2, 3661) == "P1Y2DT1H1M1S" and plain.format_duration(0, 0, 0, 0) == "P0D"
    for bad in ("P", "1Y", "2025-13-01", "2025-366"):
        with pytest.raises(ValueError):
            plain.parse_date(bad) if bad[0] == "2" else plain.parse_duration(bad)


def test_documents():
    import json

    for a, b in (({"a": [1, 2, {"x": 1}]}, {"a": [1, 3], "b": None}), ([], {}), ({"a/b": 1, "c~d": 2}, {"a/b": 2})):
        assert json.loads(plain.apply_patch(json.dumps(a), plain.make_patch(json.dumps(a), json.dumps(b)))) == b
    assert plain.resolve_pointer('{"a/b": [10, {"~": 3}]}', "/a~1b/1/~0") == "3" and plain.strict_json(' {"b":1,"a":[2]}') == '{"a":[2],"b":1}'
    for bad in ('{"a":1,"a":2}', "NaN", ""):
        with pytest.raises(ValueError):
            plain.strict_json(bad)


def test_versions():
    assert [plain.compare_versions(a, b) for a, b in (("1.0.0-alpha", "1.0.0"), ("1.0.0-alpha.1", "1.0.0-alpha.beta"), ("2.0.0", "2.0.0"), ("1.0.0+a", "1.0.0+b"))] == [-1, -1, 0, None]
    assert plain.matches_spec("^1.2.0", "1.9.9") and not plain.matches_spec("^0.2.3", "0.3.0") and plain.matches_spec("~=1.4", "1.9.0") and not plain.matches_spec("!=1.2", "1.2.5")
    assert plain.matches_npm("1.0.0 - 2.0.0", "2.0.0") and plain.matches_npm(">=1.0.0 || >=3.0.0", "3.5.0") and not plain.matches_npm("^1.2.3", "1.3.0-rc.1")


def test_texts_and_scripts():
    from random import Random

    rnd = Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in "xy")
        d = plain.diff(a, b)
        assert "".join(t for k, t in d if k <= 0) == a and "".join(t for k, t in d if k >= 0) == b
    assert plain.diff_distance("kitten", "kittens") == 1 and plain.fuzzy_find("abcdefghijk", "efxhi", 0) == 4
    assert plain.split_statements("select ';' from a; -- x;\nselect $$;$$;create function f() begin x; end;") == ["select ';' from a; -- x;", "select $$;$$;", "create function f() begin x; end;"]
    assert [plain.detect_charset(t) for t in ("Привет, мир".encode("cp1251"), "日本語のテキスト".encode("shift_jis"), "é".encode(), b"abc")] == ["cp1251", "shift_jis", "utf_8", "ascii"]


def test_vectorised_gives_null_for_errors_and_nulls(spark):
    f = plain.vectorised(plain.compare_versions, "int")
    df = spark.createDataFrame([("1.0.0", "2.0.0"), ("x", "1.0.0"), (None, "1.0.0")], "a string, b string")
    assert [r[0] for r in df.select(f("a", "b")).collect()] == [-1, None, None]


def test_stream_counts_repeats_once(spark, tmp_path):
    from datetime import datetime

    from lodegraph.streaming.observations import STREAM_SCHEMA, delivery_counts, observation_stream

    row = ("g", "s", "a", "b", 0.4, "weak", "f", "1:1", "x", "d", datetime(2025, 1, 1, 10, 5))
    later = (*row[:-1], datetime(2025, 1, 1, 10, 40))
    end = ("g", "s", "z", "b", 0.4, "weak", "f", "1:1", "x", "d", datetime(2025, 1, 2))
    for k, r in enumerate((row, later, end, (*end[:2], "zz", *end[3:-1], datetime(2025, 1, 3)))):
        spark.createDataFrame([r], STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = delivery_counts(observation_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["window"]["start"].hour, r["n"]) for r in spark.sql("select * from counts").collect()]
    assert (10, 1) in got
