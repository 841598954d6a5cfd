import re
import unicodedata

from pyspark.sql import functions as F

from reviewloom import functions as fn

AS_OF = "2024-01-30 01:00:00"


def check(apply, f, cases, dtype="string"):
    got = dict(zip(cases, apply(f, list(cases), dtype)))
    assert got == cases


def test_clean_text(apply):
    check(
        apply,
        fn.clean_text,
        {"  a \n b　": "a b", "x¬†y Óóä": "xy", None: "", "": "", "   ": "", "a\x1cb\x85c": "a b c", "¬Óóä†x": "x"},
    )


def test_space_class_is_pythons(apply):
    chars = [chr(c) for c in range(1, 0x3100)]
    got = apply(fn.clean_text, [f"a{c}b" for c in chars])
    assert [c for c, g in zip(chars, got) if g != re.sub(r"\s+", " ", f"a{c}b")] == []


def test_has_text_agrees_with_clean_text(apply):
    values = [None, "", " ", " \n", "Óóä", "Óóä ", "¬Óóä†", "¬†x", "Ó", "¬ ", "a", " b", "\ufeff", "Óóx"]
    assert apply(fn.has_text, values) == [t != "" for t in apply(fn.clean_text, values)]


def test_clean_attributes(apply):
    check(
        apply,
        fn.clean_attributes,
        {
            "a | -b |  | !": "a, b",
            " Wi-Fi | éa": "Wi-Fi, a",
            "": "",
            "|||": "",
            "! | b  |c": "b, c",
            "é - x y |\n z ": "x y, z",
            "Parking: Free | WC": "Parking: Free, WC",
            None: "",
        },
    )


def test_anonymize_user(apply):
    check(
        apply,
        fn.anonymize_user,
        {" Abc ": "900150983c", "abc": "900150983c", "": "anonymous", None: "anonymous", " ": "d41d8cd98f"},
    )


def test_relative_time(apply):
    check(
        apply,
        lambda c: fn.relative_time(c, AS_OF),
        {
            "2 jam yang lalu": "2024-01-29",
            "1 jam": "2024-01-30",
            "25 jam": "2024-01-29",
            "26 jam": "2024-01-28",
            "3 hari yang lalu": "2024-01-27",
            "1 minggu yang lalu": "2024-01-23",
            "2 bulan lalu": "2023-12-01",
            "setahun lalu": "2023-01-30",
            "Diedit 2 bulan lalu": "2023-12-01",
            "2 jam 30 menit": "2024-01-30",
            "baru saja": "2024-01-30",
            "5 tahun lalu": "2019-01-31",
            "kemarin": "2024-01-30",
            "2 days ago": "2024-01-30",
            "diedit": "2024-01-30",
            "": "",
            None: "",
            "3000 tahun lalu": "",
            "99999999999 tahun": "",
            "999999999 tahun": "",
            "9999999999 jam": "",
            "0000000000003 hari": "2024-01-27",
            "٣ hari": "2024-01-27",
            "0 hari": "2024-01-30",
        },
    )


def test_relative_time_default_is_now(apply):
    import datetime

    before = datetime.datetime.now(datetime.UTC).date()
    (got,) = apply(fn.relative_time, ["baru saja"])
    assert str(before) <= got <= str(datetime.datetime.now(datetime.UTC).date())


def test_parse_int(apply):
    check(
        apply,
        fn.parse_int,
        {"1.234 ulasan": 1234, "ulasan": 0, None: 0, "4,5 dari 1.234": 451234, "": 0, "٣4": 34, "9" * 30: None},
    )


def test_digits_of_every_script(apply):
    known = unicodedata.ucd_3_2_0  # later scripts depend on the Unicode version of the JVM
    digits = [chr(c) for c in range(0x110000) if known.category(chr(c)) == unicodedata.category(chr(c)) == "Nd"]
    assert apply(fn.parse_int, digits) == [int(d) for d in digits]


def test_parse_rating(apply):
    values = ["4,5", "4.5f", "4.5d", "1.234,5", None, " 4.5 ", "1e3", "1_0", "٤", "_1", "1__0", ".", "", "-.5", "5.", "0x1"]
    got = apply(fn.parse_rating, values)

    def expected(v):
        try:
            return float(str(v).replace(",", "."))
        except ValueError:
            return 0.0

    assert got == [expected(v) for v in values]
    assert [str(x) for x in apply(fn.parse_rating, ["nan", "INF", "-infinity"])] == ["nan", "inf", "-inf"]


def test_rating_bucket(apply):
    check(apply, fn.rating_bucket, {5.0: 5, 4.7: 4, None: 0, 6.0: 0, -1.0: 0, 0.5: 0, 5.99: 5, float("inf"): 0}, "double")


def test_slug_and_key(apply):
    check(apply, fn.slugify, {"Tempat Makan di Bandung": "tempat_makan_di_bandung", "a--b _c! é": "a_b__c_é"})
    check(apply, fn.sanitize_key, {"Pa:ntai_#1 Ñ-x": "Pantai_1 Ñ-x", " /: ": "", "水²½": "水²½"})


def test_first_line_and_nonblank(apply):
    check(apply, fn.first_line, {"Ann\nLocal guide": "Ann", "Ann": "Ann", "\nx": ""})
    check(apply, fn.is_nonblank, {"\ufeff \n": False, "\x1c": True, "\x85": True, " a": True, None: False, "": False})


def test_list_to_text(spark):
    items = F.array(F.lit("Parking\nFree"), F.lit("WC"))
    assert spark.range(1).select(fn.list_to_text(items)).first()[0] == "Parking: Free | WC"


def test_variant_fields(spark):
    docs = ['{"r":5}', '{"r":"5"}', '{"r":4.7}', '{"r":"4.5"}', '{"r":null}', '{"r":true}', "{}", '{"r":[1]}', '{"r":1e0}', '{"r":" 3 "}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string").orderBy("i").select(F.parse_json("j").alias("v"))
    v = F.col("v")
    r = fn.field(v, "r")
    rows = df.select(fn.variant_rating_bucket(r), fn.variant_rating(r), fn.field_as_text(v, "r", "none"), fn.has_field(v, "r"), fn.variant_raw(r)).collect()
    assert [x[0] for x in rows] == [5, 5, 4, 0, 0, 1, 0, 0, 1, 3]
    assert [x[1] for x in rows] == [5, 5, None, None, None, 1, 0, None, 1, 3]
    assert [x[2] for x in rows] == [None, "5", None, "4.5", None, None, "none", None, None, " 3 "]
    assert [x[3] for x in rows] == [True] * 6 + [False] + [True] * 3
    assert [x[4] for x in rows] == ["5", "5", "4.7", "4.5", None, "true", None, "[1]", "1.0", " 3 "]
