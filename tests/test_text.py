"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "number"), [("46,5", 46.5), ("120 cm", 120.0), ("46, 46", None), ("-3", -3.0), ("", None), ("12 KG", 12.0), ("x", None), ("1.2.3", None), (None, None)])
def test_number(spark, value, number):
    assert one(spark, text.number(F.lit(value).cast("string"))) == number


@pytest.mark.parametrize(("value", "shown"), [(46.0, "46"), (46.5, "46.5"), (0.25, "0.25"), (1234567.25, "1234570"), (-2.0, "-2")])
def test_number_text(spark, value, shown):
    assert one(spark, text.number_text(F.lit(value))) == shown


@pytest.mark.parametrize(("value", "normal"), [("  Żółta  KANAPA, 90×200 ", "zolta kanapa 90 200"), ("A.b/c-d_x", "a.b/c-d_x"), (None, ""), ("ＡＢ１", "ab1")])
def test_norm(spark, value, normal):
    assert one(spark, text.norm(F.lit(value).cast("string"))) == normal


@pytest.mark.parametrize(
    ("name", "counts"),
    [("Szafa 3-drzwiowa z 2 szufladami", (3, 2, None, None, False)), ("Szafa dwudrzwiowa", (2, None, None, None, False)), ("Komoda z szufladą", (None, 1, None, None, False)), ("Komoda z szufladami", (None, None, None, None, True)), ("Regał bez drzwi 5 półek", (0, None, None, None, False)), ("Witryna 2d1w3s", (2, 3, None, None, False)), ("Materac 1000 szuflad", (None, None, None, None, False))],
)
def test_part_counts(spark, name, counts):
    assert tuple(one(spark, text.part_counts(F.lit(name)))) == counts


@pytest.mark.parametrize(("name", "size"), [("Łóżko (90x200)", (90.0, 200.0, None, None)), ("Stół 120 x 80 x 75", (120.0, 80.0, 75.0, None)), ("Stolik śr. 60", (None, None, None, 60.0)), ("Model 1234x12", (None, None, None, None)), ("Łóżko 5 x 90x200", (90.0, 200.0, None, None)), ("Blat 12x20x3000", (12.0, 20.0, None, None)), ("Szafa 90x200.", (None, None, None, None)), ("Stolik fi 45", (None, None, None, 45.0)), (None, (None, None, None, None))])
def test_dimensions(spark, name, size):
    assert tuple(one(spark, text.dimensions(F.lit(name).cast("string")))) == size


def test_packed(spark):
    got = one(spark, text.packed(F.lit("Szerokość: 60 | smiec | Waga: 36 | : x | Waga: 37:5 |")))
    assert [tuple(p) for p in got] == [("Szerokość", "60"), ("Waga", "37:5")]
    assert one(spark, text.packed(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("a", "b", "same"), [("46", "46,0", True), ("szkło, metal", "metal, szkło", True), ("46", "47", False), ("Drewno", "drewno", True), ("", "", True), ("a, b", "a", False)])
def test_same_value(spark, a, b, same):
    assert one(spark, text.same_value(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize(("a", "b", "kind"), [("90,5", "90", "rounding"), ("102", "200", "different numbers"), ("5", "5,0", "same number"), ("a, b", "B, a", "same list"), ("a, b", "a", "more members"), ("a", "a, c", "fewer members"), ("a", "c", "different values")])
def test_difference(spark, a, b, kind):
    assert one(spark, text.difference(F.lit(a), F.lit(b)))["kind"] == kind


@pytest.mark.parametrize(("value", "pair"), [("180x200", (180, 200)), ("90x200, 200 x 90", (90, 200)), ("90x200, 80x200", None), ("big", None), (None, None)])
def test_size_pair(spark, value, pair):
    got = one(spark, text.size_pair(F.lit(value).cast("string")))
    assert (tuple(got) if got else None) == pair


@pytest.mark.parametrize(("value", "fields"), [("wymiary: 99/210/89 cm, materiał: stal malowana proszkowo, kolor: biały", {"wymiar 1": "99", "wymiar 2": "210", "wymiar 3": "89", "materiał": "stal malowana proszkowo", "kolor": "biały"}), ("wymiary: 1200x800x400 mm", {"wymiar 1": "120", "wymiar 2": "80", "wymiar 3": "40"}), ("short", {})])
def test_described_fields(spark, value, fields):
    assert dict(tuple(r) for r in one(spark, text.described_fields(F.lit(value)))) == fields


def test_hashes_and_small_ones(spark):
    assert one(spark, text.value_hash(F.lit(None).cast("string"))) == one(spark, text.value_hash(F.lit(""))) == "da39a3ee5e6b"
    assert one(spark, text.csv_safe(F.lit("=1+1"))) == "'=1+1" and one(spark, text.csv_safe(F.lit("a=1"))) == "a=1"
    assert one(spark, text.identifier(F.lit("2022.0"))) == "2022" and one(spark, text.identifier(F.lit(" a1 "))) == "a1"
    assert one(spark, text.unit_factor(F.lit(120.0), F.lit(1200.0), 0.03)) and not one(spark, text.unit_factor(F.lit(120.0), F.lit(130.0), 0.03))
    assert one(spark, text.count_in_label(F.lit("4 i więcej"))) == 4 and one(spark, text.count_in_label(F.lit("bez szuflad"))) == 0 and one(spark, text.count_in_label(F.lit("kilka"))) is None
    assert one(spark, text.completeness(F.create_map(F.lit("Styl"), F.lit("x"), F.lit("b"), F.lit("y"), F.lit("c"), F.lit("z")))) == "bez_wymiarow"
    assert one(spark, text.base_name(F.lit("Komoda Avola 120x80 biała"))) == one(spark, text.base_name(F.lit("Komoda Avola 90x80 biała"))) == "komoda avola biala"


def test_fuzzy():
    assert fuzzy.similarity("drewno", "drewno") == 100 and fuzzy.similarity("", "x") == 0
    assert round(fuzzy.similarity("drewnoo", "drewno"), 2) == 92.31
    assert fuzzy.similarity("lampa biala stojaca", "stojaca lampa biala") == 95.0
    assert fuzzy.common_length("abcde", "ace") == 3 and fuzzy.common_length("", "a") == 0
    assert fuzzy.similarity("szafa", "kanapa narozna duza") < 60 < fuzzy.similarity("kanapa", "kanapa narozna")
