"""Values and rules that results depend on, by literal cases."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, text
from shelfwise.operators import detect, feeds, photos, review
from shelfwise.sources import readers
from test_operators import CELL, frame
from test_text import one


@pytest.mark.parametrize(
    ("label", "kind"),
    [
        ("Otwarty - front", "interior"), ("Wnętrze szafy – otwarte obie sekcje", "interior"), ("Narożnik - prezentacja schowka", "interior"), ("Przekrój", "interior"), ("Rysunek techniczny", "drawing"),
        ("Schemat/Infografika", "drawing"), ("Zamknięty - front", "front"), ("Zamknięty - widok pod kątem (front)", "front"), ("Widok z boku", "front"), ("Tyłem", "front"), ("Aranżacja", "arrangement"),
        ("Szczegóły", "arrangement"), ("Front", "other"), ("", "other"),
    ],
)
def test_photo_kinds(spark, label, kind):
    assert one(spark, text.photo_kind(F.lit(label))) == kind


@pytest.mark.parametrize(("field", "package"), [("package.pack@width", True), ("Wymiary paczki", True), ("karton szer", True), ("Koszt wysyłki", True), ("Waga brutto", True), ("Gross weight", True), ("box", False), ("szerokość", False)])
def test_package_fields(spark, field, package):
    assert one(spark, text.is_package(F.lit(field))) is package


@pytest.mark.parametrize(("tab", "core"), [("WojcikStock", "wojcik"), ("HalmarProductsV2", "halmar"), ("BRWlogisticsOurs", "brw"), ("Stock", ""), ("Nowe Meble", "nowe meble")])
def test_tab_endings(spark, tab, core):
    assert one(spark, text.producer_core(F.lit(tab))) == core


def test_producers_of_tabs(spark):
    tabs = frame(spark, "tab string", ("BlackRedWhiteStock",), ("Hal",), ("xStock",), ("Signal Meble",), ("Ab1Products",))
    producers = frame(spark, "producer string", ("Black Red White",), ("Halmar",), ("Signal",), ("Signal Meble Sp",), ("Ab",))
    assert dict(map(tuple, feeds.producer_of_tab(tabs, producers).collect())) == {"BlackRedWhiteStock": "Black Red White", "Hal": "Halmar", "xStock": None, "Signal Meble": "Signal", "Ab1Products": "Ab"}


@pytest.mark.parametrize(("field", "target", "scale"), [("Szer mm", "Szerokość", 0.1), ("width_mm", "Wysokość", 0.1), ("dł. (m)", "Głębokość", 100.0), ("waga gr", "Waga", 0.001), ("weight [g]", "Waga", 0.001), ("waga mm", "Waga", None), ("szer g", "Szerokość", None), ("opis » wymiar mm", "Szerokość", None), ("gramatura", "Waga", None)])
def test_scales_of_names(spark, field, target, scale):
    assert one(spark, text.scale_from_field(F.lit(field), feeds.allowed_scales(F.lit(target)))) == scale


def test_scales_are_those_of_the_attribute(spark):
    rows = [("S", a, 0.12, 120.0) for a in ("Waga", "Szerokość")] * 6 + [("S", "Waga", 5000.0, 5.0)] * 30
    got = {r.attr: r.scale for r in feeds.scales(frame(spark, "source string, attr string, theirs double, ours double", *rows)).collect()}
    assert got == {"Waga": 0.001}  # a width is never 1000 times another's


def test_cut_off_products_are_left_alone(spark):
    components, raw = frame(spark, CELL, ("1", "Styl", "loft"), ("2", "Styl", "loft"), ("3", "Waga", "5"), ("4", "Waga", "5")), frame(spark, CELL, ("3", "Waga", "6"), ("4", "Waga", "6"))
    panel, off = frame(spark, "attr string, status string", ("Styl", "ACTIVE"), ("Waga", "ACTIVE")), frame(spark, "id string", ("2",), ("4",))
    assert [r.id for r in detect.moved_components(components, raw, panel, off).collect()] == ["1"] and [r.id for r in detect.component_conflicts(components, raw, panel, off).collect()] == ["3"]
    assert detect.moved_components(components, raw, panel).count() == detect.component_conflicts(components, raw, panel).count() == 2


def test_groups_and_other_categories(spark):
    p = frame(spark, "id string, name string, producer string, collection string, category string", *((str(k), "Szafa Ola 120", "P", "C", "szafa" if k < 20 else "usluga") for k in range(40)))
    raw = frame(spark, CELL, *((str(k), "Waga", "5") for k in range(40) if k not in (3, 25)), *((str(k), "Materiał", "mdf" if k == 7 else "drewno") for k in range(40)))
    other = frame(spark, "category string", ("usluga",))
    missing = detect.missing_required(p, raw, detect.coverage(p, raw), 0.9, other).collect()
    assert [(r.id, r.severity, r.grp) for r in missing] == [("3", "krytyczna", "L1-BRAK-WYMAGANEGO|szafa|Waga")]
    family = detect.family_outliers(p, raw).collect()
    assert [(r.id, r.grp) for r in family] == [("7", "L2-RODZINA|Materiał|szafa ola")]
    assert detect.family_outliers(p.withColumn("name", F.lit("120 cm")), raw).count() == 0  # no base name
    ranges = frame(spark, "category string, attr string, n long, median double, p1 double, p99 double, low double, high double", ("szafa", "Waga", 40, 50.0, 40.0, 60.0, 30.0, 70.0), ("usluga", "Waga", 40, 50.0, 40.0, 60.0, 30.0, 70.0))
    rows = frame(spark, "id string, category string, attr string, num double", ("1", "szafa", "Waga", 500.0), ("2", "szafa", "Waga", 80.0), ("3", "usluga", "Waga", 500.0))
    found = detect.out_of_range(detect.with_range(rows, ranges, frame(spark, "category string, parent string")), other).collect()
    assert sorted((r.id, r.grp) for r in found) == [("1", "L2-SKALA|Waga|÷10"), ("2", "L2-OUTLIER|szafa|Waga")]


def test_visible_attributes_and_their_photos(spark):
    assert len(review.VISIBLE) == 21 and "Z pojemnikiem" in review.VISIBLE and "Kolor" not in review.VISIBLE and "Waga" not in review.VISIBLE
    gallery = frame(spark, "id string, pos int, label string, url string", ("1", 0, "Aranżacja", "a"), ("1", 1, "Przekrój", "b"), ("1", 2, "Otwarty - front", "c"), ("2", 0, "Tyłem", "d"), ("2", 1, "Zamknięty - front", "e"))
    cells = frame(spark, "id string, attr string", *((i, a) for i in "12" for a in ("Liczba półek", "Rodzaj frontu", "Szerokość")))
    got = {(r.id, r.attr): r.url for r in photos.best_photo_of(cells, gallery).collect()}
    assert got == {("1", "Liczba półek"): "c", ("1", "Rodzaj frontu"): "a", ("1", "Szerokość"): "a", ("2", "Rodzaj frontu"): "e", ("2", "Szerokość"): "d"}


@pytest.mark.parametrize("header", ["atrybuty-skladowe", "Atrybuty-Składowe", "atrybuty skladowe", "atrybuty z zakladki", "atrybuty z zakładki", "atrybuty skladowych"])
def test_component_headers(header):
    assert readers.resolve(["ID", header])["components"] == header


def test_naming_attributes_of_xml(spark):
    xml = "<s><o><a klucz='K'>1</a><a kod='D'>2</a><a id='I'>3</a><a label='L'>4</a><a title='T'>5</a></o><o/></s>"
    got = {(r.field, r.value) for r in readers.xml_records(frame(spark, "source string, xml string", ("s", xml)), "o").collect()}
    assert got == {("a:K", "1"), ("a:D", "2"), ("a:I", "3"), ("a", "4"), ("a@label", "L"), ("a[2]", "5"), ("a[2]@title", "T")}


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("this is a test", "this is a new test!!!", 85.5), ("new york jets", "New York Jets", 76.923077), ("new york jets", "New York Giants", 64.285714), ("new york jets", "new york giants", 78.571429), ("cowboys", "Dallas Cowboys", 83.076923), ("cowboys", "dallas cowboys", 90.0), ("this is a test", "this is a test", 100.0), ("", "x", 0.0)],
)
def test_similarity_equals_published_scores(a, b, score):
    assert fuzzy.similarity(a, b) == pytest.approx(score, abs=1e-5)
