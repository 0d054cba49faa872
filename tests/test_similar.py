"""Fuzzy candidates lose no pair, and feeds' names and keys."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import fuzzy, text
from shelfwise.operators import dictionary, feeds, similar

STEMS = "szafa komoda kredens stolik regal lozko biurko witryna polka narozna biala czarna dab sonoma wiszaca mala duza tv loft z s xl alfa rimini".split()


def names(seed, n, stems=STEMS):
    rng = random.Random(seed)

    def word():
        w = list(rng.choice(stems))
        for _ in range(rng.choice((0, 0, 1, 2))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice("abcdeiknorstz")], [w[k], rng.choice("aeo")]))
            w = w or ["q"]
        return "".join(w)

    return sorted({" ".join(word() for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 5, 7)))) for _ in range(n)})


@pytest.mark.parametrize("least", [70.0, 78.0, 82.0, 88.0])
def test_candidates_lose_no_pair(spark, least):
    ours, theirs = names(1, 60), names(2, 60)
    a, b = (spark.createDataFrame([("block", x) for x in rows], f"k string, {c} string") for rows, c in ((ours, "a"), (theirs, "b")))
    got = {(r.a, r.b): r.score for r in similar.scored(a, b, ["k"], "a", "b", least, 0).collect()}
    assert {(r.a, r.b): r.score for r in similar.scored(a, b, ["k"], "a", "b", least).collect()} == got
    assert got == {(x, y): s for x in ours for y in theirs if (s := fuzzy.similarity(x, y)) >= least}


def test_candidates_are_few_among_names_that_differ(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdefghijklmnoprstuwz") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    ours, theirs = names(3, 250, stems), names(4, 250, stems)
    a, b = (spark.createDataFrame([(x,) for x in rows], f"{c} string").withColumn("k", F.lit("block")) for rows, c in ((ours, "a"), (theirs, "b")))
    assert similar.candidates(a, b, ["k"], "a", "b", 78.0, 0).count() < len(ours) * len(theirs) / 10
    assert similar.candidates(a.limit(0), b, ["k"], "a", "b", 78.0).count() == 0
    blank = spark.createDataFrame([("block", ""), ("block", None), (None, "szafa")], "k string, a string")
    assert similar.candidates(blank, b, ["k"], "a", "b", 78.0).count() == 0


def test_dictionary_matches_as_all_pairs_do(spark):
    labels = [x for x in names(5, 60) if len(x) > 2]
    values = names(6, 80)
    words = spark.createDataFrame([("A", k, x) for k, x in enumerate(labels)], "attr string, pos int, label string")
    got = {r.value: (r.how, r.label, r.score) for r in dictionary.match(spark.createDataFrame([("A", v) for v in values], "attr string, value string"), words, spark.createDataFrame([], "attr string, alias string, label string")).collect()}
    for v in values:
        score, pos = max((fuzzy.similarity(v, x), -k) for k, x in enumerate(labels))
        how = "exact" if v in labels else "fuzzy" if score >= dictionary.AUTO else "near" if score >= dictionary.SUGGEST else "outside"
        assert got[v] == (how, labels[-pos] if how != "outside" else None, score if how in ("fuzzy", "near") else None), v


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "collection", "expected"),
    [
        ("Komoda 2d1w3s 80 cm ab12x szafa szafa 120x80", None, "komoda 2d1w3s cm szafa szafa 120x80"),
        ("Rimini RI01 Kredens", "Rimini", "kredens"),
        ("Szafa 100cm 2,5 kg abcd12", "", "szafa kg abcd12"),
        ("Stolik Nowy. Dom 12 dom", "Nowy. Dom", "stolik nowy."),
        (None, "x", ""),
    ],
)
def test_names_for_comparison(spark, name, collection, expected):
    assert one(spark, text.comparable_name(F.col("name"), F.col("collection")), name=name, collection=collection) == expected


@pytest.mark.parametrize(("name", "expected"), [("Szafa ab12x", {"ab12x"}), ("Stół 202245 AB-1/2", {"202245", "ab-1/2"}), ("AB12.X4567", {"ab12", "x4567"}), ("szafa abcdef 123", set()), (None, set())])
def test_product_keys(spark, name, expected):
    got = one(spark, text.product_keys(F.col("name"), F.col("id"), F.col("codes")), name=name, id="P 1", codes=["x9", " K7Z ", None])
    assert set(got) == {"p 1", "k7z"} | expected


def test_sources_of_one_producer(spark):
    products = spark.createDataFrame([("1", "A", "Szafa duża", "K"), ("2", "B", "Szafa duża", "K")], "id string, producer string, name string, collection string")
    keys = spark.createDataFrame([("1", "code"), ("2", "code")], "id string, key string")
    items = spark.createDataFrame([("s", "code", "A", "Szafa", "K"), ("t", "code", "A", "Szafa", "K")], "source string, key string, producer string, name string, collection string")
    sources = spark.createDataFrame([("s", "A"), ("t", None)], "source string, producer string")
    found = {(r.source, r.id) for r in feeds.match_all(products, keys, items, sources).collect()}
    assert found == {("s", "1"), ("t", "1"), ("t", "2")}


def test_sources_without_key_take_their_names(spark):
    long = spark.createDataFrame([("s", 0, "Nazwa", "Szafa A"), ("s", 0, "x", "1"), ("t", 0, "kod", "K1"), ("t", 0, "Nazwa", "n")], "source string, rec long, field string, value string")
    mapping = spark.createDataFrame([("s", "Nazwa", "nazwa"), ("t", "Nazwa", "nazwa")], "source string, field string, target string")
    assert {(r.source, r.key) for r in feeds.load(long, mapping, spark.createDataFrame([("t", "kod")], "source string, field string")).collect()} == {("s", "szafa a"), ("t", "k1")}
