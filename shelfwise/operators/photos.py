"""Photo verdicts as tables: who is asked, with which photo, what is reused, what was read. The model's call is an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators.review import AUTO_CONFIDENCE, VISIBLE, latest

# Kinds of photos an attribute is looked for on, and the usual length of a call.
PREFERRED = ("front", "arrangement", "drawing", "interior", "other")
KINDS_OF = {
    "Liczba szuflad": ("interior", "front", "drawing"), "Liczba półek": ("interior",), "Liczba drążków": ("interior",), "Liczba szafek": ("front", "interior", "drawing"),
    "Liczba drzwi": ("front", "interior"), "Rodzaj drzwi": ("front", "interior"), "Rodzaj frontu": ("front",), "Podparcie": ("front", "drawing"), "Na nóżkach": ("front", "drawing"),
    "Z pojemnikiem": ("interior",), "Materiał": ("front", "arrangement"), "Dekoracje": ("front", "arrangement"), "Styl": ("arrangement", "front"), "Oświetlenie": ("interior", "front"),
    "Kształt blatu": ("front", "drawing", "arrangement"), "Tapicerowane": ("front", "arrangement"), "Zagłówek": ("front", "arrangement"), "Podłokietniki": ("front", "arrangement"),
    "Szerokość": ("drawing",), "Wysokość": ("drawing",), "Głębokość": ("drawing",),
}
ONLY_INTERIOR = ("Liczba półek", "Liczba drążków", "Z pojemnikiem")
MEAN_TOKENS, LEAST_CALLS = (1520, 70), 20


def candidates(findings: DataFrame, products: DataFrame, verdicts: DataFrame, attr: str | None = None, producer: str | None = None, seed: int = 0, limit: int | None = None, visible: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Unsure, visible, with a photo and not asked yet: a row for each (id, attr), in an order drawn by the seed."""
    rows = findings.where((F.col("confidence") < AUTO_CONFIDENCE) & F.col("attr").isin(*visible))
    rows = rows.where(F.col("attr") == attr) if attr else rows
    own = products.where("photo <> ''")
    own = own.where(F.col("producer") == producer) if producer else own
    asked = verdicts.where("verdict <> 'blad'").select("id", "attr").distinct()
    out = rows.join(own.select("id", "photo", "producer"), "id").join(asked, ["id", "attr"], "left_anti").groupBy("id", "attr").agg(F.min("photo").alias("photo"), F.min("producer").alias("producer"))
    return out.orderBy(F.xxhash64("id", "attr", F.lit(seed)), "id", "attr").limit(limit) if limit else out


def gap_candidates(findings: DataFrame, galleries: DataFrame, excluded: DataFrame, interior: tuple[str, ...] = (), repeat: bool = False) -> DataFrame:
    """Open gaps that a photo could fill; some attributes need one of the inside."""
    rules = ["L1-LUKA-BRAK"] + ["L2-LUKA-ZDJECIE"] * repeat
    kinds = galleries.groupBy("id").agg(F.bool_or(text.photo_kind(F.col("label")) == "interior").alias("inside"))
    rows = findings.where(F.col("rule_id").isin(*rules)).select("id", "attr").distinct().join(F.broadcast(excluded), "attr", "left_anti").join(kinds, "id")
    return rows.where(F.col("inside") | ~F.col("attr").isin(*interior)) if interior else rows


def best_photo(galleries: DataFrame, order: tuple[str, ...] = PREFERRED) -> DataFrame:
    """galleries (id, pos, label, url) → the photo of each product: by kind, then by place."""
    rank = F.array_position(F.array(*map(F.lit, order)), text.photo_kind(F.col("label")))
    return galleries.groupBy("id").agg(F.min_by("url", F.struct(rank, F.col("pos"))).alias("url"))


def best_photo_of(cells: DataFrame, galleries: DataFrame) -> DataFrame:
    """cells (id, attr) → the photo to ask about each: by the attribute's kinds, then the label's place in its kind, else the first photo.

    Attributes that only the inside shows have none without a photo of it.
    """
    place = F.coalesce(*(F.when(F.col("kind") == k, text.photo_place(F.col("label"), k)) for k, _ in text.PHOTO_KINDS), F.lit(0))
    shown = galleries.withColumn("kind", text.photo_kind(F.col("label"))).withColumn("place", place)
    order = F.coalesce(*(F.when(F.col("attr") == a, F.array(*map(F.lit, kinds))) for a, kinds in KINDS_OF.items()), F.array().cast("array<string>"))
    rank = F.nullif(F.array_position(order, F.col("kind")), F.lit(0))
    best = F.min_by("url", F.struct(F.coalesce(rank, F.lit(99)), F.when(rank.isNull(), 0).otherwise(F.col("place")), F.col("pos")))
    out = cells.join(shown, "id").groupBy("id", "attr").agg(best.alias("url"), F.bool_or(F.col("kind") == "interior").alias("inside"))
    return out.where(F.col("inside") | ~F.col("attr").isin(*ONLY_INTERIOR)).select("id", "attr", "url")


def extra_photos(galleries: DataFrame, main: DataFrame, most: int = 2) -> DataFrame:
    """Up to `most` others, one of each kind, none twice."""
    rows = galleries.join(main.withColumnRenamed("url", "main"), "id").where("url <> main").groupBy("id", "url", "main").agg(F.min_by(F.struct("pos", "label"), F.struct("pos", "label")).alias("x")).select("id", "url", "main", "x.*").withColumn("kind", text.photo_kind(F.col("label")))
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "kind").orderBy("pos", "url"))).where("k = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("pos", "url"))).where(F.col("k") <= most).select("id", "k", "kind", "url")


def photo_kinds(galleries: DataFrame) -> DataFrame:
    return galleries.groupBy(text.photo_kind(F.col("label")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("products"))


def reuse(requests: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(answered from the cache, still to ask). requests (id, attr, url, question, value); cache (hash, answer)."""
    own = requests.withColumn("hash", text.question_hash(F.col("url"), F.col("question"), F.col("value"), F.lit(model)))
    return own.join(cache.dropDuplicates(["hash"]), "hash"), own.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def latest_reads(verdicts: DataFrame) -> DataFrame:
    """The newest reading of each cell that isn't an error, if it disagrees with the shop and says something."""
    last = latest(verdicts.where("verdict <> 'blad'"), ("id", "attr"), ("seq",))
    return last.where("verdict = 'niezgodne' and trim(coalesce(read, '')) <> ''").select("id", "attr", "read", "confidence")


def rewrite_gaps(findings: DataFrame, reads: DataFrame, labels: DataFrame) -> DataFrame:
    """Gaps with a reading become proposals; photo proposals without one become gaps again. changed tells which."""
    spelled = labels.select("attr", text.norm(F.col("label")).alias("n"), "label").groupBy("attr", "n").agg(F.min("label").alias("label"))
    known = reads.withColumn("n", text.norm(F.col("read"))).join(spelled, ["attr", "n"]).select("id", "attr", "label", F.least("confidence", F.lit(0.80)).alias("sure"))
    rows = findings.where("rule_id in ('L1-LUKA-BRAK', 'L2-LUKA-ZDJECIE')").join(known, ["id", "attr"], "left")
    rule = F.when(F.col("label").isNotNull(), "L2-LUKA-ZDJECIE").otherwise("L1-LUKA-BRAK")
    changed = (F.col("rule_id") != rule) | ~F.col("new_value").eqNullSafe(F.col("label"))
    return rows.select("id", "attr", rule.alias("rule_id"), F.col("label").alias("new_value"), F.coalesce("sure", F.lit(1.0)).alias("confidence"), changed.alias("changed"))


def estimate(verdicts: DataFrame, n: DataFrame, prices: dict, model: str, default: str) -> DataFrame:
    """n: one row (n) of candidates. Tokens a call as in history, or the usual ones while history is short."""
    past = verdicts.where("tokens_in > 0").agg(F.count("*").alias("calls"), F.avg("tokens_in").alias("mean_in"), F.avg("tokens_out").alias("mean_out"))
    short = F.col("calls") < LEAST_CALLS
    both = past.unionByName(n, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("calls", "mean_in", "mean_out", "n")))
    mean_in, mean_out = F.when(short, float(MEAN_TOKENS[0])).otherwise(F.col("mean_in")), F.when(short, float(MEAN_TOKENS[1])).otherwise(F.col("mean_out"))
    return both.select("calls", "n", F.round(F.col("n") * text.token_cost(prices, F.lit(model), mean_in, mean_out, default), 6).alias("usd"))


def statistics(verdicts: DataFrame, prices: dict, default: str) -> DataFrame:
    return verdicts.groupBy("verdict", "attr").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "niezgodne").alias("disagree"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum(text.token_cost(prices, F.col("model"), F.col("tokens_in"), F.col("tokens_out"), default)), 6).alias("usd"))


def calibration_sheet(verdicts: DataFrame, products: DataFrame) -> DataFrame:
    return verdicts.where("verdict <> 'blad'").join(products.select("id", "name"), "id").select("attr", "verdict", "id", "name", "read", F.lit(None).cast("string").alias("rating")).orderBy("attr", "verdict", "id")


def calibration(sheet: DataFrame) -> DataFrame:
    """Accuracy overall, by attribute and by verdict; ratings are ok or zle."""
    ok, bad = F.count_if(F.col("rating") == "ok"), F.count_if(F.col("rating") == "zle")
    part = lambda kind, c: sheet.groupBy(F.lit(kind).alias("kind"), c.alias("value")).agg(ok.alias("ok"), bad.alias("bad"), F.count_if(F.col("rating").isNull()).alias("unrated"), F.round(ok / F.nullif(ok + bad, F.lit(0)), 3).alias("accuracy"))
    return part("all", F.lit("all")).unionByName(part("attr", F.col("attr"))).unionByName(part("verdict", F.col("verdict")))


def allowed_answers(dictionary: DataFrame, panel: DataFrame) -> DataFrame:
    """Labels of the dictionary, or of the panel where it has none."""
    own = dictionary.groupBy("attr").agg(F.array_sort(F.collect_set("label")).alias("own"))
    theirs = panel.groupBy("attr").agg(F.array_sort(F.collect_set("label")).alias("theirs"))
    return own.join(theirs, "attr", "full").select("attr", F.coalesce("own", "theirs").alias("answers"))


def drawing_sizes(answers: DataFrame, raw: DataFrame) -> DataFrame:
    """answers (id, answer as JSON) → sizes in cm of dimensions that raw lacks."""
    schema = "szerokosc double, wysokosc double, glebokosc double, jednostka string, pewnosc double"
    a = answers.select("id", F.from_json("answer", schema).alias("a"))
    cm = lambda c: text.centimetres(F.col(f"a.{c}"), F.coalesce("a.jednostka", F.lit("cm")))
    rows = a.select("id", F.stack(F.lit(3), F.lit("Szerokość"), cm("szerokosc"), F.lit("Wysokość"), cm("wysokosc"), F.lit("Głębokość"), cm("glebokosc")).alias("attr", "value"), F.col("a.pewnosc").alias("confidence"))
    return rows.where("value is not null").join(raw.select("id", "attr"), ["id", "attr"], "left_anti")


def clean_verdicts(answers: DataFrame) -> DataFrame:
    """Answers as JSON with only known verdicts."""
    a = answers.select("id", F.from_json("answer", "werdykt string, wartosc string, pewnosc double").alias("a"))
    return a.select("id", text.verdict(F.col("a.werdykt")).alias("verdict"), F.coalesce("a.wartosc", F.lit("")).alias("read"), F.coalesce("a.pewnosc", F.lit(0.0)).alias("confidence"))
