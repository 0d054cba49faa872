"""Column functions on names and attribute values. All are built of native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polish letters and their plain forms; number words in compounds; stems of countable parts.
ACCENTED, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
NUMBER_WORDS = {"jedno": 1, "dwu": 2, "trzy": 3, "cztero": 4, "piecio": 5, "szescio": 6}
PART_STEMS = {"doors": "drzwiow", "drawers": "szuflad", "shelves": "polk", "rods": "drazk"}
MOST_PARTS = 20
BASIC_DIMENSIONS = ("Szerokość", "Wysokość", "Głębokość")
PACKAGE_WORDS = ("package", "pack", "paczk", "karton", "opakow", "shipping", "wysylk", "gros", "brutto")
PHOTO_KINDS = (
    ("interior", ("otwarty - front", "wnetrze szafy - bez drzwi", "otwarty", "wnetrze", "prezentacja schowka", "przekroj", "schemat / przekroj mebla")),
    ("drawing", ("rysunek techniczny", "schemat/infografika", "schemat / przekroj mebla", "rysunek techniczny (szkic bez wymiarow)")),
    ("front", ("zamkniety - front", "zamkniety", "zamkniety - widok pod katem (front)", "widok z boku", "tylem")),
    ("arrangement", ("aranzacja", "prezentacja zestawu", "szczegoly")),
)
TAB_SUFFIXES = r"(?i)(stock|products?|logistics|fromimporter|ours|v\d+)+$"
FIELD_UNITS = (("mm", 0.1), ("m", 100.0), ("g|gr", 0.001))
PART_LETTERS = {"doors": "d", "drawers": "s"}
PART_PHRASES = {"doors": [("bez drzwi", 0)], "drawers": [("z szuflad(?:a|ka)", 1), ("bez szuflad", 0)]}
SOME_DRAWERS = "z szuflad(?:ami)?"
# Units of numbers, and those of sizes in names.
NUMBER_UNITS = ("cm", "mm", "m", "kg", "g")
NAME_UNITS = ("cm", "mm", "kg")
#: A number with a unit or none; a chain of whatever numbers with crosses between; sizes, measures and longer numbers in a normal form.
NUMBER = rf"(?i)^(-?\d+(?:[.,]\d+)?)\s*(?:{'|'.join(NUMBER_UNITS)})?$"
CROSS = "[x×]"
CROSSED = rf"[\d.,]+(?:\s*{CROSS}\s*[\d.,]+)+"
MEASURED = rf"(?<![\d.,])\d{{2,3}}(?: ?x ?\d{{2,3}}){{1,2}}(?![\d.,])|\b\d+ ?(?:{'|'.join(NAME_UNITS)})\b|\b\d{{2,}}\b"
#: What feeds' names are not compared by: a model code of few letters and digits, and a number with or without a unit right behind it.
CODE_WORD, NUMBER_WORD = r"[a-z]{1,3}\d{1,4}[a-z]?", rf"\d+(?:[.,]\d+)?(?:{'|'.join(NAME_UNITS)})?"
DIAMETER = r"(?iu)(?:ś|s)r\.?\s*(\d{2,3})|(?:fi|ø)\s*(\d{2,3})"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ODD = {" ": " ", " ": " ", " ": " ", "²": "2", "³": "3", "¹": "1"}


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def norm(c: Column) -> Column:
    """For comparison: compatible forms, no accents, lower case, other signs as spaces, single spaces."""
    plain = F.translate(F.coalesce(c, F.lit("")), _WIDE + "".join(_ODD), "".join(chr(x) for x in range(0x21, 0x7F)) + "".join(_ODD.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(plain)), r"(?U)[^\w\s./x-]", " "), r"(?U)\s+", " "))


def number(c: Column) -> Column:
    """'46,5' and '120 cm' as numbers; more than one separator, or anything else, is null."""
    read = F.regexp_extract(F.trim(F.replace(c, F.lit("\u00a0"), F.lit(" "))), NUMBER, 1)
    return F.nullif(F.replace(read, F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def number_text(x: Column) -> Column:
    """46.0 as 46, else six significant digits."""
    digits = F.lit(5) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4))))
    scaled = F.bround(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(scaled.cast("decimal(38,10)").cast("string"), r"\.?0+$", ""))


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def dimensions(name: Column) -> Column:
    """Struct a, b, c, diameter of what a name says; null where it says nothing.

    Whatever stands between crosses is taken apart; the first two neighbours of two or three digits are a size, and a
    third one after them belongs to it.
    """
    n = F.coalesce(name, F.lit(""))
    side = lambda x: F.when(x.rlike(r"^\d{2,3}$"), x.try_cast("double"))
    sides = F.transform(F.regexp_extract_all(n, F.lit(CROSSED), F.lit(0)), lambda chain: F.transform(F.split(chain, f"\\s*{CROSS}\\s*"), side))
    starts = lambda own: F.transform(own, lambda x, i: F.struct(x.alias("a"), F.get(own, i + 1).alias("b"), F.get(own, i + 2).alias("c")))
    first = F.get(F.filter(F.flatten(F.transform(sides, starts)), lambda s: s["a"].isNotNull() & s["b"].isNotNull()), F.lit(0))
    return F.struct(*(first[k].alias(k) for k in "abc"), F.coalesce(_group(n, DIAMETER, 1), _group(n, DIAMETER, 2)).try_cast("double").alias("diameter"))


def part_counts(name: Column) -> Column:
    """Struct doors, drawers, shelves, rods (ints) and has_drawers (true if there are some, of unknown number).

    Of each part the surest sign counts: a number before its stem, a number word joined to it, a phrase, a letter code.
    """
    n = norm(name)
    few = lambda digits: F.when(digits.try_cast("int") <= MOST_PARTS, digits.try_cast("int"))
    codes = F.filter(F.split(n, " "), lambda t: t.rlike(r"^(\d+[dws])+$") & F.regexp_replace(t, r"\d", "").isin("d", "w", "s", "dw", "ds", "ws", "dws"))
    coded = lambda letter: F.get(F.array_compact(F.transform(codes, lambda t: few(_group(t, rf"(\d+){letter}", 1)))), F.lit(0))
    said = {part: F.coalesce(few(_group(n, rf"(\d+) ?-? ?{stem}", 1)), *(F.when(n.contains(word + stem), F.lit(k)) for word, k in NUMBER_WORDS.items())) for part, stem in PART_STEMS.items()}
    phrases = {part: [F.when(n.rlike(rf"\b{phrase}\b"), F.lit(k)) for phrase, k in told] for part, told in PART_PHRASES.items()}
    counts = {part: F.coalesce(said[part], *phrases.get(part, ()), *([coded(PART_LETTERS[part])] if part in PART_LETTERS else ())) for part in PART_STEMS}
    one, several = (n.rlike(rf"\b{phrase}\b") for phrase in (PART_PHRASES["drawers"][0][0], SOME_DRAWERS))
    return F.struct(*(counts[part].alias(part) for part in PART_STEMS), (said["drawers"].isNull() & several & ~one).alias("has_drawers"))


def base_name(name: Column) -> Column:
    """A family's name: no dimensions, measures or numbers of two digits and more."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm(name), MEASURED, " "), r"\s+", " "))


def members(c: Column, separators: str = ",") -> Column:
    """Trimmed, non-empty parts of a value."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")


def packed(c: Column) -> Column:
    """'Key: value | Key: value' as an array of (key, value); pieces without ':' or key are left out, the last of a key counts."""
    pieces = F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda p: p.contains(":"))
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value")))
    pairs = F.filter(pairs, lambda e: e["key"] != "")
    keys = F.transform(pairs, lambda e: e["key"])
    return F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))


def value_hash(c: Column) -> Column:
    """Twelve hex digits; null and empty are alike."""
    return F.substring(F.sha1(F.coalesce(c, F.lit("")).cast("binary")), 1, 12)


def question_hash(url: Column, question: Column, value: Column, model: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (url, question, value, model))).cast("binary")), 1, 16)


def count_in_label(c: Column) -> Column:
    """The count a label stands for: 0 for 'bez…', its leading digits, or those of '… i więcej'."""
    n = norm(c)
    return F.when(n == "", None).when(n.startswith("bez"), 0).otherwise(F.coalesce(_group(n, r"^(\d+)", 1).try_cast("int"), F.when(n.contains("i wiecej"), _group(n, r"(\d+)", 1).try_cast("int"))))


def size_pair(c: Column) -> Column:
    """(short, long) of '90x200' or of several equal sizes; null if they differ or one can't be read."""
    read = F.transform(members(c, ",;|"), lambda p: F.struct(_group(p, r"(\d{2,3})\s*[x×]\s*(\d{2,3})", 1).try_cast("int").alias("a"), _group(p, r"(\d{2,3})\s*[x×]\s*(\d{2,3})", 2).try_cast("int").alias("b")))
    sizes = F.array_distinct(F.transform(read, lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), F.struct(F.least(s["a"], s["b"]).alias("short"), F.greatest(s["a"], s["b"]).alias("long")))))
    return F.when((F.size(sizes) == 1), F.get(sizes, F.lit(0)))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(norm(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def stems(c: Column, size: int = 5) -> Column:
    """Distinct word beginnings."""
    return F.array_distinct(F.transform(F.filter(F.split(norm(c), " "), lambda w: w != ""), lambda w: F.substring(w, 1, size)))


def same_value(a: Column, b: Column) -> Column:
    """Equal for a human: same normal form, same number, or same set of members. Of two numbers only the numbers count."""
    x, y = number(a), number(b)
    own = lambda c: F.array_sort(F.array_distinct(F.transform(members(c), norm)))
    lists = (F.size(own(a)) > 0) & (own(a) == own(b))
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise((norm(a) == norm(b)) | lists)


def difference(a: Column, b: Column) -> Column:
    """Struct kind, severity, confidence of two values that differ."""
    x, y = number(a), number(b)
    p, q = (F.array_distinct(F.transform(members(c), norm)) for c in (a, b))
    more, less = F.size(F.array_except(p, q)), F.size(F.array_except(q, p))
    kind = lambda k, s, c: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    numbers = F.when(x == y, kind("same number", "info", 0.95)).when(F.abs(x - y) <= 1.0, kind("rounding", "info", 0.6)).otherwise(kind("different numbers", "krytyczna", 0.5))
    lists = F.when((more == 0) & (less == 0), kind("same list", "info", 0.95)).when(less == 0, kind("more members", "srednia", 0.6)).when(more == 0, kind("fewer members", "srednia", 0.6)).otherwise(kind("different values", "krytyczna", 0.5))
    return F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(lists)


def described_fields(text: Column) -> Column:
    """(field, value) rows mined from a description: up to three measures in cm, and 'name: value' pairs."""
    measure = r"(?iu)wymiar\p{L}*\s*:?\s*(\d+(?:[.,]\d+)?)\s*[/x×]\s*(\d+(?:[.,]\d+)?)(?:\s*[/x×]\s*(\d+(?:[.,]\d+)?))?\s*(cm|mm)"
    unit = F.when(F.lower(F.regexp_extract(text, measure, 4)) == "mm", 10.0).otherwise(1.0)
    sizes = [F.struct(F.lit(f"wymiar {k}").alias("field"), number_text(number(_group(text, measure, k)) / unit).alias("value")) for k in (1, 2, 3)]
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"(?u)([\p{L} ]+:[^:]*?)(?=,\s*[\p{L} ]+:|$)"), F.lit(1)), lambda p: F.struct(F.trim(F.regexp_replace(F.substring_index(p, ":", 1), r"^[, ]+", "")).alias("field"), F.trim(F.substring_index(p, ":", -1)).alias("value")))
    named = F.filter(pairs, lambda p: (p["field"] != "") & (p["value"] != "") & ~p["field"].rlike("(?i)^wymiar"))
    rows = F.concat(F.filter(F.array(*sizes), lambda s: s["value"].isNotNull()), named)
    return F.when((F.length(text) >= 12) & text.contains(":"), rows).otherwise(F.filter(rows, lambda s: F.lit(False)))


def comparable_name(name: Column, collection: Column) -> Column:
    """A name to compare feeds by: without model codes, plain numbers and the words of the collection; other words stay, repeated ones too."""
    bare = F.regexp_replace(norm(name), rf"\b(?:{CODE_WORD}|{NUMBER_WORD})\b", " ")
    own = F.filter(F.split(F.coalesce(norm(collection), F.lit("")), " "), lambda w: w != "")
    any_of = F.concat(F.lit(r"\b(?:"), F.array_join(F.transform(own, lambda w: F.replace(w, F.lit("."), F.lit(r"\."))), "|"), F.lit(r")\b"))
    left = F.when(F.size(own) > 0, F.regexp_replace(bare, any_of, F.lit(" "))).otherwise(bare)
    return F.trim(F.regexp_replace(left, r"\s+", " "))


def product_keys(name: Column, product_id: Column, codes: Column) -> Column:
    """Candidate keys: the id, codes of three signs and more, and words of the name, in capitals, of four signs and more with a digit."""
    tokens = F.filter(F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit(r"(?U)\b([A-Z0-9][A-Z0-9/-]{3,})\b"), F.lit(1)), lambda t: t.rlike(r"\d"))
    long = F.transform(F.filter(codes, lambda c: F.length(F.trim(c)) >= 3), norm)
    return F.array_distinct(F.filter(F.concat(F.array(norm(product_id)), long, F.transform(tokens, norm)), lambda k: k != ""))


def unit_factor(a: Column, b: Column, tolerance: Column | float) -> Column:
    """Whether two numbers are equal up to a factor of 10, 100 or 1000, either way."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    close = lambda x, y: F.abs(x - y) <= tol * F.abs(y)
    return F.exists(F.array(F.lit(10.0), F.lit(100.0), F.lit(1000.0)), lambda f: close(a * f, b) | close(a, b * f))


def scale_from_field(field: Column, allowed: Column) -> Column:
    """What a field's name says of its unit, of the factors that its attribute allows; a field mined from a description says nothing."""
    n = norm(field)
    said = F.coalesce(*(F.when(n.rlike(f"(^|[^a-z])({unit})([^a-z]|$)") & F.array_contains(allowed, F.lit(scale)), F.lit(scale)) for unit, scale in FIELD_UNITS))
    return F.when(~field.contains("»"), said)


def centimetres(value: Column, unit: Column) -> Column:
    return number_text(F.when(F.lower(F.trim(unit)).isin("mm", "milimetry", "millimetres"), value / 10).when(F.lower(F.trim(unit)) == "m", value * 100).otherwise(value))


def token_cost(prices: dict[str, tuple[float, float]], model: Column, tokens_in: Column, tokens_out: Column, default: str) -> Column:
    """USD; prices are for a million tokens in and out; unknown models cost as the default one."""
    price = lambda k: F.coalesce(*(F.when(model == m, F.lit(p[k])) for m, p in prices.items()), F.lit(prices[default][k]))
    return (tokens_in * price(0) + tokens_out * price(1)) / 1e6


def completeness(attributes: Column) -> Column:
    """Class of a map of attributes: empty, sparse (under three), without dimensions, ok."""
    keys = F.map_keys(F.map_filter(attributes, lambda k, v: F.trim(v) != ""))
    return F.when(F.size(keys) == 0, "pusty").when(F.size(keys) < 3, "szczatkowy").when(~F.arrays_overlap(keys, F.array(*map(F.lit, BASIC_DIMENSIONS))), "bez_wymiarow").otherwise("ok")


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def identifier(c: Column) -> Column:
    """'2022.0' as '2022'."""
    x = F.trim(c).try_cast("double")
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.trim(c))


def deep_link(template: str, product_id: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{id}"), product_id)


def family_probability(agree: Column, known: Column, equipment: Column) -> Column:
    """Smoothed share of a family that agrees, at most 0.95, or 0.80 for equipment."""
    return F.round(F.least(F.when(equipment, 0.80).otherwise(0.95), (agree + 1) / (known + 2)), 3)


def is_package(field: Column) -> Column:
    return norm(field).rlike("|".join(PACKAGE_WORDS))


def photo_place(label: Column, kind: str) -> Column:
    """Which of its kind's patterns a label has; the number of them if none."""
    patterns = dict(PHOTO_KINDS)[kind]
    return F.coalesce(*(F.when(norm(label).contains(w), F.lit(i)) for i, w in enumerate(patterns)), F.lit(len(patterns)))


def photo_kind(label: Column) -> Column:
    n = norm(label)
    return F.coalesce(*(F.when(n.contains(w), k) for k, words in PHOTO_KINDS for w in words), F.lit("other"))


def gallery(c: Column) -> Column:
    """'Label: URL | Label: URL' as an array of (label, url)."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x))
    pairs = F.transform(pieces, lambda p: F.struct(F.trim(F.regexp_replace(F.regexp_replace(p, r"https?://.*$", ""), r":\s*$", "")).alias("label"), _group(p, r"(https?://\S+)", 1).alias("url")))
    return F.filter(pairs, lambda p: p["url"].isNotNull())


def producer_core(title: Column) -> Column:
    """A tab's title without the words at its end that say what the tab is."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), TAB_SUFFIXES, ""))


def verdict(c: Column) -> Column:
    return F.when(c.isin("zgodne", "niezgodne", "nie_widac"), c).otherwise("nie_widac")


def yes_no(c: Column, yes: tuple[str, ...] = ("tak", "1", "true", "yes"), no: tuple[str, ...] = ("nie", "0", "false", "no")) -> Column:
    n = norm(c)
    return F.when(n.isin(*yes), "tak").when(n.isin(*no), "nie")


def producer_code(codes: Column) -> Column:
    """The producer's code out of a map of codes, whatever its spelling."""
    own = F.map_filter(codes, lambda k, v: norm(k) == "kod producenta")
    return F.get(F.map_values(own), F.lit(0))
