"""Column functions on strings: normal forms, names, dates, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_phone(v: Column) -> Column:
    """Digits and x only; without the country code 91 or a leading 0; lower case."""
    d = F.regexp_replace(v, "[^0-9xX]", "")
    cut = F.when((F.length(d) > 10) & d.startswith("91"), F.substring(d, 3, 1 << 20)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 1 << 20)).otherwise(d)
    return F.lower(cut)


def normal_vehicle(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"[\s-]", ""))


def normal_amount(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"[\s,]", ""))


def normal_name(v: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(v, r"\s+", " "))), r"\.+$", "")


def normal(v: Column, kind: Column) -> Column:
    """The comparison form of a value of a kind: phone, vehicle, transaction or any other."""
    return F.when(kind == "phone", normal_phone(v)).when(kind == "vehicle", normal_vehicle(v)).when(kind == "transaction", normal_amount(v)).otherwise(normal_name(v))


def safe_cell(v: Column) -> Column:
    """A cell that no spreadsheet takes for a formula. Place holders are tested before this, so `-` stays one."""
    t = F.trim(v)
    return F.when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def first_filled(*columns: Column) -> Column:
    """The first value that isn't empty or a place holder."""
    blank = lambda c: F.trim(c).isin("", "-", "NA", "N/A", "na", "n/a")
    return F.coalesce(*(F.when(~blank(c), F.trim(c)) for c in columns))


# fixed values: accepted date formats, in order
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss")
#: Other forms, after those.
ISO_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "dd MMM yyyy")


def any_date(v: Column) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(v), F.lit(f)) for f in DATE_FORMATS + ISO_FORMATS))


def day_label(v: Column, anchor: Column) -> Column:
    """`Day 4` or `Day 1-14` as days after the anchor, a year as its first of June."""
    day = F.try_to_number(F.nullif(F.regexp_extract(v, r"(?i)day\s*([0-9]+)", 1), F.lit("")), F.lit("999999")).cast("int")
    year = F.when(v.rlike(r"^\s*[0-9]{4}\s*$"), F.trim(v).cast("int"))
    return F.when(day.isNotNull(), F.date_add(anchor, day - 1)).when(year.isNotNull(), F.make_date(year, F.lit(6), F.lit(1)))


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _matched(a: Column, b: Column) -> Column:
    """Struct (a, b): the positions of the letters of a and b that match in the Jaro sense, greedily from the left."""
    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2) - 1, F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"))

    def step(acc: Column, i: Column) -> Column:
        low, high = F.greatest(F.lit(1), i - reach), F.least(F.length(b), i + reach)
        free = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")), lambda j: (F.substring(b, j, 1) == F.substring(a, i, 1)) & ~F.array_contains(acc["b"], j.cast("int")))
        return F.when(F.size(free) > 0, F.struct(F.concat(acc["a"], F.array(i.cast("int"))).alias("a"), F.concat(acc["b"], F.array(F.get(free, F.lit(0)).cast("int"))).alias("b"))).otherwise(acc)

    places = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity with a window of half the longer length less one; transpositions halved downwards."""
    m = _matched(a, b)
    n = F.size(m["a"])
    in_b = F.array_sort(m["b"])
    moved = F.size(F.filter(F.zip_with(m["a"], in_b, lambda i, j: F.substring(a, i, 1) != F.substring(b, j, 1)), lambda x: x))
    t = F.floor(moved / 2)
    score = (n / F.length(a) + n / F.length(b) + (n - t) / n) / 3
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0) | (n == 0), 0.0).otherwise(score)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro, raised by a tenth of the rest for each of up to four equal first letters, always."""
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, 5)]
    long = [(F.length(a) >= k) & (F.length(b) >= k) for k in range(1, 5)]
    prefix = sum(((s & g).cast("int") for s, g in zip(same, long)), F.lit(0))
    j = jaro(a, b)
    return j + prefix * 0.1 * (1 - j)


def sound(v: Column) -> Column:
    """Soundex of the letters; empty if there are none."""
    letters = F.regexp_replace(v, "[^A-Za-z]", "")
    return F.when(letters == "", "").otherwise(F.soundex(letters))


def words(v: Column) -> Column:
    return F.filter(F.split(F.trim(v), r"\s+"), lambda w: w != "")


def initials(v: Column) -> Column:
    return F.array_join(F.transform(words(v), lambda w: F.upper(F.substring(w, 1, 1))), "")


def is_abbreviation(short: Column, full: Column) -> Column:
    """Whether a shorter name can stand for a full one: from the last part on, equal parts or an initial for a part.

    Only the short name's parts are initials; some part must be an initial or left out, and the names must differ.
    """
    parts = lambda v: F.filter(F.split(F.lower(F.regexp_replace(v, r"\.", " ")), r"\s+"), lambda w: w != "")
    a, b = F.reverse(parts(short)), F.reverse(parts(full))
    fits = F.zip_with(a, F.slice(b, 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: (x == y) | ((F.length(x) == 1) & (x == F.substring(y, 1, 1))))
    shorter = (F.size(a) < F.size(b)) | F.exists(a, lambda x: F.length(x) == 1)
    return (F.size(a) > 0) & (F.size(a) <= F.size(b)) & shorter & (F.lower(F.trim(short)) != F.lower(F.trim(full))) & F.forall(fits, lambda x: F.coalesce(x, F.lit(False)))


def label(v: Column) -> Column:
    return F.initcap(F.replace(v, F.lit("_"), F.lit(" ")))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the values as sorted-key JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
