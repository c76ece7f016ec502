"""Synthetic values: a deterministic function of a canonical id and the original's layout.

All digits come from md5(id), so any engine with md5 gives the same values and no state
is shared between tasks.

Defined cases: an empty table gives an empty one; a null original or id gives a null value;
originals of any length are rewritten whole; digits that are replaced never all equal the
original's; equal ids of one document give equal values; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ("Asha", "Bruno", "Carla", "Dinesh", "Elif", "Farid", "Greta", "Hiro", "Ines", "Jonas", "Kavya", "Lars", "Mira", "Nadia", "Oskar", "Priya")
LAST = ("Abel", "Bose", "Conti", "Dutta", "Engel", "Fischer", "Gupta", "Hansen", "Iyer", "Jansen", "Kumar", "Lopez", "Mehta", "Novak", "Okafor", "Patel")
FIRM = ("Amber", "Birch", "Cobalt", "Dune", "Ember", "Fjord", "Grove", "Harbor", "Indigo", "Juniper", "Keystone", "Lumen", "Meadow", "Nimbus", "Orchard", "Prairie")
TRADE = ("Works Limited", "Foods Limited", "Systems LLP", "Trading Corporation", "Textiles Limited", "Energy Limited", "Logistics LLP", "Media Limited")
STREETS = ("Cedar Road", "Hill Street", "Lake Avenue", "Mill Lane", "Park Road", "River Street", "Station Road", "Temple Road")
CITIES = ("Ashford", "Brookdale", "Clearwater", "Dunmore", "Eastvale", "Fairview", "Glenwood", "Highbury")


def draw(name: Column, n: int | Column, salt: Column | str = "") -> Column:
    """A number below n from an id."""
    word = F.md5(F.concat(name, F.lit("/"), F.lit(salt) if isinstance(salt, str) else salt).cast("binary"))
    return (F.conv(F.substring(word, 1, 8), 16, 10).cast("long") % n).cast("int")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def serial(name: Column) -> Column:
    """The number in an id."""
    return F.regexp_extract(name, "_([0-9]+)$", 1).cast("int")


def person(name: Column) -> Column:
    """Different for different ids: the number is written in mixed radix, then with a suffix."""
    n = serial(name)
    more = F.floor(n / (len(FIRST) * len(LAST))).cast("int")
    return F.concat_ws(" ", _pick(FIRST, n % len(FIRST)), _pick(LAST, F.floor(n / len(FIRST)).cast("int") % len(LAST)), F.when(more > 0, more.cast("string")))


def company(name: Column) -> Column:
    n = serial(name)
    more = F.floor(n / (len(FIRM) * len(TRADE))).cast("int")
    return F.concat_ws(" ", _pick(FIRM, n % len(FIRM)), F.when(more > 0, more.cast("string")), _pick(TRADE, F.floor(n / len(FIRM)).cast("int") % len(TRADE)))


def email(name: Column, owner: Column) -> Column:
    slug = F.when(owner.isNotNull(), F.regexp_replace(F.lower(owner), "[^a-zA-Z0-9]", ".")).otherwise(F.concat(F.lit("user."), F.substring(F.md5(name.cast("binary")), 1, 10)))
    return F.concat(slug, F.lit("@example.com"))


def digits_like(name: Column, original: Column) -> Column:
    """Other digits in the same layout; drawn anew while they equal the original."""

    def once(salt: str) -> Column:
        return F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), draw(name, 10, F.concat(F.lit(salt), i.cast("string"))).cast("string")).otherwise(c)), "")

    last = F.regexp_extract(original, "([0-9])[^0-9]*$", 1)
    # should three draws all give the original, its last digit goes up by one
    up = F.concat(F.regexp_extract(original, "^(.*)[0-9][^0-9]*$", 1), ((last.try_cast("int") + 1) % 10).cast("string"), F.regexp_extract(original, "([^0-9]*)$", 1))
    return F.when(once("a") != original, once("a")).when(once("b") != original, once("b")).when(once("c") != original, once("c")).when(last != "", up).otherwise(original)


def _check_digit(body: Column) -> Column:
    """The Luhn digit behind an array of digits."""
    total = F.aggregate(F.reverse(body), F.struct(F.lit(True).alias("twice"), F.lit(0).alias("sum")), lambda a, d: F.struct((~a["twice"]).alias("twice"), (a["sum"] + F.when(a["twice"], F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)).alias("sum")), lambda a: a["sum"])
    return (10 - total % 10) % 10


def card(name: Column, original: Column) -> Column:
    """Another card number in the same layout, with a valid check digit; 16 digits if the original has fewer than 13."""
    have = F.length(F.regexp_replace(original, "[^0-9]", ""))
    n = F.when(have < 13, 16).otherwise(have)
    body = F.transform(F.sequence(F.lit(1), n - 1), lambda i: draw(name, 10, F.concat(F.lit("d"), i.cast("string"))))
    number = F.array_append(body, _check_digit(body))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct((acc["i"] + is_digit.cast("int")).alias("i"), F.concat(acc["s"], F.when(is_digit, F.element_at(number, acc["i"] + 1).cast("string")).otherwise(c)).alias("s"))

    laid = F.aggregate(F.filter(F.split(original, ""), lambda c: c != ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("s")), put)
    return F.concat(laid["s"], F.array_join(F.transform(F.slice(number, laid["i"] + 1, F.size(number)), lambda d: d.cast("string")), ""))


def ip(name: Column, original: Column) -> Column:
    four = F.concat_ws(".", *(draw(name, 256, f"o{i}").cast("string") for i in range(4)))
    eight = F.concat_ws(":", *(F.lower(F.hex(draw(name, 65536, f"h{i}"))) for i in range(8)))
    return F.when(original.contains(":"), eight).otherwise(four)


def date(name: Column, original: Column, birth: Column) -> Column:
    """Another date in the same order and with the same separator; the first short part is the day, the next one the month."""
    mark = F.when(original.contains("/"), "/").when(original.contains("."), ".").otherwise("-")
    parts = F.split(original, r"[/.\-]")
    year = F.when(birth, 1960 + draw(name, 46, "y")).otherwise(2010 + draw(name, 17, "y"))
    day, month = 1 + draw(name, 28, "d"), 1 + draw(name, 12, "m")
    year_first = F.length(F.element_at(parts, 1)) == 4

    def part(p: Column, i: Column) -> Column:
        short_year = F.lpad((year % 100).cast("string"), 2, "0")
        is_year = (F.length(p) == 4) | (~year_first & (i == 2))
        first_short = F.when(year_first, 1).otherwise(0)
        return F.when(is_year, F.when(F.length(p) == 4, year.cast("string")).otherwise(short_year)).when(i == first_short, F.lpad(day.cast("string"), 2, "0")).otherwise(F.lpad(month.cast("string"), 2, "0"))

    return F.concat_ws("", F.transform(parts, lambda p, i: F.concat(F.when(i > 0, mark).otherwise(""), part(p, i))))


def address(name: Column) -> Column:
    return F.concat((1 + draw(name, 200, "n")).cast("string"), F.lit(" "), _pick(STREETS, draw(name, len(STREETS), "s")), F.lit(", "), _pick(CITIES, draw(name, len(CITIES), "c")), F.lit(" "), (100000 + draw(name, 899999, "p")).cast("string"))


def location(name: Column) -> Column:
    return _pick(CITIES, draw(name, len(CITIES), "c"))


def value(kind: Column, name: Column, original: Column, owner: Column) -> Column:
    return (
        F.when(kind == "PERSON", person(name))
        .when(kind == "COMPANY", company(name))
        .when(kind == "EMAIL", email(name, owner))
        .when(kind.isin("PHONE", "SSN"), digits_like(name, original))
        .when(kind == "CREDIT_CARD", card(name, original))
        .when(kind == "IP_ADDRESS", ip(name, original))
        .when(kind.isin("DATE_OF_BIRTH", "DATE"), date(name, original, kind == "DATE_OF_BIRTH"))
        .when(kind == "ADDRESS", address(name))
        .when(kind == "LOCATION", location(name))
        .otherwise(F.concat(F.lit("SYNTHETIC_"), name))
    )


def replacements(entities: DataFrame, owners: DataFrame) -> DataFrame:
    """entities with synthetic; an address of a known person is made from that person's new name."""
    owned = entities.join(owners.withColumnRenamed("email_id", "id"), ["doc_id", "id"], "left")
    owner = F.when(F.col("person_id").isNotNull(), person(F.col("person_id")))
    return owned.withColumn("synthetic", value(F.col("entity_type"), F.col("id"), F.col("original"), owner)).drop("person_id")
