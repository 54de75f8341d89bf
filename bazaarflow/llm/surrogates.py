"""Personal data replaced by surrogates, in DataFrame functions only.

Mentions (e-mail addresses, phone numbers, card numbers, IP addresses, US social security numbers, IBANs and
person names) are found with one pattern. A mention's canonical value is what all spellings of one entity share:
the lower-cased address, the digits of a number, each part of a name. Every different canonical value gets
one surrogate from a keyed hash:

- digits become digits, letters become letters of the same script (vowels vowels, consonants consonants, where the
  script is listed with them), the rest stays, so length and format stay; card numbers keep their issuer digit and pass the Luhn check if they did;
- top-level domains, country codes and private address ranges stay; equal domains stay equal;
- listed first names become listed first names of the same gender and script, by a keyed permutation;
- surnames keep script, capitals and, in Cyrillic, the ending that shows the gender.

**Collision checks.** If two values of a kind get one surrogate, or a surrogate is another value of the corpus,
all but one winner draw again, until all surrogates differ from each other and from all values. So
different entities stay different and one entity is the same wherever it is mentioned.

Where a format has too few free forms for that (`STALL` rounds settle nothing, or the rounds are over), the open
values get a longer form, which grows until it is free; machine addresses first get octets of any size, then ones of the
largest private range. So every value has a surrogate, whatever the counts are, and no surrogate is a value of the corpus.

The values table grows with the different entities, not with mentions: a value in a third of all documents is
combined before it is shuffled. Mentions carry their surrogate back by a join; the most frequent mentions, at most
`HOT` by their count, are broadcast.

Defined cases: a null text stays null, an empty one empty. Rows are told apart by id and text hash, so ids
may repeat or be null. An empty table gives an empty result. Other columns than id and text are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bazaarflow.session import shared_folder, write_and_reload

KEY = "surrogates-1"
HOT = 10_000
STALL = 12
DRAWN = "kind string, value string, surrogate string, again boolean"

# First names by gender and script, titles, letters.
MALE = "James John Robert Michael David Richard Thomas Daniel Matthew Anthony Steven Andrew Kevin Brian George Edward Peter Hans Jürgen Klaus Wolfgang Stefan Pierre Jean François Philippe Jacques Carlos José Luis Miguel Javier Antonio Juan".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Donna Ursula Monika Petra Sabine Ingrid Heike Marie Camille Sophie Isabelle Céline María Carmen Ana Isabel Lucía Pilar Rosa".split()
MALE_CYRILLIC = "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Владимир Павел".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split()
TITLES = "Mr Mrs Ms Miss Herr Frau Monsieur Madame Señor Señora".split()
LETTERS = [
    ("aeiou", "aeiou"), ("bcdfghjklmnpqrstvwxyz", "bcdfghklmnprstvz"), ("áéíóúàèìòùâêîôûäëïöüåãõ", "aeiou"), ("ñçßý", "nsvz"),
    ("аеёиоуыэюя", "аеиоу"), ("бвгджзйклмнпрстфхцчшщ", "бвгдзклмнпрст"), ("ьъ", "ь"), ("αεηιουωάέήίόύώ", "αεηιο"), ("βγδζθκλμνξπρσςτφχψ", "βγδκλμνπρστ"), ("0123456789", "0123456789"),
]


def _further_letters() -> list[tuple[str, str]]:
    """All other lower-case letters: Latin, Greek and Cyrillic ones become listed letters, further scripts' their own ones."""
    listed, groups = "".join(m for m, _ in LETTERS), {}
    for char in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(char) == "Ll" and char not in listed:
            script = unicodedata.name(char, "").split(" ")[0]
            vowel = unicodedata.normalize("NFD", char)[0] in "aeiouyæøœıаеиоуыэюяіїєαεηιουω"
            groups.setdefault((script, vowel), []).append(char)
    fills = {("LATIN", True): 0, ("LATIN", False): 1, ("CYRILLIC", True): 4, ("CYRILLIC", False): 5, ("GREEK", True): 7, ("GREEK", False): 8}
    own = lambda chars: "".join([c for c in chars if len(c.upper()) == 1 and c.upper() != c] or chars)
    return [("".join(chars), LETTERS[fills[key]][1] if key in fills else own(chars)) for key, chars in groups.items()]


LETTERS += _further_letters()
# each known letter and digit, and at the same place the private-use sign of its class
MEMBERS = "".join(m for m, _ in LETTERS)
CLASSES = "".join(chr(0xE000 + i) * len(m) for i, (m, _) in enumerate(LETTERS))
_FIRST = [("first_m", MALE), ("first_f", FEMALE), ("first_m", MALE_CYRILLIC), ("first_f", FEMALE_CYRILLIC)]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
CARD = r"(?<!\d)(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
NAME = r"(?<!\p{L})(?:" + "|".join([*(n for _, names in _FIRST for n in names), *(rf"{t}\.?" for t in TITLES)]) + r")[ \t]+\p{Lu}\p{Ll}+(?!\p{L})"
# fixed values: country calling codes of one and two digits, all others have three
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
KINDS = [("email", EMAIL), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("iban", IBAN), ("name", NAME)]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)


def _byte(hashed: Column, i: Column) -> Column:
    return F.conv(F.substring(hashed, i % 31 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(KEY), *parts).cast("binary"), 256)


def _scrambled(text: Column, hashed: Column) -> Column:
    """text with every known lower-case letter and digit replaced by one of its class."""

    def one(char: Column, i: Column) -> Column:
        sign = F.translate(char, MEMBERS, CLASSES)
        fill = F.get(F.array(*[F.lit(f) for _, f in LETTERS]), F.ascii(sign) - 0xE000)
        return F.when(sign == char, char).otherwise(F.substring(fill, _byte(hashed, i) % F.length(fill) + 1, F.lit(1)))

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _let(value: Column, use) -> Column:
    """use(value) with value written once in the plan, however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _octets(text: Column, hashed: Column, wide: int) -> Column:
    """Octets of as many digits as before; from wide 0 on of any size, from 8 on in the largest private range."""
    private = F.when(text.rlike(r"^(10|127)\."), 1).when(text.rlike(r"^192\.168\."), 1 if wide >= 8 else 2).otherwise(0)

    def one(part: Column, i: Column) -> Column:
        size, number = F.length(part), _byte(hashed, i)
        fresh = number if wide >= 0 else F.when(size == 3, 100 + number % 155).when(size == 2, 10 + number % 90).otherwise(number % 10)
        return F.when(i < private, F.lit("10") if wide >= 8 else part).otherwise(fresh.cast("string"))

    return F.array_join(F.transform(F.split(text, r"\."), one), ".")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _checked(body: Column, value: Column, hashed: Column) -> Column:
    """A card number with that body: its last digit is the check digit where the value's is, and another one elsewhere."""

    def ended(body: Column) -> Column:
        check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        own = lambda check: F.when(_luhn(value) % 10 == 0, check).otherwise((check + 1 + _byte(hashed, F.lit(30)) % 9) % 10)
        return F.concat(body, _let(check, own).cast("string"))

    return _let(body, ended)


def _ends(kind: Column, value: Column) -> tuple[Column, Column]:
    """What stays at the start and at the end of a value: issuer digit, country, ending of the surname, the check digit's place."""
    country = F.regexp_extract(value, COUNTRY, 0)
    head = F.when(kind == "card", F.substring(value, 1, 1)).when(kind == "iban", F.substring(value, 1, 2)).when(kind == "phone", country).otherwise("")
    cyrillic = (kind == "surname") & value.rlike(r"^\p{IsCyrillic}{4,}$")
    tail = F.when(cyrillic, F.substring(value, F.length(value) - 2, F.lit(3))).when(kind == "card", F.substring(value, F.length(value), F.lit(1)))
    return head, tail.when(kind == "email", F.regexp_extract(value, "@.*$", 0)).otherwise("")


def _surrogate(kind: Column, value: Column, attempt: int, wide: int) -> Column:
    """The value's surrogate of an attempt. Letters and digits are replaced in one place of the plan: its tables are long."""

    def of(hashed: Column) -> Column:
        head, tail = _ends(kind, value)
        inner = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(tail))
        domain = F.regexp_extract(value, r"@(.*)(\.[a-z]+)$", 1)
        pieces = F.array(F.struct(inner.alias("text"), hashed.alias("hash")), F.struct(domain.alias("text"), _hash(F.lit("domain"), domain).alias("hash")))

        def put(fresh: Column) -> Column:
            body, name = F.element_at(fresh, 1), F.element_at(fresh, 2)
            top = F.regexp_extract(value, r"\.[a-z]+$", 0)
            return (
                F.when(kind == "email", F.concat(body, F.lit("@"), name, top)).when(kind == "ip", _octets(value, hashed, wide))
                .when(kind == "card", _checked(F.concat(head, body), value, hashed)).otherwise(F.concat(head, body, tail))
            )

        return _let(F.transform(pieces, lambda p: _scrambled(p["text"], p["hash"])), put)

    return _let(_hash(kind, value, F.lit(str(attempt))), of)


def _first_names() -> dict[str, tuple[str, str]]:
    """Listed first name, lower-cased, to (kind, surrogate): a cycle through the list in keyed order."""
    import hashlib

    found = {}
    for kind, names in _FIRST:
        order = sorted(names, key=lambda n: hashlib.sha256(f"{KEY}|{n}".encode()).hexdigest())
        found.update({n.lower(): (kind, m) for n, m in zip(order, [*order[1:], order[0]])})
    return found


def _canonical(mention: Column, kind: Column) -> Column:
    digits = F.regexp_replace(mention, r"\D", "")
    phone = F.when(mention.startswith("+1") & (F.length(digits) == 11), F.substring(digits, F.lit(2), F.lit(10)))
    phone = phone.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.lower(F.regexp_replace(mention, " ", "")))
        .when(kind == "name", F.lower(F.regexp_extract(mention, r"(\S+)$", 1))).otherwise(F.lower(mention))
    )


def _rendered(mention: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own spelling: its separators and capitals, aligned from the right."""
    chars = F.split(mention, "")
    counts = lambda c: c.rlike(r"[\p{L}\d]")
    skip = F.size(F.filter(chars, counts)) - F.length(F.regexp_replace(value, r"[^\p{L}\d]", ""))
    every = F.regexp_replace(surrogate, r"[^\p{L}\d]", "")
    # a longer form has its further characters before an address and after other values
    size = F.length(F.regexp_replace(value, r"[^\p{L}\d]", ""))
    more = F.length(every) - size
    address = value.contains("@")
    letters = F.when(address, F.substring(every, more + 1, size)).otherwise(F.substring(every, F.lit(1), size))

    def one(char: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), counts)) - skip
        fresh = F.substring(letters, before, F.lit(1))
        return F.when(~counts(char) | (before < 1), char).when(char.rlike(r"\p{Lu}"), F.upper(fresh)).otherwise(fresh)

    shown = F.array_join(F.transform(chars, one), "")
    return F.when(address, F.concat(F.substring(every, F.lit(1), more), shown)).otherwise(F.concat(shown, F.substring(every, size + 1, more)))


def _longer(kind: Column, value: Column, attempt: int, wide: int) -> Column:
    """A surrogate of a form that is longer than the value by 4 + wide signs; addresses of machines widen their octets first."""
    extra = F.translate(F.substring(_hash(F.lit("longer"), kind, value, F.lit(str(attempt))), 1, 4 + wide), "0123456789abcdef", "bcdfghklmnprstvz")
    digits = F.translate(extra, "bcdfghklmnprstvz", "0123456789012345")
    base = _surrogate(kind, value, attempt, wide)

    def grown(base: Column) -> Column:
        machine = base if wide < 16 else F.concat(base, F.lit(":"), digits)
        return (
            F.when(kind == "email", F.concat(extra, base)).when(kind == "ip", machine)
            .when(kind.isin("surname", "iban"), F.concat(base, extra)).otherwise(F.concat(base, digits))
        )

    return _let(base, grown)


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows over as many tasks as a shuffle has, few bytes or many: what follows costs much for each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def values_to_surrogates(values: DataFrame, rounds: int = 64) -> DataFrame:
    """Stored (kind, value, surrogate) for the different (kind, value): all surrogates of a kind differ and none is a value.

    Values that `STALL` rounds, or all rounds, leave open have a format without free forms; they get longer ones.
    """
    spark = values.sparkSession
    values = write_and_reload(_spread(values.select("kind", "value"), "value"), "values")
    base = shared_folder(spark, "surrogates")
    folders: list[str] = []

    def settled() -> DataFrame:
        # one scan of all rounds, so that the plan doesn't grow with them
        return spark.read.schema(DRAWN).parquet(*folders).filter("not again").drop("again")

    def draw(open_: DataFrame, surrogate: Column) -> DataFrame:
        """Store what open_ draws; return the rows that draw again: their surrogate is another's, or a value."""
        drawn = write_and_reload(_spread(open_.select("kind", "value"), "value").select("kind", "value", surrogate.alias("surrogate")), "drawn")
        winners = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("winner"))
        taken = values.select("kind", F.col("value").alias("surrogate"))
        if folders:
            taken = taken.unionByName(settled().select("kind", "surrogate"))
        # settled surrogates are no values, so a surrogate is in taken at most once
        checked = drawn.join(winners, ["kind", "surrogate"]).join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        again = (F.col("winner") != F.col("value")) | F.col("taken").isNotNull()
        folder = f"{base}/{len(folders)}"
        checked.select("kind", "value", "surrogate", again.alias("again")).write.parquet(folder)
        folders.append(folder)
        return spark.read.schema(DRAWN).parquet(folder).filter("again").drop("again")

    kind, value = F.col("kind"), F.col("value")
    open_, left, attempt, stalled = values, -1, 0, 0
    while left and attempt < rounds and stalled < STALL:
        open_ = draw(open_, _surrogate(kind, value, attempt, -1))
        now = open_.count()
        stalled = stalled + 1 if now == left else 0
        left, attempt = now, attempt + 1
    wide = 0
    while left:  # the forms grow with each attempt, so this ends
        open_ = draw(open_, _longer(kind, value, attempt, wide))
        left, attempt, wide = open_.count(), attempt + 1, wide + 1
    return settled()


def mention_surrogates(mentions: DataFrame) -> DataFrame:
    """Stored (mention, n, replacement) for the different mentions (mention, n)."""
    # a kind's full pattern settles the type; mentions stand alone here, so look-arounds hold
    kind = reduce(lambda rest, k: F.when(F.col("mention").rlike(f"^(?:{k[1]})$"), k[0]).otherwise(rest), reversed(KINDS), F.lit("name"))
    told = _spread(mentions, "mention").withColumn("kind", kind)
    known = write_and_reload(told.withColumn("value", _canonical(F.col("mention"), F.col("kind"))), "mentions")
    value_kind = F.when(F.col("kind") == "name", "surname").otherwise(F.col("kind"))
    table = values_to_surrogates(known.select(value_kind.alias("kind"), "value").distinct())
    names = _first_names()
    first = F.create_map(*[F.lit(x) for n, (_, m) in names.items() for x in (n, m)])
    lead, gap = F.regexp_extract("mention", r"^(\S+)(\s+)", 1), F.regexp_extract("mention", r"^(\S+)(\s+)", 2)
    last = F.regexp_extract("mention", r"(\S+)$", 1)
    named = F.col("kind") == "name"
    shown = _rendered(F.when(named, last).otherwise(F.col("mention")), F.col("value"), F.col("surrogate"))
    shown = F.when(named, F.concat(F.coalesce(F.element_at(first, F.lower(lead)), lead), gap, shown)).when(F.col("kind") == "ip", F.col("surrogate")).otherwise(shown)
    joined = known.withColumn("of", value_kind).join(table.withColumnRenamed("kind", "of"), ["of", "value"])
    return write_and_reload(joined.select("mention", "n", shown.alias("replacement")), "replacements")


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text with surrogates, n_replaced."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    placed = write_and_reload(texts.select("id", "th", F.posexplode(found).alias("place", "mention")), "places")
    table = mention_surrogates(placed.groupBy("mention").agg(F.count("*").alias("n")))

    hot = F.broadcast(table.filter(F.col("n") * HOT > placed.count()).select("mention", F.col("replacement").alias("hot")))
    cold = table.select(F.col("mention").alias("route"), F.col("replacement").alias("cold"))
    # mentions that have their replacement are dealt out by row and meet nothing: no mention holds this sign
    route = F.when(F.col("hot").isNotNull(), F.concat(F.lit("\u0000"), F.hex("th"))).otherwise(F.col("mention"))
    told = placed.join(hot, "mention", "left").withColumn("route", route).join(cold, "route", "left")
    row = told.groupBy(F.col("id").alias("row_id"), F.col("th").alias("row_th")).agg(
        F.array_sort(F.collect_set(F.struct("place", F.coalesce("hot", "cold").alias("replacement")))).alias("marks")
    )  # at most as many as a text has mentions
    pieces = F.split("text", PATTERN, -1)
    fresh = F.concat(F.transform("marks", lambda m: m["replacement"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(pieces, fresh, lambda p, r: F.concat(p, r)), "")
    joined = texts.join(row, F.col("id").eqNullSafe(F.col("row_id")) & (F.col("th") == F.col("row_th")), "left")
    return joined.select("id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(rebuilt).alias("text"), F.coalesce(F.size("marks"), F.lit(0)).alias("n_replaced"))
