r"""PII: detected entities are replaced by keyed surrogates of the same kind, in DataFrame operations only.

Kinds: e-mail addresses, phone numbers, card numbers, IPv4 addresses, access keys, passwords and tokens, and
names after a title. A surrogate has the layout of what it replaces: separators, the domain's ending, an
address's country code, a card's check digit (right if it was right), upper and lower case and hexadecimal
digits stay of their sort; letters stay in their script (Latin, Cyrillic, Greek); a name keeps the gender
that its title tells by its ending, -a for women and a consonant for men.

A surrogate follows from the key and the entity's normal form alone, so one person's number gets one surrogate in all
documents and layouts (coreference). All distinct entities are then checked: where two of a kind got one
surrogate, or a surrogate is some real entity, those but the first are drawn again, until all differ.

Only distinct entities are compared; texts are joined with the replacements of their entities, those without any too.

Cases: null texts stay null and empty ones empty; both have 0 entities. Repeated rows get the same text. A null
doc_id stays null. An empty table gives an empty result. Other columns play no part. Very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, stored, table

# Titles, by the gender they tell.
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Госпожа|Κυρία"
MALE_TITLES = r"Mr|Herr|M(?=\.)|Monsieur|Señor|Sr|Господин|Κύριος"

EMAIL = r"(?<![\p{L}0-9])[\p{L}0-9][\p{L}0-9._%+-]*+@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}"
SECRET = r"(?:password|passwd|pwd|secret|token|api_key)\s?[=:]\s?\"?[A-Za-z0-9_/+-]{8,}"
ACCESS_KEY = r"\bAKIA[A-Z0-9]{16}\b"
CARD = r"\b[3-6](?:[ -]?[0-9]){12,18}\b"
PHONE = r"(?<![\p{L}0-9])\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b"
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
NAME = rf"\b(?:{FEMALE_TITLES}|{MALE_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
PATTERN = "|".join([EMAIL, SECRET, ACCESS_KEY, CARD, PHONE, IP, NAME])
#: What a text with any entity has; most texts have none of it and need no closer look.
LIKELY = rf"[@0-9=:]|AKIA|\b(?:{FEMALE_TITLES}|{MALE_TITLES})\b"
#: A surrogate that still collides after so many draws gets one more letter, and another after as many again.
TRIES_A_LETTER = 4

# Letters by script and sort, in alphabetical order.
LETTERS = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "cyrillic_lower": "абвгдежзийклмнопрстуфхцчшщэюя",
    "cyrillic_upper": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "greek_lower": "αβγδεζηθικλμνξοπρστυφχψω",
    "greek_upper": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "digit": "0123456789",
    "hex": "0123456789abcdef",
}
_KIND_TESTS = [
    ("email", r"@"),
    ("secret", r"^(?:password|passwd|pwd|secret|token|api_key)\s?[=:]"),
    ("access_key", r"^AKIA[A-Z0-9]{16}$"),
    ("ip", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"),
    ("card", r"^[3-6](?:[ -]?[0-9]){12,18}$"),
    ("phone", r"^[+0-9(]"),
]


def kind(entity: Column) -> Column:
    found = F.lit("name")
    for name, test in reversed(_KIND_TESTS):
        found = F.when(entity.rlike(test), name).otherwise(found)
    return found


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kept_prefix(kind: Column, entity: Column) -> Column:
    """How many characters at the start stay: titles, the words before a secret, country codes, AKIA."""
    before_number = F.length(F.regexp_extract(entity, r"^(.*?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", 1))
    return (
        F.when(kind == "secret", F.length(F.regexp_extract(entity, r'^\w+\s?[=:]\s?"?', 0)))
        .when(kind == "access_key", 4)
        .when(kind == "phone", before_number)
        .when(kind == "card", 1)
        .when(kind == "name", F.instr(entity, " "))
        .otherwise(0)
    )


def kept_suffix(kind: Column, entity: Column) -> Column:
    """How many characters at the end stay: the domain but for its first label."""
    return F.when(kind == "email", F.length(F.regexp_extract(entity, r"@[^.]*(\..*)$", 1))).otherwise(0)


def normal(kind: Column, entity: Column) -> Column:
    """The same for all layouts of one entity."""
    body = F.substring(entity, kept_prefix(kind, entity) + 1, F.length(entity))
    return (
        F.when(kind == "phone", F.right(_digits(entity), F.lit(10)))
        .when(kind == "card", _digits(entity))
        .when(kind == "email", F.lower(entity))
        .otherwise(body)
    )


def gender(kind: Column, entity: Column) -> Column:
    female = entity.rlike(rf"^(?:{FEMALE_TITLES})\.? ")
    return F.when(kind == "name", F.when(female, "female").otherwise("male"))


def _luhn(digits: Column) -> Column:
    """The sum of a card number's digits by Luhn's rule, mod 10."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, b: a + b) % 10


def replacement(entity: Column, kind: Column, gender: Column, digest: Column, tries: Column) -> Column:
    """entity with the characters between kept prefix and suffix redrawn from digest (128 hexadecimal digits).

    Words (names, addresses, secrets) that have been drawn often grow by letters of their script and case, as short ones may
    have fewer values than there are entities.

    Places count from the end in characters that aren't separators, so layouts of one number agree."""
    first, last = kept_prefix(kind, entity), F.length(entity) - kept_suffix(kind, entity)
    hexadecimal = (kind == "secret") & entity.rlike("[=:]\\s?\"?[0-9a-f]+$")

    def draw(alphabet: str, number: Column) -> Column:
        letters = LETTERS[alphabet]
        return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        after = F.length(F.regexp_replace(F.substring(entity, i, F.length(entity)), r"[^\p{L}0-9]", ""))
        number = F.conv(F.substring(digest, (after * 4) % 120 + 1, F.lit(6)), 16, 10).cast("int") + after
        end = (gender.isNotNull()) & F.substring(entity, i + 1, F.lit(1)).isin("", " ")
        ending = F.when(gender == "female", "a").otherwise(draw("lower", number % 3 + 11))
        return (
            F.when((i <= first) | (i > last), c)
            .when(hexadecimal, draw("hex", number))
            .when(c.rlike("[0-9]"), draw("digit", number))
            .when(end & c.rlike(r"\p{IsLatin}"), F.when(c.rlike(r"\p{Lu}"), F.upper(ending)).otherwise(ending))
            .when(end & c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), F.when(gender == "female", "А").otherwise("Н"))
            .when(end & c.rlike(r"\p{IsCyrillic}"), F.when(gender == "female", "а").otherwise("н"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), draw("cyrillic_upper", number)).otherwise(draw("cyrillic_lower", number)))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), draw("greek_upper", number)).otherwise(draw("greek_lower", number)))
            .when(c.rlike(r"\p{Lu}"), draw("upper", number))
            .when(c.rlike(r"\p{L}"), draw("lower", number))
            .otherwise(c)
        )

    drawn = F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")
    body = F.substring(entity, first + 1, F.length(entity))
    more = F.substring(digest, F.lit(1), F.floor(tries / TRIES_A_LETTER).cast("int"))
    sixteen = {"cyrillic_lower": r"\p{IsCyrillic}", "greek_lower": r"\p{IsGreek}"}
    letters = F.translate(more, LETTERS["hex"], LETTERS["lower"][:16])
    for alphabet, test in sixteen.items():
        letters = F.when(body.rlike(test), F.translate(more, LETTERS["hex"], LETTERS[alphabet][:16])).otherwise(letters)
    letters = F.when(hexadecimal, more).when(body.rlike(r"\p{Lu}") & ~body.rlike(r"\p{Ll}"), F.upper(letters)).otherwise(letters)
    # after the first letter drawn, so that capitals and endings stay where they are
    grown = F.concat(F.substring(drawn, F.lit(1), first + 1), letters, F.substring(drawn, first + 2, F.length(drawn)))
    drawn = F.when(kind.isin("name", "email", "secret"), grown).otherwise(drawn)
    octets = [(F.conv(F.substring(digest, F.lit(1 + 4 * k), F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string") for k in range(4)]

    def checked(card: Column) -> Column:
        """The last digit moved so that the number is right or wrong as the original is."""
        want = F.when(_luhn(_digits(entity)) == 0, 0).otherwise(1)
        moved = F.pmod(F.right(card, F.lit(1)).cast("int") + want - _luhn(_digits(card)), F.lit(10))
        return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), moved.cast("string"))

    return F.when(kind == "ip", F.concat_ws(".", *octets)).when(kind == "card", let(drawn, checked)).otherwise(drawn)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """From entities (entity): (entity, surrogate), distinct and in no real entity's normal form."""
    own = F.col("entity")
    each = entities.distinct().withColumn("kind", kind(own))
    each = each.withColumns({"normal": normal(F.col("kind"), own), "gender": gender(F.col("kind"), own), "tries": F.lit(0)})
    open_rows, settled = stored(each, "entities"), None
    real = open_rows.select("kind", F.col("normal").alias("real")).distinct()
    while True:
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "normal", F.col("tries").cast("string")), 512)
        drawn = open_rows.withColumn("_digest", digest)
        drawn = drawn.withColumn("surrogate", replacement(F.col("entity"), F.col("kind"), F.col("gender"), F.col("_digest"), F.col("tries")))
        drawn = stored(drawn.drop("_digest").withColumn("drawn", normal(F.col("kind"), F.col("surrogate"))), "drawn")
        taken = drawn.select("kind", "drawn", "normal", "tries")
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "drawn", "normal", "tries"))
        # Of those that share a surrogate the first to have it keeps it: fewest tries, then normal form.
        owner = taken.groupBy("kind", "drawn").agg(F.min_by("normal", F.struct("tries", "normal")).alias("owner"))
        checked = drawn.join(owner, ["kind", "drawn"]).join(
            real.withColumnRenamed("real", "drawn").withColumn("_real", F.lit(True)), ["kind", "drawn"], "left"
        )
        good = (F.col("owner") == F.col("normal")) & F.col("_real").isNull()
        checked = stored(checked.withColumn("_good", good), "checked")
        # a normal form is redrawn with all its layouts or not at all
        bad = stored(checked.filter("not _good").select("kind", "normal").distinct(), "redrawn")
        done = checked.join(bad, ["kind", "normal"], "left_anti").select("entity", "kind", "normal", "drawn", "tries", "surrogate")
        settled = done if settled is None else stored(settled.unionByName(done), "settled")
        if bad.isEmpty():
            return stored(settled.select("entity", "surrogate"), "surrogates")
        open_rows = open_rows.join(bad, ["kind", "normal"], "left_semi").withColumn("tries", F.col("tries") + 1)


def replace(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """doc_id, n_entities, text with surrogates."""
    found = F.when(F.col("text").rlike(LIKELY), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    lists = docs.select("doc_id", F.xxhash64("text").alias("_hash"), found.alias("_found")).filter(F.size("_found") > 0)
    lists = stored(lists.dropDuplicates(["doc_id", "_hash"]), "found")  # the one close look at the texts
    each = lists.select("doc_id", "_hash", F.explode(F.array_distinct("_found")).alias("entity"))
    names = surrogate_table(each.select("entity"), key)
    pairs = each.join(small(names), "entity").groupBy("doc_id", "_hash")
    pairs = pairs.agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_names"))
    pairs = pairs.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_same"), "_names")
    same = lists["doc_id"].eqNullSafe(pairs["_id"]) & (lists["_hash"] == pairs["_same"])
    known = lists.join(pairs, same).select("_id", "_hash", "_found", "_names")
    known = stored(known, "named")
    at = docs["doc_id"].eqNullSafe(known["_id"]) & (F.xxhash64(docs["text"]) == known["_hash"])
    # a shuffle join at every size: a broadcast of what few entities a small input has would end at some size
    joined = docs.select("doc_id", "text").join(known.hint("merge"), at, "left")

    def filled(between: Column) -> Column:
        """The stretches between entities, each with the surrogate that follows it."""
        names = F.transform(F.col("_found"), lambda x, i: F.concat(between[i], F.col("_names")[x]))
        return F.concat(F.array_join(names, ""), F.element_at(between, -1))

    replaced = let(F.split("text", PATTERN, -1), filled)
    return joined.select(
        "doc_id",
        F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_entities"),
        F.when(F.col("_found").isNull(), F.col("text")).otherwise(replaced).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"))
