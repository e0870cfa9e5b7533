"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, the same for the same entity.

Entities are found by patterns. A surrogate is made from a keyed hash of the entity's type and canonical form (an
e-mail address in lower case, a number without its punctuation): every digit becomes a digit, every letter one of its
case, everything else stays, so length, grouping and script of the format survive. Country code, the first digit of a
card (whose checksum holds again) and the prefix of an access key stay; addresses move to reserved ranges and domains; names become names of the
title's gender in the name's script.

Coreference: what is replaced depends on the canonical form only: a phone number's digits in any grouping, a family
name (so `Mr Adam Smith`, `Mr. Smith` and `Mrs Smith` keep theirs in common; a given name has a surrogate of its own,
two given names of one family can meet in one of sixteen). Distinctness: all distinct entities of the corpus
and their surrogates are compared; where two share a surrogate, or a surrogate is itself an entity of the corpus, all
but the least of them get the next surrogate (a counter goes into the hash), until none is left. Only entities whose
counter isn't 0 travel back to the texts, with the rows that hold them; all others are rewritten in the row.

Built-in functions alone do it, no entity list is gathered anywhere.

A row of digit groups is taken as one number of at most 19 digits, from its first group on, up to where another form
begins; sixteen digits in fours come before longer numbers. The checksum is asked of that number, not of its parts.

Defined cases: a null text stays null and has no entity; repeated rows are rewritten alike; rows are kept whole with
their other columns; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cairn.functions.code import let
from cairn.llm.common import columns_of, fresh, table, text_of
from cairn.llm.registry import query
from cairn.session import cut

# Forms of personal data, in the order in which they are tried.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    # Every repetition is bounded or possessive and none begins inside a run of its own characters: a text is read once.
    "email": r"(?<![\p{L}0-9])[\p{L}0-9][\p{L}0-9._%+-]{0,255}+@(?:[\p{L}0-9-]{1,63}+\.){1,32}[\p{L}]{2,63}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9+])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|MR|MRS|MS|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Господин|Госпожа)\.? "
            r"\p{Lu}[\p{L}\p{M}]{0,63}+(?:['’-]\p{L}[\p{L}\p{M}]{0,63}+){0,3}(?: \p{Lu}[\p{L}\p{M}]{0,63}+(?:['’-]\p{L}[\p{L}\p{M}]{0,63}+){0,3})?(?![\p{L}])",
}
#: What may begin within a row of numbers; the two forms below end before it, so they hide nothing.
_INNER = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "token", "card", "ssn", "ip", "phone"))
PATTERNS["phone"] = rf"(?:{PATTERNS['phone']})|(?<![A-Za-z0-9+])[0-9]{{3}}[ .-](?!{_INNER})[0-9]{{3}}[ .-](?!{_INNER})[0-9]{{4}}(?![A-Za-z0-9])"
#: 12 to 19 digits in any groups: a card if its checksum holds. Tried behind the others but names.
PATTERNS = {k: v for k, v in PATTERNS.items() if k != "name"} | {
    "digits": rf"(?<![A-Za-z0-9+])[0-9](?:(?:[ -](?!{_INNER}))?[0-9]){{11,18}}(?![A-Za-z0-9])", "name": PATTERNS["name"]}
#: The form of a whole entity, whatever may begin within it.
WHOLE = PATTERNS | {"digits": "[0-9](?:[ -]?[0-9]){11,18}", "phone": PATTERNS["phone"].replace(f"(?!{_INNER})", "")}
# Country calling codes of one and two digits; all others have three.
CALLING_CODE = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
# Titles by the gender that they tell (those of neither leave it to the hash); given names by script and gender, parts of family names by script.
MALE = ("Mr", "MR", "Herr", "Monsieur", "Señor", "Господин")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    ("latin", "male"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    ("latin", "female"): ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olivia", "Paula"),
    ("cyrillic", "male"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Юрий"),
    ("cyrillic", "female"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "по", "ра", "ре", "ро", "са", "се", "со", "та"),
}
ENDINGS = {"latin": ("n", "r", "s", "l", "nd", "rt", "st", "ng"), "cyrillic": ("нин", "рин", "сон", "лин", "нд", "рт", "ст", "нг")}

ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap test: a text without any of these characters, beginnings of keys, runs of hexadecimal letters or titles holds no entity.
HINT = r"[0-9@]|AKIA|ASIA|[a-fA-F]{32}|M[rR]|M[sS]|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Господин|Госпожа"


def _luhn(number: Column) -> Column:
    """Sum of the digits, every second one from the last doubled (and its digits added)."""
    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int") * (1 + x["i"] % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    digits = F.filter(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda d: d != "")
    numbered = F.transform(digits, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add)


def kind_of(entity: Column) -> Column:
    """Type of an entity; a number of card form without a card's checksum is of type ``number`` and no personal data."""
    out = F.lit("name")
    for name in reversed([n for n in PATTERNS if n != "name"]):
        # A name has no digit and no at sign; among the others the whole entity has to be of the form.
        found = F.when(_luhn(entity) % 10 == 0, "card").otherwise("number") if name in ("card", "digits") else F.lit(name)
        out = F.when(entity.rlike(rf"\A(?:{WHOLE[name]})\z"), found).otherwise(out)
    return out


def canonical(entity: Column, kind: Column) -> Column:
    """What tells one entity from another, whatever its spelling."""
    bare = F.regexp_replace(entity, "[^0-9+]", "")
    return (
        F.when(kind.isin("card", "ssn", "phone"), bare).when(kind.isin("email", "token"), F.lower(entity))
        .when(kind == "name", F.lower(F.element_at(F.split(entity, " "), -1))).otherwise(entity)
    )


@dataclass(frozen=True)
class _Stream:
    """Numbers from a keyed hash: the i-th is that of one pair of hexadecimal digits."""

    digest: Column

    @staticmethod
    def of(key: str, what: Column, counter: Column) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(key), what, counter.cast("string")), 512)

    def at(self, i) -> Column:
        i = i if isinstance(i, Column) else F.lit(i)
        return F.conv(F.substr(self.digest, F.lit(1) + F.lit(2) * (i % 64), F.lit(2)), 16, 10).cast("int")

    def pick(self, values: tuple[str, ...], i: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), self.at(i) % len(values))


def _plain_letter(c: Column) -> Column:
    """A letter beyond a to z, which no stream has, as one of its case."""
    return F.when(c.rlike(r"[\p{L}&&[^A-Za-z]]"), F.when(c.rlike(r"\p{Lu}"), "X").otherwise("x")).otherwise(c)


def _scrambled(text: Column, s: _Stream, hexadecimal: bool = False) -> Column:
    """Each digit, small and capital letter replaced by another of its kind; equal digits of a number are independent.

    Only digits and letters take numbers from the stream, so punctuation doesn't change what they become.
    """
    def change(c: Column, i: Column) -> Column:
        c = let(c, _plain_letter)
        taken = F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^\\p{L}0-9]", ""))
        n = s.at(taken)
        if hexadecimal:
            small, large = F.substr(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)), F.substr(F.lit("0123456789ABCDEF"), n % 16 + 1, F.lit(1))
            capital = text.rlike("[A-F]")
            return F.when(capital, large).otherwise(small)
        return (
            F.when(c.between("0", "9"), (n % 10).cast("string"))
            .when(c.between("a", "z"), F.char(n % 26 + 97)).when(c.between("A", "Z"), F.char(n % 26 + 65)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _name(entity: Column, s: _Stream, counter: Column, key: str) -> Column:
    """Title, a given name if there was one, and a family name that depends on the old one only."""
    title = F.regexp_extract(entity, r"^(\p{L}+)", 1)
    lead = F.regexp_extract(entity, r"^(\S+ )", 1)
    parts = F.split(entity, " ")
    own = _Stream(_Stream.of(key, F.concat(F.lit("given:"), F.lower(entity)), F.lit(0)))
    first = _Stream(_Stream.of(key, F.concat(F.lit("given:"), F.lower(F.get(parts, 1))), F.lit(0)))
    out = None
    for script in ("cyrillic", "latin"):
        family = F.concat(F.initcap(F.concat(s.pick(SYLLABLES[script], 2), s.pick(SYLLABLES[script], 3), s.pick(SYLLABLES[script], 4))), s.pick(ENDINGS[script], 5))
        # A name that had to be changed twice gets a double family name: there are always more names than entities.
        second = F.concat(F.initcap(F.concat(s.pick(SYLLABLES[script], 6), s.pick(SYLLABLES[script], 7))), s.pick(ENDINGS[script], 8))
        family = F.when(counter > 1, F.concat(family, F.lit("-"), second)).otherwise(family)
        male = F.when(title.isin(*NEUTRAL), own.at(0) % 2 == 0).otherwise(title.isin(*MALE))
        given = F.when(male, first.pick(GIVEN[script, "male"], 1)).otherwise(first.pick(GIVEN[script, "female"], 1))
        whole = F.when(F.size(parts) > 2, F.concat_ws(" ", given, family)).otherwise(family)
        whole = F.when((F.length(F.element_at(parts, -1)) > 1) & (F.element_at(parts, -1) == F.upper(F.element_at(parts, -1))), F.upper(whole)).otherwise(whole)
        out = F.concat(lead, whole) if out is None else F.when(entity.rlike(r"\p{IsCyrillic}"), out).otherwise(F.concat(lead, whole))
    return out


def surrogate(entity: Column, counter: Column, key: str) -> Column:
    """The replacement of an entity, by its counter."""

    def by_kind(kind: Column) -> Column:
        what = F.concat_ws(":", kind, canonical(entity, kind))

        def made(digest: Column) -> Column:
            s = _Stream(digest)
            local = F.regexp_extract(entity, "^([^@]+)@", 1)
            domain = _Stream(_Stream.of(key, F.concat(F.lit("domain:"), F.lower(F.regexp_extract(entity, "@(.*)$", 1))), F.lit(0)))
            letters = F.concat(*[F.char(domain.at(i) % 26 + 97) for i in range(8)])
            address = F.concat(_scrambled(local, s), F.lit("@"), letters, F.lit(".example"))
            ip = F.concat_ws(".", (s.at(0) % 15 + 240).cast("string"), *[s.at(i).cast("string") for i in (1, 2, 3)])
            country = F.regexp_extract(entity, CALLING_CODE, 1)
            number = F.concat(country, _scrambled(F.substr(entity, F.length(country) + 1), s))

            def checked(body: Column) -> Column:
                return F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

            return (
                F.when(kind == "email", address).when(kind == "ip", ip).when(kind == "phone", number)
                .when(kind == "card", let(F.concat(F.substring(entity, 1, 1), _scrambled(F.substr(entity, F.lit(2), F.length(entity) - 2), s)), checked))
                .when(kind == "number", entity)
                .when(kind == "access_key", F.concat(F.substring(entity, 1, 4), _scrambled(F.substr(entity, F.lit(5)), s)))
                .when(kind == "token", _scrambled(entity, s, hexadecimal=True))
                .when(kind == "ssn", F.concat(F.lit("9"), _scrambled(F.substr(entity, F.lit(2)), s)))
                .otherwise(_name(entity, s, counter, key))
            )

        return let(_Stream.of(key, what, counter), made)

    return let(kind_of(entity), by_kind)


def entities_in(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def counters(found: DataFrame, key: str) -> DataFrame:
    """(what, counter) of the entities that can't have their first surrogate; ``found`` has one column ``entity``.

    ``what`` is type and canonical form. A round compares surrogates among themselves and with the entities, both in
    canonical form, and raises the counters of those that clash; a round without a clash ends it.
    """
    kind = kind_of(F.col("entity"))
    known = cut(found.distinct().select("entity", F.concat_ws(":", kind, canonical(F.col("entity"), kind)).alias("what"))
                .groupBy("what").agg(F.min("entity").alias("entity")))
    state = known.withColumn("counter", F.lit(0))
    while True:
        replaced = F.col("replaced")
        shown = state.select("what", "entity", "counter", surrogate(F.col("entity"), F.col("counter"), key).alias("replaced"))
        told = shown.withColumn("shown", F.concat_ws(":", kind_of(replaced), canonical(replaced, kind_of(replaced))))
        first = F.row_number().over(W.partitionBy("shown").orderBy("what"))
        taken = known.select(F.col("what").alias("shown"), F.lit(True).alias("taken"))
        judged = cut(told.withColumn("place", first).join(taken, "shown", "left").select(
            "what", "entity", "counter", ((F.col("place") > 1) | F.col("taken").isNotNull()).alias("clash")))
        clashes = judged.where("clash").isEmpty()
        state = judged.select("what", "entity", (F.col("counter") + F.col("clash").cast("int")).alias("counter"))
        if clashes:
            return state.where("counter > 0").select("what", "counter")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its texts rewritten, all columns kept, and ``n_entities`` (or a name like it that is free)."""
    n = fresh(docs, "n_entities")
    row, ents, fixed = fresh(docs, "row_"), fresh(docs, "ents_"), fresh(docs, "fixed_")
    # The same row finds its changed counters by id and text.
    marked = docs.select(*columns_of(docs), F.xxhash64(F.col("doc_id").cast("string"), text_of()).alias(row))
    listed = cut(marked.select(F.col(row).alias("row"), entities_in(text_of()).alias("entities")).where(F.size("entities") > 0))
    found = listed.select("row", F.explode("entities").alias("entity")).where(kind_of(F.col("entity")) != "number")
    changed = counters(found.select("entity"), key)
    kind = kind_of(F.col("entity"))
    each = found.distinct().withColumn("what", F.concat_ws(":", kind, canonical(F.col("entity"), kind))).join(changed, "what")
    per_row = each.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "counter"))).alias(fixed))
    joined = marked.join(per_row, row, "left")

    def rewritten(es: Column) -> Column:
        counter = F.coalesce(F.try_element_at(F.col(fixed), F.lit("")), F.lit(0))
        new = F.transform(es, lambda e: surrogate(e, F.coalesce(F.try_element_at(F.col(fixed), e), counter), key))
        between = F.split(F.col("text"), ANY, -1)
        return F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

    listed_again = joined.withColumn(ents, entities_in(text_of()))
    text = F.when(F.size(ents) > 0, let(F.col(ents), rewritten)).otherwise(F.col("text"))
    kept = [text.alias("text") if c == "text" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return listed_again.select(*kept, F.size(F.filter(ents, lambda e: kind_of(e) != "number")).alias(n))


@query("op6_surrogates")
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is no secret here; a caller who wants the map to stay unknown passes one."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "op6_surrogates")
