"""Which of many names occur in which of many texts, without comparing every name with every text.

Names and texts meet on something that a text must have to hold the name: its rarest word, or the rarest three characters
of its longest part, by the frequencies measured in these texts. Only the meeting places travel; a candidate is verified
on a word or token, and on the text itself only if the name goes over several of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import cut

GRAM = 3
#: What separates whole words: everything but these.
WORD = "[a-z0-9_]"


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD}+)"), F.lit(1)))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "\\s+"), lambda t: t != ""))


def _odd_tokens(text: Column) -> Column:
    """Tokens with more than letters and digits: found by one expression, others are passed over."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?:^|\\s)([a-z0-9_]*+[^a-z0-9_\\s]\\S*+)"), F.lit(1)))


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def _rarest_words(words: DataFrame, names: DataFrame) -> DataFrame:
    """(name, word): the word of each name that the fewest texts have; names with a word that no text has are left out."""
    of = names.select("name", F.explode(_words(F.col("name"))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = of.join(counted, "word", "left").groupBy("name").agg(
        F.min_by("word", F.struct("n", "word")).alias("word"), F.count_if(F.col("n").isNull()).alias("missing"))
    return found.where("missing = 0").select("name", "word")


def holders(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """(token, part) for every distinct token that contains the part; ``parts`` (part) are distinct and have no white space.

    A part is looked for where its rarest gram is. A gram that many tokens have leads to these tokens only if every gram
    of the part is that frequent.
    """
    wanted = cut(parts.select("part", F.explode(F.array_distinct(_grams(F.col("part"), GRAM))).alias("gram")))
    every = F.array_distinct(F.concat(*[_grams(F.col("token"), n) for n in range(1, GRAM + 1)]))
    places = cut(tokens.select("token").distinct().select("token", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counted = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A gram that no token has says that the part is nowhere, so it is the rarest.
    rarest = wanted.join(counted, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return places.join(rarest, "gram").where(F.contains("token", F.col("part"))).select("token", "part")


def _longest_part(name: Column) -> Column:
    parts = _tokens(name)
    return F.get(F.array_sort(F.transform(parts, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), 0)["p"]


def _one_part(name: Column) -> Column:
    return ~F.rlike(name, F.lit("\\s"))


def whole_word_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) for every text (id, text; lower case) that holds the name with no ASCII letter, digit or ``_`` beside it.

    ``names`` (name) are distinct, in lower case, stripped and not empty; they may have any characters.
    """
    pattern = F.concat(F.lit(f"(?<!{WORD})\\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{WORD})"))
    one_word = F.rlike("name", F.lit(f"^{WORD}+$"))
    # Written once, so that their size is known when they are joined with the words of all texts.
    names = cut(names.select("name"))
    spread = ~_one_part(F.col("name"))
    asked = cut(names.where(one_word | spread).select(F.explode(_words(F.col("name"))).alias("word")).distinct())

    # Of the words, only those that some name has go further.
    words = cut(texts.select("id", F.explode(_words(F.col("text"))).alias("word")).join(asked, "word", "left_semi"))
    whole = words.join(names.where(one_word).withColumnRenamed("name", "word"), "word").select("id", F.col("word").alias("name"))

    # Other names without white space lie within one token, which has more than letters and digits.
    odd = cut(texts.select("id", F.explode(_odd_tokens(F.col("text"))).alias("token")))
    single = names.where(~one_word & ~spread)
    wordless = names.where(spread & ~F.rlike("name", F.lit(WORD))).withColumn("part", _longest_part(F.col("name")))
    parts = single.select(F.col("name").alias("part")).unionByName(wordless.select("part")).distinct()
    held = cut(holders(odd, parts))
    sure = held.withColumnRenamed("part", "name").join(single, "name", "left_semi").where(F.rlike("token", pattern))
    in_token = odd.join(sure, "token").select("id", "name").distinct()

    # Names of several tokens are looked for by their rarest word, or by their longest part, and found in the text.
    longer = words.join(_rarest_words(words, names.where(spread)), "word").select("id", "name").unionByName(
        odd.join(held.join(wordless, "part").select("token", "name"), "token").select("id", "name"))
    verified = longer.distinct().join(texts, "id").where(F.rlike("text", pattern)).select("id", "name")
    return whole.unionByName(in_token).unionByName(verified)


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, token, part): the tokens of the texts (id, text; lower case) with the parts they contain.

    ``parts`` (part) are distinct and not empty. One that goes over several tokens is verified in the text and comes
    with the token that holds its longest piece.
    """
    tokens = cut(texts.select("id", F.explode(_tokens(F.col("text"))).alias("token")))
    pieces = parts.withColumn("piece", F.when(_one_part(F.col("part")), F.col("part")).otherwise(_longest_part(F.col("part"))))
    held = cut(holders(tokens, pieces.select(F.col("piece").alias("part")).distinct()).withColumnRenamed("part", "piece").join(pieces, "piece"))
    one = tokens.join(held.where(_one_part(F.col("part"))).select("token", "part"), "token").select("id", "token", "part")
    several = tokens.join(held.where(~_one_part(F.col("part"))).select("token", "part"), "token").join(texts, "id").where(
        F.contains("text", F.col("part"))).select("id", "token", "part")
    return one.unionByName(several)
