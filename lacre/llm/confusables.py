"""Visually identical text: confusables skeletons.

skeleton(text) = decompose (NFKD), drop what shows nothing, replace every character by its prototype, decompose again;
blanks become one space. Two texts that look alike have equal skeletons, so the match is an equi-join on them.

The look-alike table is that of Unicode's security mechanisms (UTS #39), read from the ICU library that Spark ships: all
letters and digits of all scripts whose prototype is another text, prototypes of several letters (m: rn) and digits (0: O,
1: l) included. Small capitals count as the small letter they are drawn like. Accents, punctuation and letter case stay,
as they are part of how a text reads; only marks listed under PROTOTYPES are drawn alike.

Defined results: a null text has a null skeleton; a text without visible characters has an empty one and matches
nothing; very long texts are handled whole; repeated records yield one row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Characters drawn like the Latin character at the head of their line (after NFKD), beside ICU's table.
PROTOTYPES = {
    "A": "ΑАᎪᗅꓮ", "B": "ΒВᏴᗷꓐ", "C": "СϹᏟꓚⅭ", "D": "Ꭰᗞꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝᖴꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀᏆꓲ",
    "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗ", "L": "Ꮮᒪꓡ", "M": "ΜМᎷꓟϺ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ",
    "T": "ΤТᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑα", "b": "Ƅᖯ", "c": "сϲᴄ", "d": "ԁᏧ", "e": "е", "f": "ẝ", "g": "ɡցᶃ", "h": "һհ", "i": "іıιɩ", "j": "јϳ", "k": "ⲕ", "l": "ӏ",
    "n": "ոռ", "o": "оοօᴏσ", "p": "рρ", "q": "ԛգ", "r": "ᴦ", "s": "ѕꜱ", "u": "υսʋᴜ", "v": "ѵνᴠ", "w": "ԝաᴡ", "x": "х",
    "y": "уүγ", "z": "ᴢ", "'": "ʼ’‘‛ʹʻ′＇", '"': "“”„‟″", "-": "‐‑‒–−﹘", ".": "․", ",": "‚", ":": "ː∶꞉", ";": ";", "/": "⁄∕", "!": "ǃ",
}
#: Letters NFKD leaves alone although they are typeface variants.
VARIANTS = {"ſ": "s", "ƽ": "s"}


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code point -> prototype: some thousand entries, the same for any data, made in one call to the JVM."""
    import unicodedata

    asked = [c for c in map(chr, (*range(0x30, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x17000), *range(0x1D400, 0x1F000))) if unicodedata.category(c)[0] in "LN"]
    made = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(asked)).split("\n")
    table = {ord(c): p for c, p in zip(asked, made, strict=True) if p != c}
    small = {}
    for x in {x for p in (*table.values(), *asked) for x in p}:
        name = unicodedata.name(x, "").split()
        if name[:4] == ["LATIN", "LETTER", "SMALL", "CAPITAL"] and len(name) == 5 and len(name[4]) == 1:
            small[ord(x)] = name[4].lower()
    small[ord("\u028d")] = "m"  # a turned w, the prototype of letters drawn like m
    again = lambda p: "".join(table.get(ord(x), x) for x in p.translate(small))
    table = {c: q for c, p in {**{c: chr(c) for c in small}, **table}.items() if (q := again(p)) != chr(c)}
    listed = {ord(c): latin for latin, others in PROTOTYPES.items() for c in others} | {ord(c): v for c, v in VARIANTS.items()}
    return table | {c: "".join(table.get(ord(x), x) for x in p) for c, p in listed.items()}


def skeleton_function(table: dict[int, str]):
    """The skeleton of one text, as a plain function; table: see look_alikes()."""
    import re
    import unicodedata

    invisible = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f]")
    plain = re.compile(r"[\x20-\x7e]*\Z")
    blank = re.compile(r"\s+")

    def skeleton(text: str) -> str:
        if plain.match(text):
            text = text.translate(table)
        else:
            text = unicodedata.normalize("NFKD", invisible.sub("", text)).translate(table)
            text = unicodedata.normalize("NFKD", text)
        return blank.sub(" ", text).strip()

    return skeleton


def skeleton_column(text: Column, table: dict[int, str]) -> Column:
    @pandas_udf("string")
    def skeletons(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = skeleton_function(table)
        for s in batches:
            yield pd.Series([None if t is None else one(t) for t in s])

    return skeletons(text)


def group_by_skeleton(records: DataFrame, text: str) -> DataFrame:
    """Records with the skeleton of their text; equal skeletons are one class."""
    return records.withColumn("skeleton", skeleton_column(F.col(text), look_alikes(records.sparkSession)))


def found(spans: DataFrame, evidences: DataFrame, phrases: DataFrame) -> DataFrame:
    """src, rec_id, phrase_id of every field that reads like a phrase but is another sequence of characters."""
    fields = spans.select(F.lit("spans.text").alias("src"), F.col("span_id").alias("rec_id"), "text")
    fields = fields.unionByName(
        evidences.select("evidence_id", F.explode(F.create_map(F.lit("evidences.original_excerpt"), F.col("original_excerpt"), F.lit("evidences.normalized_excerpt"), F.col("normalized_excerpt"))).alias("src", "text")).select("src", F.col("evidence_id").alias("rec_id"), "text")
    ).where("text is not null")
    listed = group_by_skeleton(phrases.select("phrase_id", "phrase"), "phrase").where("skeleton != ''")
    # phrases: a fixed catalogue of some hundred rows
    hits = group_by_skeleton(fields, "text").join(F.broadcast(listed), "skeleton").where("text != phrase")
    return hits.select("src", "rec_id", "phrase_id").distinct()
