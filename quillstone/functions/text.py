"""Canonical names and addresses as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.maps import ADDRESS, LEGAL, LOOK_ALIKE, NAME_STOP, REGION_PHRASES, REGIONS, SKELETON, TOP_LEVEL, TRAILING_ID, WEB

def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def mapped(tokens: Column, values: dict[str, str]) -> Column:
    """Each token's value in the map, or the token."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(literal_map(values), t), t))


# What takes the inherent vowel of the Indic letter before it.
_MUTE = "\x01"


def _letter(ch: str) -> str:
    """A letter of any script from its Unicode name: the name's last word, with the mark before vowel signs and viramas."""
    name = unicodedata.name(ch, "")
    if "SIGN VIRAMA" in name:
        return _MUTE
    if "NUKTA" in name:
        return ""
    if "ANUSVARA" in name or "CANDRABINDU" in name:
        return "n"
    said = re.split(" WITH | LETTER | LIGATURE ", name)[min(1, name.count(" LETTER ") + name.count(" LIGATURE "))].rsplit(" ", 1)[-1].lower()
    if "VOWEL SIGN" in name:
        return _MUTE + name.rsplit(" ", 1)[-1].lower()
    if " LETTER " not in name and " LIGATURE " not in name or not said.isascii() or said == "sign":
        return ""
    if name.startswith("GREEK"):  # alpha: a, theta: th
        return "r" if said == "rho" else re.match("[^aeiou]+|.", said)[0]
    if name.startswith("CYRILLIC"):  # be: b, el: l, shcha: shch; a, ya and the like as they are
        return "e" if said == "ie" else re.sub("(?<=[^aeiouy])[aeiou]$|^e(?=[^aeiou]$)", "", said)
    return said


def _spelt(ch: str) -> str | None:
    """ASCII for a character: itself under NFKC without marks, a digit's value, or a letter's name; None if there is none."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x) or x == ch)
    if plain.isascii():
        return plain
    if unicodedata.combining(ch) and not unicodedata.name(ch, "").count("SIGN"):
        return ""
    if ch.isdigit():
        return str(unicodedata.digit(ch))
    return _letter(plain[0]) or None


# Latin letters and marks, Greek, Cyrillic, the scripts of India, compatibility forms.
_RANGES = ((0xA0, 0x250), (0x300, 0x530), (0x900, 0xE00), (0x1E00, 0x1F00), (0x2000, 0x20A0), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
SPELT = {chr(c): to for low, high in _RANGES for c in range(low, high) if (to := _spelt(chr(c))) is not None and to != chr(c)}
NON_ASCII, INDIC = r"[^\x00-\x7F]", "[\u0900-\u0DFF]"


_ONE, _NONE, _MANY = ({c: to for c, to in SPELT.items() if min(len(to), 2) == n} for n in (1, 0, 2))
_FROM, _TO = "".join([*_ONE, *_NONE]), "".join(_ONE.values())


def to_ascii(c: Column) -> Column:
    """Lower case, compatibility forms and accents resolved, other scripts spelt letter by letter; null is empty. Built-in
    expressions: a translation of single characters, and only for texts that are still not ASCII a look-up of the rest."""
    text = F.translate(F.coalesce(c, F.lit("")), _FROM, _TO)
    longer = F.from_json(F.lit(json.dumps(_MANY)), "map<string, string>")
    letters = F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(longer, ch), ch))
    spelt = F.regexp_replace(F.array_join(letters, ""), f"a?{_MUTE}", "")
    return F.lower(F.when(text.rlike(f"{NON_ASCII}|{_MUTE}"), spelt).otherwise(text))


# Marks at the edges of an Indic word.
EDGE = r"""^[.,;:!?()\[\]{}"'`\-/&|\u0964\u0965]+|[.,;:!?()\[\]{}"'`\-/&|\u0964\u0965]+$"""


def learned_dictionary(s1: DataFrame, pool: DataFrame, truth: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """token, latin: the Latin form that an Indic word most often stands for in true pairs of names with as many words, if
    it does so `least` times and in `share` of them. Ties go to the form that sorts first."""
    words_of = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    indic = pool.filter(F.col("business_name").rlike(INDIC)).select(F.col("entity_id").alias("match_id"), words_of(F.col("business_name")).alias("a"))
    latin = s1.select(F.col("entity_id").alias("s1_id"), words_of(F.col("business_name")).alias("b"))
    pairs = indic.join(truth.filter("match_id IS NOT NULL"), "match_id").join(latin, "s1_id").filter(F.size("a") == F.size("b"))
    rows = pairs.select(F.explode(F.arrays_zip("a", "b")).alias("x")).filter(F.col("x.a").rlike(INDIC))
    rows = rows.select(F.regexp_replace(F.col("x.a"), EDGE, "").alias("token"), F.regexp_replace(to_ascii(F.col("x.b")), "[^a-z0-9]", "").alias("latin")).filter("token <> '' AND latin <> ''")
    counts = rows.groupBy("token", "latin").agg(F.count("*").alias("n"))
    best = counts.groupBy("token").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "latin")).alias("best"))
    return best.filter((-F.col("best.m") >= least) & (-F.col("best.m") >= share * F.col("total"))).select("token", F.col("best.latin").alias("latin"))


def with_latin_names(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Records whose names have the dictionary's Latin form for each Indic word that it knows. Only words of names with
    Indic letters are looked up; both sides are dealt by word."""
    indic = records.filter(F.col("business_name").rlike(INDIC))
    split = F.filter(F.split("business_name", r"\s+"), lambda t: t != "")
    placed = indic.select("entity_id", F.posexplode(split).alias("at", "word")).withColumn("token", F.when(F.col("word").rlike(INDIC), F.regexp_replace("word", EDGE, "")))
    said = placed.join(dictionary, "token", "left").withColumn("word", F.coalesce("latin", "word"))
    names = said.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("latin_name"))
    joined = records.join(names, "entity_id", "left")
    return joined.withColumn("business_name", F.coalesce("latin_name", "business_name")).select(*records.columns)


def scorer_text() -> Column:
    """What a second scorer reads of a record."""
    return F.concat("name_full", F.lit(" | "), "addr")


def tokens(c: Column) -> Column:
    """Words, with & and @ spelt out and other marks as spaces."""
    spelt = F.regexp_replace(F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("@"), F.lit(" at ")), r"[^\w\s]", " ")
    return F.filter(F.split(spelt, r"\s+"), lambda t: t != "")


def without_web(c: Column) -> Column:
    """A name without scheme, www, @, top-level domain and trailing id."""
    for pattern in (WEB, TOP_LEVEL, TRAILING_ID):
        c = F.regexp_replace(c, pattern, "")
    return c


def unleet(t: Column) -> Column:
    """Digits that look like letters, at a word's start or after a letter, and before one; in words of 3 letters or more."""
    out = t
    for digit, letter in LOOK_ALIKE.items():
        out = F.regexp_replace(out, rf"(?:^|(?<=[a-z])){digit}(?=[a-z])", letter)
    return F.when((F.length(F.regexp_replace(t, "[^a-z]", "")) >= 3) & t.rlike("[0-9]"), out).otherwise(t)


def join_initials(c: Column) -> Column:
    """Single letters that follow each other become one word; over space-joined tokens."""
    return F.regexp_replace(c, r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")


def skeleton(c: Column) -> Column:
    for pattern, to in SKELETON:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def words(c: Column) -> Column:
    """Tokens of a normalised text; empty for the empty text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_full(raw: Column) -> Column:
    spaced = F.array_join(F.transform(tokens(without_web(F.trim(to_ascii(raw)))), unleet), " ")
    return F.array_join(mapped(words(join_initials(spaced)), LEGAL), " ")


def name_core(full: Column) -> Column:
    left_out = sorted(set(LEGAL.values()) | set(NAME_STOP))
    core = F.array_join(F.filter(words(full), lambda t: ~t.isin(left_out)), " ")
    return F.when(core == "", full).otherwise(core)


def norm_address(raw: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(to_ascii(raw), r"[^\w\s]", " "), r"\s+", " ")
    replaced = s
    for phrase, code in REGION_PHRASES.items():
        replaced = F.regexp_replace(replaced, rf"\b{phrase}\b", code)
    s = F.when(s.rlike(rf"\b(?:{'|'.join(REGION_PHRASES)})\b"), replaced).otherwise(s)
    t = mapped(mapped(F.filter(F.split(s, " "), lambda t: t != ""), REGIONS), ADDRESS)
    bare = F.transform(t, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(\d+)(?:st|nd|rd|th)$", "$1"), r"^0+(?=\d)", ""))
    return F.array_join(F.filter(bare, lambda x: x != ""), " ")


def postcode(raw: Column) -> Column:
    s = to_ascii(raw)
    last = lambda p: F.try_element_at(F.regexp_extract_all(s, F.lit(p), F.lit(0)), F.lit(-1))
    return F.coalesce(last(r"\b[1-9]\d{5}\b"), last(r"\b(?!00)\d{5}\b"), F.lit(""))


def numbers(address: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(address, F.lit(r"\d+"), F.lit(0)))), " ")


def house_number(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"\b(\d+)", 1), F.lit(""))


def compact(core: Column) -> Column:
    return F.replace(core, F.lit(" "), F.lit(""))


def initials(core: Column) -> Column:
    return F.array_join(F.transform(words(core), lambda t: F.substring(t, 1, 1)), "")


def city(raw: Column) -> Column:
    """Second-to-last comma part, lower case, digits removed, trimmed."""
    part = F.try_element_at(F.split(F.coalesce(raw, F.lit("")), ","), F.lit(-2))
    return F.trim(F.regexp_replace(F.lower(F.coalesce(part, F.lit(""))), r"\d", ""))


def normalised(records: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """entity_id, business_name, business_address, country -> those and the seven canonical columns, and src. Nulls are
    empty texts. One narrow projection; with a dictionary of Indic words, after a join of the names that have such."""
    if dictionary is not None:
        records = with_latin_names(records, dictionary)
    named = records.withColumn("name_full", name_full(F.col("business_name"))).withColumn("addr", norm_address(F.col("business_address")))
    cored = named.withColumn("name_core", name_core(F.col("name_full")))
    return cored.withColumns({
        "name_skel": skeleton(F.col("name_core")),
        "postcode": postcode(F.col("business_address")),
        "addr_nums": numbers(F.col("addr")),
        "country_n": F.lower(F.trim(F.coalesce("country", F.lit("")))),
        "src": F.substring("entity_id", 1, 2),
    })
