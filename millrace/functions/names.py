"""Names of people, places and groups by rules and lists, where no trained recogniser is at hand."""

from __future__ import annotations

import re
import zoneinfo
from functools import lru_cache

from pyspark.sql import SparkSession

_NAME = r"[^\W\d_a-z][\w'’-]+"
#: A name follows a title, or words that introduce one; up to three capitalised words, with particles between them.
PERSON = re.compile(
    rf"(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|President|Senator|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Don|Doña)\b\.?\s+|\b(?i:my name is|his name is|her name is|their name is|is called|was named|signed by|je m'appelle|ich heiße|me llamo)\s+)"
    rf"(?!(?:Mr|Mrs|Ms|Miss|Dr|Prof)\b)(?P<it>{_NAME}(?:\s+(?:(?:van|von|de|der|del|la|le|bin|al)\s+){{0,2}}{_NAME}){{0,2}})"
)
#: Nationalities, religions and political groups.
GROUPS = """
Afghan Albanian Algerian American Argentine Argentinian Armenian Australian Austrian Bangladeshi Belgian Bolivian Brazilian British Bulgarian Cambodian Canadian Chilean Chinese
Colombian Croatian Cuban Cypriot Czech Danish Dutch Egyptian English Estonian Ethiopian European Finnish French Georgian German Ghanaian Greek Hungarian Icelandic Indian
Indonesian Iranian Iraqi Irish Israeli Italian Jamaican Japanese Jordanian Kenyan Korean Kuwaiti Latvian Lebanese Libyan Lithuanian Malaysian Mexican Moroccan Nepalese Nigerian
Norwegian Pakistani Palestinian Peruvian Polish Portuguese Romanian Russian Saudi Scottish Serbian Slovak Slovenian Somali Spanish Sudanese Swedish Swiss Syrian Taiwanese Thai
Tunisian Turkish Ukrainian Uruguayan Venezuelan Vietnamese Welsh
Anglican Baptist Buddhist Catholic Christian Hindu Islamic Jewish Lutheran Methodist Mormon Muslim Orthodox Protestant Shia Sikh Sunni
Communist Conservative Democrat Democratic Liberal Republican Socialist
""".split()
NRP = re.compile(rf"\b(?:{'|'.join(GROUPS)})s?\b")


def place_names(spark: SparkSession) -> tuple[str, ...]:
    """Countries as the JVM's locale data calls them in four languages, and the cities and regions that time zones are named after."""
    jvm = spark.sparkContext._jvm
    names = set()
    for language in ("en", "de", "fr", "es"):
        shown = jvm.java.util.Locale.forLanguageTag(language)
        names |= {jvm.java.util.Locale.forLanguageTag(f"und-{code}").getDisplayCountry(shown) for code in jvm.java.util.Locale.getISOCountries()}
    for zone in zoneinfo.available_timezones():
        area, _, rest = zone.partition("/")
        if rest and area in ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific"):
            names |= {part.replace("_", " ") for part in rest.split("/")}
    return tuple(sorted(n for n in names if len(n) > 2))


@lru_cache(2)
def places(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(re.escape(n) for n in sorted(names, key=len, reverse=True))})\b")
