"""Licence scan by canonical digest lookup.

A text is brought to its canonical form: lower case; lines of a copyright
statement, of ``all rights reserved`` or of an old address of the publisher of the
GNU licences alone dropped; all that is no letter or digit taken as one blank;
equivalent spellings made one, word by word; a leading title such as ``the mit
license`` dropped. The SHA-256 of the whole canonical text is then hash-joined to
the digests of the known licences, which the same expressions make.

The known licences are the files of ``texts``, named by their identifiers (what
follows ``.`` and no digit tells variants apart). A text with ``end of terms and
conditions`` is known with and without what follows that line. The list is fixed
(under 100 rows), so that side is broadcast; a caller's table is only if it has
at most BROADCAST_LICENSES rows.

Every row is returned; ``license`` is null where the text is no known licence.
Null and empty texts have the digest of '' and no licence; repeated rows give
repeated results, and so do ties: of licences with one digest the first by name
is taken.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A caller's table of so many digests (of some 100 bytes) is broadcast; a larger one is joined by a shuffle.
BROADCAST_LICENSES = 50_000

# Equivalent spellings of words, then titles that may precede a text.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog",
    "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "merchantibility": "merchantability",
    "modelled": "modeled", "noninfringement": "non infringement", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "http": "https", "acknowledgement": "acknowledgment", "behaviour": "behavior", "percent": "per cent",
}
TITLES = "^(the )?(mit|isc|zlib|unlicense|boost software|bsd( [0-4])?( clause)?|new bsd|modified bsd|simplified bsd|zero clause bsd)( license)?( mit| version 1 0)?( license)? "
COPYRIGHT_START = "(copyright[^\\p{L}\\p{N}]*(\\(c\\)|©|[0-9]{4}|<|\\[|by )|\\(c\\) *[0-9]|© *[0-9]|all rights reserved|(51 franklin st|59 temple place|675 mass ave)[^\n]*(boston|cambridge|floor))"


@cache
def texts() -> tuple[tuple[str, str], ...]:
    """(identifier, text) of the known licences and their variants, in order."""
    out = []
    for file in sorted(resources.files("tessera.llm").joinpath("texts").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, body = re.sub(r"\.[a-z]+$", "", file.name.removesuffix(".txt")), file.read_text(encoding="utf-8")
            out.append((name, body))
            if m := re.search(r"(?im)^[^\w\n]*END OF TERMS AND CONDITIONS[^\n]*\n", body):
                out += [(name, body[: m.start()]), (name, body[: m.end()])]
    return tuple(out)


def canonical(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    # A line is a copyright line if it begins with such a statement, whatever stands before its first letter.
    low = F.regexp_replace(low, f"(^|\n)[^\n\\p{{L}}\\p{{N}}(©]*{COPYRIGHT_START}[^\n]*", "$1")
    words = F.split(F.trim(F.regexp_replace(low, "[^\\p{L}\\p{N}]+", " ")), " ")
    spelt = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    flat = F.array_join(F.transform(words, lambda w: F.when(w.isin(*SPELLINGS), F.element_at(spelt, w)).otherwise(w)), " ")
    return F.trim(F.regexp_replace(F.replace(flat, F.lit("copyright holder"), F.lit("copyright owner")), TITLES, ""))


def known(spark: SparkSession, of: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, known_sha256) of (identifier, text); of the fixed list if none is given."""
    rows = spark.createDataFrame(list(texts() if of is None else of), "license string, body string")
    return rows.groupBy(F.sha2(canonical(F.col("body")), 256).alias("known_sha256")).agg(F.min("license").alias("license")).select("license", "known_sha256")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", licenses: DataFrame | None = None) -> DataFrame:
    """Per row its key, the digest of its canonical text and the licence it is, if any."""
    if licenses is None:
        licenses = F.broadcast(known(df.sparkSession))
    else:
        licenses = licenses.groupBy("known_sha256").agg(F.min("license").alias("license"))
        licenses = F.broadcast(licenses) if licenses.count() <= BROADCAST_LICENSES else licenses
    digests = df.select(F.col(key).alias(key), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    found = digests.join(licenses, F.col("canonical_sha256") == F.col("known_sha256"), "left")
    return found.select(key, "canonical_sha256", "license")


def oracle() -> str:
    """The same in SQL of the oracle."""
    start = COPYRIGHT_START.replace("'", "''")
    spelt = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items())

    def form(text: str) -> str:
        sql = f"regexp_replace(lower(coalesce({text}, '')), '(^|\n)[^\n\\p{{L}}\\p{{N}}(©]*{start}[^\n]*', '\\1', 'g')"
        sql = f"string_split(trim(regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
        sql = f"array_to_string(list_transform({sql}, lambda w: CASE w {spelt} ELSE w END), ' ')"
        return f"sha256(trim(regexp_replace(replace({sql}, 'copyright holder', 'copyright owner'), '{TITLES}', '')))"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in texts())
    return f"""WITH known AS (SELECT min(license) AS license, known_sha256 FROM (SELECT license, {form("body")} AS known_sha256 FROM (VALUES {values}) AS k(license, body)) GROUP BY ALL)
        SELECT doc_id, d AS canonical_sha256, license
        FROM (SELECT doc_id, {form("text")} AS d FROM documents) LEFT JOIN known ON d = known_sha256"""
