"""Licence texts among documents, by digests of canonical texts.

A text is made canonical: lower case, copyright notices left out, everything but
letters and digits a blank, equivalent spellings of whole words made one. Where
lines break makes no difference. The digest of the whole canonical text is
joined to the digests of known licences, made canonical the same way. Only
built-in functions are used.

The known licences are the table of texts in ``licence_texts``, a file for each,
and what is made of them by rule: with a usual heading, and without what follows
the end of the terms. A notice or a sentence that names a licence is no licence
text and not found.

Defined results: a null text has no digest and no licence; an empty one has the
digest of nothing; repeated rows each get a row; an empty table gives an empty
one; only the columns named are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import null_safe

TEXTS = Path(__file__).parent / "licence_texts"
# fixed values: headings that a licence's text may have, and the line after which
# only advice on its use follows
HEADINGS = {
    "MIT": ("MIT License", "The MIT License (MIT)", "The MIT License"),
    "ISC": ("ISC License",),
    "0BSD": ("BSD Zero Clause License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "Zlib": ("zlib License",),
}
LAST_LINE = "END OF TERMS AND CONDITIONS"

# fixed values: spellings that mean the same, the second being kept; whole words
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencee", "licensee"),
    ("licencees", "licensees"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("favourable", "favorable"),
    ("honour", "honor"),
    ("honoured", "honored"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantability and fitness", "merchantability fitness"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("whilst", "while"),
    ("programme", "program"),
    ("programmes", "programs"),
    ("analogue", "analog"),
)
# fixed values: notices, in lower case; a line's notice begins the line and has a year
NOTICE_LINES = r"(?m)^[^\p{L}\n(]*(copyright[ \t]*(\(c\)|©)?|\(c\)|©)[ \t]*[0-9]{4}[^\n]*$"
NOT_LETTERS = r"[^\p{L}\p{N}]+"
NOTICE_WORDS = tuple(
    words.replace(" ", NOT_LETTERS)
    for words in (
        "copyright (c )?([0-9]{4} )+free software foundation inc( https fsf org)?",
        "all rights reserved",
    )
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    plain = F.lower(text)
    for words in NOTICE_WORDS:
        plain = F.regexp_replace(plain, words, " ")
    plain = F.regexp_replace(plain, NOTICE_LINES, " ")
    # two blanks between words, so that each has its own on both sides
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, NOT_LETTERS, "  "), F.lit(" "))
    for spelling, kept in SPELLINGS:
        spaced = [f" {w.replace(' ', '  ')} " for w in (spelling, kept)]
        plain = F.replace(plain, F.lit(spaced[0]), F.lit(spaced[1]))
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def licence_digests(known: DataFrame, name: str = "license", text: str = "text") -> DataFrame:
    """``digest`` and ``license`` of known licences, one name per digest."""
    return (
        known.select(F.col(name).alias("license"), F.sha2(canonical(F.col(text)), 256).alias("digest"))
        .groupBy("digest")
        .agg(F.min("license").alias("license"))
    )


def known_texts() -> list[tuple[str, str]]:
    """Name and text of every known licence, a licence more than once where its
    text has several forms."""
    found = []
    for file in sorted(TEXTS.glob("*.txt")):
        whole = file.read_text(encoding="utf-8")
        terms, line, _ = whole.partition(LAST_LINE)
        for text in {whole, terms + line}:
            found += [(file.stem, text)]
            found += [(file.stem, f"{heading}\n\n{text}") for heading in HEADINGS.get(file.stem, ())]
    return sorted(found)


def known_licences(docs: DataFrame) -> DataFrame:
    """The known licences as a table."""
    return docs.sparkSession.createDataFrame(known_texts(), "license string, text string")


def licence_scan(
    docs: DataFrame, known: DataFrame | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: its id, ``canonical_sha256``, ``canonical_chars`` and the
    ``license`` whose whole text it is, or null.

    ``known`` (columns ``license``, ``text``) may be of any size; the join is
    Spark's choice by the size of its digests.
    """
    digests = licence_digests(known_licences(docs) if known is None else known)
    digests = digests.where(F.col("digest").isNotNull())
    made = docs.select(F.col(id).alias("id"), canonical(F.col(text)).alias("plain")).select(
        "id",
        F.sha2("plain", 256).alias("canonical_sha256"),
        F.length("plain").cast("bigint").alias("canonical_chars"),
    )
    # a text that a third of all documents are is a skewed key
    same = null_safe(made, digests, [("canonical_sha256", "digest")])
    return made.join(digests, same, "left").select(
        F.col("id").alias(id), "canonical_sha256", "canonical_chars", "license"
    )
