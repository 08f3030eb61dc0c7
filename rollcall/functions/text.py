"""Normalisation of listed names as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Long forms of titles and their abbreviations.
TITLE_ABBREVIATIONS = {
    "Reverend": "Rev.", "Captain": "Capt.", "Admiral": "Adm.", "Honourable": "Hon.", "Honorable": "Hon.",
    "Colonel": "Col.", "Lieutenant": "Lt.", "General": "Gen.", "Sergeant": "Sgt.", "Esquire": "Esq.",
    "Doctor": "Dr.", "Professor": "Prof.", "Mister": "Mr.", "Mistress": "Mrs.", "Madam": "Mme.",
    "Junior": "Jun.", "Senior": "Sen.", "Viscount": "Visc.", "Lieut": "Lt.", "Mess": "Messrs.",
    "Rt": "Right", "Ld": "Lord", "Saint": "St.",
}
#: Abbreviated first names and places.
NAME_ABBREVIATIONS = {
    "Tho.": "Thomas", "Thos.": "Thomas", "Geo.": "George", "Wm.": "William", "Willm.": "William", "Jno.": "John",
    "Jos.": "Joseph", "Jas.": "James", "Chas.": "Charles", "Chs.": "Charles", "Edw.": "Edward", "Edwd.": "Edward",
    "Richd.": "Richard", "Rich.": "Richard", "Robt.": "Robert", "Rob.": "Robert", "Saml.": "Samuel", "Sam.": "Samuel",
    "Danl.": "Daniel", "Nathl.": "Nathaniel", "Nath.": "Nathaniel", "Benj.": "Benjamin", "Benjn.": "Benjamin",
    "Hy.": "Henry", "Hen.": "Henry", "Humph.": "Humphrey", "Abr.": "Abraham", "Abra.": "Abraham",
    "Alexr.": "Alexander", "Andw.": "Andrew", "Andr.": "Andrew", "Arth.": "Arthur", "Barth.": "Bartholomew",
    "Christo.": "Christopher", "Corns.": "Cornelius", "Edmd.": "Edmund", "Eliz.": "Elizabeth", "Fredk.": "Frederick",
    "Gilb.": "Gilbert", "Jonath.": "Jonathan", "Josh.": "Joshua", "Mattw.": "Matthew", "Matt.": "Matthew",
    "Michl.": "Michael", "Mich.": "Michael", "Nichs.": "Nicholas", "Nich.": "Nicholas", "Patk.": "Patrick",
    "Steph.": "Stephen", "Timoy.": "Timothy", "Walt.": "Walter", "Will.": "William", "Alex.": "Alexander",
    "Dan.": "Daniel", "Ewd.": "Edward", "Fred.": "Frederick", "Cath.": "Catherine", "Christ.": "Christopher",
    "Phila.": "Philadelphia", "Connect.": "Connecticut",
}
#: Title words that tell a gender, without periods.
MASCULINE = ["mr", "esq", "sir", "rev", "capt", "col", "dr", "lt", "adm", "sgt", "prof", "hon"]
FEMININE = ["mrs", "miss", "ms", "dame", "lady"]
#: Abbreviations that end with a period, and words that do not.
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Rev", "Dr", "Capt", "Adm", "Col", "Lt", "Sgt", "Hon", "Prof", "Esq", "Jun", "Sen", "St",
    "Bart", "Bt", "Visc", "Messrs", "Gen", "Mme",
]
WHOLE_WORDS = ["Brown", "Dale", "Lord", "Robert", "John", "Right", "Sir", "Ewen", "William", "James", "Samuel"]
#: How copy counts are written, and peerages that are followed by "of".
COPIES = [r"\s*\d+\s+cop(?:y|ies)", r"\s*\d+\s+sets?", r"\s*\d+\s+cop\.", r"\s*\d+\s+copes?", r"\s*\d+\s+books?", r"\s*\d+\s+do\.?"]
PEERAGES = "Duke|Duchess|Marquess|Marchioness|Earl|Countess|Visc\\.|Viscountess|Baron|Baroness"
TITLES_WITH_OF = [
    "duke", "duchess", "marquess", "marquis", "marchioness", "earl", "countess", "visc", "viscountess", "baron",
    "baroness", "bishop", "archbishop", "dean", "mayor", "dowager", "prince", "princess",
]


#: Patterns of the steps that have no table of words, with what takes their place.
SPACING = [
    (r"\.-([A-Z][a-z])", ". $1"), (r"\.([A-Za-z])", ". $1"), (r"([a-z])([A-Z])", "$1 $2"), (r"(?U)\bMc ([A-Z])", "Mc$1"),
    (r"(?U)\bMac ([A-Z])", "Mac$1"), (r"(?U)([a-z])of(?=\s|[A-Z])", "$1 of"), (r"(?U)\b([A-Z]) \.", "$1."),
]
HONORIFICS = [r"(?:His|Her) Grace the\s+", r"(?:His|Her) (?:Royal )?Highness the\s+", r"His\s+Excellen(?:ce|cy)\s+(?:the\s+)?"]
PEERAGE = (rf"(?U)\b((?:Dowager )?(?:{PEERAGES}))\s+(?!of\b|and\b|the\b|Dowager\b)([A-Z])", "$1 of $2")
DITTO = r"(?iU)\s+(?:\d+\s+)?(?:of\s+)?(?:ditto|do\.?)\s*$"
DASHES = [("[-–—]{2,}", "----"), ("(----)([A-Za-z])", "$1 $2")]
INITIALS = [(r"(?U)\b([A-Z])\.\s*([A-Z])\.", "$1. $2."), (r"(?U)\b([A-Z])\s(?=[A-Z][.\s])", "$1. "), (r"(?<=\. )([A-Z]) (?=[A-Z])", "$1. ")]
PERIODS = [(r"(?U)\.\s*\.", "."), (rf"(?iU)\b({'|'.join(WHOLE_WORDS)})\.\s", "$1 ")]


def _replaced(c: Column, steps) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def literal_map(pairs: Mapping[str, str]) -> Column:
    if not pairs:
        return F.create_map(F.lit(""), F.lit(None).cast("string"))
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(c: Column) -> Column:
    """The words between white space; none for a blank string."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends (E5)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def alternation(keys) -> str:
    """Word-bounded pattern of the keys, the longest first, without regard to case."""
    escaped = "|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True))
    return rf"(?iU)\b({escaped})\b"


def replace_words(c: Column, words: Mapping[str, str]) -> Column:
    """Each whole word or phrase of ``words`` by its replacement, in one pass and without regard to case.

    Phrases go by a pattern each; words go by a lookup per word, whose cost does
    not grow with the lexicon.
    """
    phrases = {k: v for k, v in words.items() if not re.fullmatch(r"\w+", k)}
    for key in sorted(phrases, key=len, reverse=True):
        c = F.regexp_replace(c, alternation([key]), F.lit(phrases[key].replace("$", r"\$")))
    lookup = literal_map({k.lower(): v for k, v in words.items() if k not in phrases})
    pieces = F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda t: F.coalesce(F.try_element_at(lookup, F.lower(t)), t)), "")


def strip_punctuation(c: Column) -> Column:
    """Commas and semicolons to spaces, [?] away, ampersands spelt out."""
    return F.replace(F.replace(F.translate(c, ",;", "  "), F.lit("[?]"), F.lit("")), F.lit(" & "), F.lit(" and "))


def repair_spacing(c: Column) -> Column:
    """Spaces that are missing after periods and between words, or too many in Mc and Mac names."""
    return _replaced(c, SPACING)


def abbreviation_periods(c: Column) -> Column:
    """Known abbreviations in their usual case with exactly one period; Miss with none."""
    marks = {a: a + "\u0001" for a in ABBREVIATIONS} | {"Miss": "Miss\u0002"}
    marked = replace_words(c, marks)
    return F.regexp_replace(F.regexp_replace(marked, "\u0001\\.?", "."), "\u0002\\.?", "")


def strip_honorifics(c: Column) -> Column:
    """Grace, Highness and Excellency before another title."""
    return _replaced(c, [(f"(?iU){pattern}", "") for pattern in HONORIFICS])


def insert_peerage_of(c: Column) -> Column:
    """``Duke Bedford`` to ``Duke of Bedford``."""
    return _replaced(c, [PEERAGE])


def expand_first_names(c: Column) -> Column:
    """Abbreviated first names spelt out; Fran. by the gender of the titles beside it."""
    lookup = {"jn.": "John", "jn": "John"}
    for short, full in NAME_ABBREVIATIONS.items():
        lookup.setdefault(short.lower(), full)
        if len(short) > 2:
            lookup.setdefault(short.rstrip(".").lower(), full)
    known = literal_map(lookup)

    def full(words: Column) -> Column:
        bare = F.transform(words, lambda t: F.regexp_replace(F.lower(t), r"\.+$", ""))
        masculine, feminine = (F.arrays_overlap(bare, F.array(*map(F.lit, s))) for s in (MASCULINE, FEMININE))
        francis = F.when(masculine & ~feminine, "Francis").when(feminine & ~masculine, "Frances")
        return let(francis, lambda f: F.array_join(F.transform(words, lambda t: F.coalesce(F.when(F.lower(t).isin("fran.", "fran"), f), F.try_element_at(known, F.lower(t)), t)), " "))

    return let(tokens(c), full)


def strip_leading_the(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)^The\s+", "")


def strip_annotations(c: Column) -> Column:
    """Copy counts, anywhere."""
    return F.regexp_replace(c, "(?iU)" + "|".join(f"(?:{p})" for p in COPIES), "")


def strip_ditto(c: Column) -> Column:
    return _replaced(c, [(DITTO, "")])


def normalize_dashes(c: Column) -> Column:
    return _replaced(c, DASHES)


def standardize_initials(c: Column) -> Column:
    """Initials with periods and spaces."""
    return _replaced(c, INITIALS)


def strip_trailing(c: Column) -> Column:
    """Colons at the end, and a period there unless it belongs to an abbreviation."""

    def cut(x: Column) -> Column:
        last = F.element_at(F.split(x, r"(?U)\s+"), -1)
        known = F.regexp_replace(last, r"\.+$", "").isin(ABBREVIATIONS)
        short = (F.length(last) <= 4) & last.rlike(r"[A-Za-z]\.")
        return F.when(x.endswith(".") & ~known & ~short, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)

    return let(F.regexp_replace(c, ":+$", ""), cut)


def clean_periods(c: Column) -> Column:
    """Double periods, and periods after words that are no abbreviations."""
    return _replaced(c, PERIODS)


def strip_geographic_of(c: Column) -> Column:
    """E18, off by default: " of " to a space unless a title comes before it."""
    titles = "|".join(TITLES_WITH_OF)
    kept = F.regexp_replace(c, rf"(?iU)(?<=^|\s)({titles})(\.*) of ", "$1$2\u0001of ")
    return F.replace(F.replace(kept, F.lit(" of "), F.lit(" ")), F.lit("\u0001of "), F.lit(" of "))


def normalize_name(c: Column, spelling: Mapping[str, str] | None = None) -> Column:
    """All of the above, in their order. ``spelling`` maps misspellings to corrections."""
    c = squeeze(repair_spacing(strip_punctuation(c)))
    c = replace_words(c, spelling) if spelling else c
    c = abbreviation_periods(replace_words(c, TITLE_ABBREVIATIONS))
    for step in (
        strip_honorifics, insert_peerage_of, expand_first_names, strip_leading_the, strip_annotations, strip_ditto,
        normalize_dashes, standardize_initials, strip_trailing, clean_periods, squeeze,
    ):
        c = step(c)
    return c


def changed(before: Column, after: Column) -> Column:
    """How many values a step has changed, as an aggregate."""
    return F.count_if(~before.eqNullSafe(after))
