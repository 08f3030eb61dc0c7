"""Names into typed fields (G1-G16), as successive projections of Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import let, literal_map, normalize_name, tokens

#: Columns that the parser adds, in order.
PARSED = [
    "name_type", "title_key", "parsed_title", "parsed_first", "parsed_last", "parsed_postnominals", "parsed_occupation",
    "parsed_affiliation", "parsed_location", "parsed_notes",
]
#: Ranks that with "of" and a place make one identity, and first words that do.
RANKS = [
    "Dowager Duchess", "Dowager Marchioness", "Dowager Countess", "Dowager Viscountess", "Dowager Baroness",
    "Duchess", "Duke", "Marquess", "Marquis", "Marchioness", "Earl", "Countess", "Viscountess", r"Visc\.",
    "Baroness", "Baron", "Lord Bishop", "Archbishop", "Bishop", "Dean", "Lord Mayor", "Prince", "Princess",
]
TRIGGERS = [
    "duke", "duchess", "marquess", "marquis", "marchioness", "earl", "countess", "viscount", "viscountess", "visc",
    "baron", "baroness", "archbishop", "bishop", "dean", "prince", "princess", "lord", "lady", "dowager",
]
#: Titles before a name, alone and in pairs.
LEADING = [
    "mr.", "mrs.", "ms.", "miss", "rev.", "dr.", "capt.", "col.", "lt.", "adm.", "sgt.", "prof.", "hon.", "sir",
    "dame", "mme.", "messrs.", "gen.", "alderman", "major", "maj.",
]
LEADING_PAIRS = ["lt. gen.", "lt. col.", "right hon.", "right rev."]
#: Letters after a name, written together and apart.
POSTNOMINALS = ["esq.", "bart.", "bt.", "jun.", "sen.", "m.d.", "m.p.", "d.d.", "f.r.s.", "ll.d.", "w.s.", "d.f."]
POSTNOMINAL_PAIRS = ["m. d.", "m. p.", "d. d.", "w. s.", "d. f.", "r. a."]
#: Words before "of" that do not lead to a place, and words that are no places.
BEFORE_OF = [
    "duke", "duchess", "marquess", "marquis", "marchioness", "earl", "countess", "visc", "viscountess", "baron",
    "baroness", "bishop", "archbishop", "dean", "mayor", "dowager", "prince", "princess", "son",
]
NO_PLACES = ["esq", "esq.", "bart", "bart.", "jun", "jun.", "sen", "sen.", "ditto", "do", "do."]
AFFILIATION = (
    r"(?iU)\b((?:Inner|Middle) Temple|Lincoln'?s Inn|Gray'?s Inn|Royal Navy|Royal Artillery|Royal Society"
    r"|Trinity Coll(?:ege|\.)?|Queen'?s Coll(?:ege|\.)?|King'?s Coll(?:ege|\.)?|\w+ Coll(?:ege|\.)|T\.?\s?C\.?\s?D\.?"
    r"|\d+\w*\s+regiment)\b"
)
_COUNT = r"\d+\s+(?:cop(?:y|ies|\.)|copes?|books?|sets?|do\.?)"
COPY_COUNT = rf"(?iU)\b({_COUNT})\b"
COPY_TAIL = rf"(?iU)\b{_COUNT}\b.*$"


def _any(values: Iterable[str]) -> str:
    return "|".join(v if "\\" in v else v.replace(".", r"\.") for v in values)


#: Forms of titles, of names after a title, and of offices within a name.
_POSITIONAL = rf"(?iU)^({_any(RANKS)})\s+of\s+(.+)$"
_EMBEDDED = rf"(?iU)({_any(RANKS)})\s+of\s+(.+)$"
_BARE_LORD = r"^(Lord|Lady)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)$"
_OFFICE = r"(?iU)\b(Lord Mayor|Archdeacon|Lord Bishop)\b"
_LEADING = rf"(?i)^((?:(?:{_any(LEADING_PAIRS)}|{_any(LEADING)})(?:\s+|$))*)"
_TRAILING_POST = rf"(?i)((?:(?:^|\s+)(?:{_any(POSTNOMINAL_PAIRS)}|{_any(POSTNOMINALS)}))+)$"
_ANY_POST = rf"(?i)(?<!\S)(?:{_any(POSTNOMINAL_PAIRS)}|{_any(POSTNOMINALS)})(?!\S)"
_INITIALS = r"^((?:(?:[A-Z]\.|----)(?:\s+|$))+)"
_LEADING_INITIALS = r"^((?:[A-Z]\.(?:\s+|$))+)"
_PLACE = r"\p{Lu}\p{L}*(?:\s+\p{Lu}\p{L}*)*"
_AFTER_POST = rf"(?:^|\s)(?i:esq\.*|bart\.*|jun\.*|sen\.*|m\.p\.|m\.d\.)\s+({_PLACE})$"


def leading_titles(name: Column) -> Column:
    """Struct of the titles before a name and the rest."""
    title = F.regexp_extract(name, _LEADING, 1)
    return F.struct(F.trim(title).alias("title"), F.substring(name, F.length(title) + 1, F.length(name)).alias("rest"))


def trailing_postnominals(name: Column) -> Column:
    """Struct of the postnominals at the end and what is before."""
    post = F.regexp_extract(name, _TRAILING_POST, 1)
    return F.struct(F.trim(post).alias("post"), F.trim(F.substring(name, F.lit(1), F.length(name) - F.length(post))).alias("rest"))


def postnominals_anywhere(name: Column) -> Column:
    """Struct of all postnominals and the rest."""
    post = F.array_join(F.regexp_extract_all(name, F.lit(_ANY_POST), F.lit(0)), " ")
    return F.struct(post.alias("post"), F.trim(F.regexp_replace(F.regexp_replace(name, _ANY_POST, ""), r"\s+", " ")).alias("rest"))


def split_personal_name(name: Column) -> Column:
    """Struct of first and last name."""
    initials = F.regexp_extract(name, _INITIALS, 1)
    rest = F.substring(name, F.length(initials) + 1, F.length(name))
    two = F.split(name, r"\s+", 2)
    first = F.when(initials != "", F.trim(initials)).when(F.size(two) > 1, F.get(two, F.lit(0))).otherwise("")
    last = F.when(initials != "", rest).when(F.size(two) > 1, F.get(two, F.lit(1))).otherwise(name)
    return F.struct(first.alias("first"), last.alias("last"))


def correct_words(place: Column, spelling: Mapping[str, str] | None) -> Column:
    """The words of a place by the spelling lexicon."""
    if not spelling:
        return place
    lookup = literal_map({k.lower(): v for k, v in spelling.items()})
    return F.array_join(F.transform(tokens(place), lambda w: F.coalesce(F.try_element_at(lookup, F.lower(w)), w)), " ")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "[.,;: ]+$", "")


def location_of(raw: Column, spelling: Mapping[str, str] | None = None) -> Column:
    """A place after "of", else one after a postnominal; empty if there is none."""
    none = F.lit(None).cast("string")

    def after_of(parts: Column) -> Column:
        def place(i: Column) -> Column:
            before, after = F.trim(F.get(parts, i - 1)), F.trim(F.get(parts, i))
            word = F.regexp_replace(F.lower(F.element_at(F.split(before, " "), -1)), r"\.+$", "")
            skip = (before == "") | (after == "") | word.isin(BEFORE_OF) | F.lower(after).startswith("the ") | F.lower(after).startswith("ditto")
            return F.when(skip, none).otherwise(_rstrip(F.trim(F.regexp_replace(after, COPY_TAIL, ""))))

        found = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, none).otherwise(place(i)))
        return F.get(F.filter(found, lambda x: x != ""), F.lit(0))

    def after_postnominal(segments: Column) -> Column:
        def place(seg: Column, k: Column) -> Column:
            cut = _rstrip(F.trim(F.regexp_replace(seg, COPY_TAIL, "")))
            within = F.regexp_extract(cut, _AFTER_POST, 1)
            nexts = F.filter(F.transform(F.slice(segments, k + 2, F.size(segments)), lambda s: _rstrip(s)), lambda s: s != "")
            other = F.regexp_extract(F.coalesce(F.get(nexts, F.lit(0)), F.lit("")), rf"^({_PLACE})$", 1)
            across = F.when(cut.rlike(r"(?i)^(?:esq|bart|jun|sen)\.*$"), other)
            return F.coalesce(*[F.when((x != "") & ~F.lower(x).isin(NO_PLACES), x) for x in (within, across)])

        return F.get(F.filter(F.transform(segments, place), lambda x: x.isNotNull()), F.lit(0))

    cleaned = F.trim(F.regexp_replace(F.translate(raw, ",;", "  "), r"(?U)\s+", " "))
    segments = F.transform(F.split(raw, "[,;]", -1), lambda s: F.trim(s))
    found = F.coalesce(let(F.split(cleaned, r"(?iU)\bof\b", -1), after_of), let(segments, after_postnominal))
    return correct_words(F.coalesce(found, F.lit("")), spelling)


def without_location(name: Column, place: Column, spelling: Mapping[str, str] | None = None) -> Column:
    """``name`` without the words of ``place`` at its end."""
    n = F.size(tokens(place))

    def cut(words: Column) -> Column:
        tail = F.lower(F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n), " "))
        whole = tail == F.lower(F.array_join(tokens(place), " "))
        out = F.when(whole, F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - n)))
        if spelling:
            pairs = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v).alias("v")) for k, v in spelling.items()])
            respelt = F.exists(pairs, lambda p: F.lower(F.element_at(words, -1)) == F.replace(F.lower(place), p["k"], p["v"]))
            out = out.when((n == 1) & respelt, F.slice(words, F.lit(1), F.size(words) - 1))
        return F.array_join(out.otherwise(words), " ")

    return F.when((place == "") | (name == ""), name).otherwise(let(tokens(name), cut))


def classify_segment(segment: Column, occupations: Iterable[str], spelling: Mapping[str, str] | None = None) -> Column:
    """Struct of the type and value of one segment after the name."""
    trades = F.array(*map(F.lit, sorted(set(occupations)) or [""]))

    def typed(seg: Column) -> Column:
        bare = F.transform(tokens(seg), lambda w: F.regexp_replace(F.lower(w), r"\.+$", ""))
        no_place = F.forall(bare, lambda w: w.isin(NO_PLACES))
        post = F.exists(bare, lambda w: w.isin("esq", "bart", "jun", "sen"))

        def of(kind: str, value: Column = seg) -> Column:
            return F.struct(F.lit(kind).alias("type"), value.alias("value"))

        return (
            F.when(seg == "", of("", F.lit("")))
            .when(seg.rlike(r"(?i)^(?:\d+\s+)?(?:ditto|do\.?)$"), of("ditto", F.lit("ditto")))
            .when(seg.rlike(COPY_COUNT), of("note"))
            .when(seg.rlike(AFFILIATION), of("affiliation", F.regexp_extract(seg, AFFILIATION, 0)))
            .when(no_place, F.when(post, of("postnominal")).otherwise(of("note")))
            .when(F.forall(tokens(seg), lambda w: w.rlike(r"^[A-Z]{1,2}\.*$")), of("postnominal"))
            .when(F.arrays_overlap(bare, trades), of("occupation"))
            .when(F.forall(tokens(seg), lambda w: w.rlike(r"^\p{Lu}")), of("location", correct_words(seg, spelling)))
            .otherwise(of("note"))
        )

    return let(_rstrip(F.trim(segment)), typed)


def notes_of(raw: Column) -> Column:
    """Copy count, ditto, regiment, parent and institution, as far as they are said."""
    son = F.regexp_extract(raw, r"(?iU)the\s+son\s+of\s+(.+?)(?:,|$)", 1)
    parts = [
        F.trim(F.regexp_extract(raw, COPY_COUNT, 1)),
        F.when(raw.rlike(r"(?iU)\bditto\b"), "ditto").otherwise(""),
        F.when(raw.rlike(r"(?iU)\bregiment\b"), F.regexp_extract(raw, r"(?iU)(\d+\w*\s+regiment\b)", 1)).otherwise(""),
        F.when(F.lower(raw).contains("the son of") & (son != ""), F.concat(F.lit("son of "), F.regexp_replace(F.trim(son), "[.,;]+$", ""))).otherwise(""),
        F.trim(F.regexp_extract(raw, r"(?iU)\bof the (?:Royal Navy|Inner Temple|Middle Temple)\b", 0)),
    ]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "; ")


def _values(typed: Column, kinds: list[str]) -> Column:
    return F.transform(F.filter(typed, lambda s: s["type"].isin(kinds)), lambda s: s["value"])


def _first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def _first_filled(*columns: Column) -> Column:
    out = F.lit("")
    for c in reversed(columns):
        out = F.when(c != "", c).otherwise(out)
    return out


def _parsed(kind, title_key="", title="", first="", last="", post="", occupation="", affiliation="", location="", notes="") -> Column:
    values = (kind, title_key, title, first, last, post, occupation, affiliation, location, notes)
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(c) for c, v in zip(PARSED, values, strict=True)])


def parse_names(rows: DataFrame, occupations: Iterable[str] = (), spelling: Mapping[str, str] | None = None,
                raw: str = "normalization input", name: str = "normalized_name", order: str = "name_order") -> DataFrame:
    """``rows`` plus the parsed columns (G1-G3). ``order`` holds first-last or last-first."""
    occupations = list(occupations)
    c = F.col
    kept = [F.col(f"`{x}`") for x in rows.columns if x not in PARSED]
    at = rows.select(*kept, F.coalesce(c(f"`{raw}`"), F.lit("")).alias("__raw"), F.trim(F.coalesce(c(f"`{name}`"), F.lit(""))).alias("__name"))
    at = at.withColumn("__segs", F.filter(F.transform(F.split("__raw", "[,;]", -1), lambda s: F.trim(s)), lambda s: s != ""))
    at = at.withColumn("__core0", normalize_name(F.coalesce(F.get("__segs", F.lit(0)), c("__raw")), spelling))
    at = at.withColumn("__notes", notes_of(c("__raw"))).withColumn("__anyplace", location_of(c("__raw"), spelling))

    # First-last order: the core is the first segment, if there are more and it says something.
    cored = (F.size("__segs") > 1) & (c("__core0") != "")
    at = at.withColumn("__core", F.when(cored, c("__core0")).otherwise(c("__name")))
    at = at.withColumn("__coreraw", F.when(cored, F.get("__segs", F.lit(0))).otherwise(c("__raw")))
    at = at.withColumn("__tail", F.when(cored, F.slice("__segs", F.lit(2), F.size("__segs"))).otherwise(F.array().cast("array<string>")))
    at = at.withColumn("__fl", leading_titles(c("__core")))
    at = at.withColumn("__rest", F.regexp_replace(c("__fl.rest"), r"(?iU)^the\s+", ""))
    first_word = F.regexp_replace(F.lower(_first(tokens(c("__rest")))), r"\.+$", "")
    at = at.withColumn("__ranked", c("__rest").rlike(_POSITIONAL) | c("__rest").rlike(_BARE_LORD) | first_word.isin(TRIGGERS))
    at = at.withColumn("__place", _first_filled(location_of(c("__coreraw"), spelling), location_of(c("__core"), spelling)))
    at = at.withColumn("__bare", without_location(c("__fl.rest"), c("__place"), spelling))
    at = at.withColumn("__bare", F.array_join(F.filter(tokens(c("__bare")), lambda t: F.lower(t) != "of"), " "))
    at = at.withColumn("__end", trailing_postnominals(c("__bare")))
    at = at.withColumn("__end", F.when(c("__end.post") != "", c("__end")).otherwise(postnominals_anywhere(c("__end.rest"))))
    office = F.regexp_extract("__end.rest", _EMBEDDED, 0)
    at = at.withColumn("__office", _first_filled(office, F.regexp_extract("__end.rest", _OFFICE, 0)))
    before = F.when(office != "", F.regexp_replace("__end.rest", _EMBEDDED, "")).otherwise(F.regexp_extract("__end.rest", rf"(?iU)^(.*?){_OFFICE[5:]}", 1))
    at = at.withColumn("__own", F.when(c("__office") != "", F.trim(before)).otherwise(c("__end.rest")))
    at = at.withColumn("__names", split_personal_name(c("__own")))
    at = at.withColumn("__typed", F.transform("__tail", lambda s: classify_segment(s, occupations, spelling)))
    typed = c("__typed")
    first_last = F.when(
        c("__ranked"),
        _parsed("titled", F.lower("__rest"), F.concat_ws(" ", F.when(c("__fl.title") != "", c("__fl.title")), c("__rest")), notes=c("__notes")),
    ).otherwise(
        _parsed(
            F.when(c("__fl.title") != "", "personal").otherwise("bare"), "", c("__fl.title"), c("__names.first"), c("__names.last"),
            _first_filled(c("__end.post"), F.array_join(_values(typed, ["postnominal"]), " ")),
            _first(_values(typed, ["occupation"])), _first(_values(typed, ["affiliation"])),
            _first_filled(c("__place"), F.array_join(_values(typed, ["location", "ditto"]), ", "), c("__anyplace")),
            F.array_join(F.filter(F.array("__office", "__notes"), lambda x: x != ""), "; "),
        )
    )

    # Last-first order: surname, then title and given names in the core or in the segment that goes on with it.
    at = at.withColumn("__sur", _first(tokens(c("__core0"))))
    at = at.withColumn("__lf", leading_titles(F.substring(c("__core0"), F.length("__sur") + 2, F.length("__core0"))))
    at = at.withColumn("__given", trailing_postnominals(c("__lf.rest"))["rest"])
    more = F.slice("__segs", F.lit(2), F.size("__segs"))
    alone = (c("__lf.title") == "") & (c("__given") == "") & (F.size(tokens(c("__core0"))) == 1) & (F.size("__segs") > 1)
    at = at.withColumn("__next", F.when(alone, leading_titles(normalize_name(F.coalesce(F.get("__segs", F.lit(1)), F.lit("")), spelling))))
    trades = F.array(*map(F.lit, sorted({"esq", "bart", "jun", "sen", *occupations})))

    def given_part(words: Column) -> Column:
        stops = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i == F.size(words)) | F.array_contains(trades, F.regexp_replace(F.lower(F.coalesce(F.get(words, i), F.lit(""))), r"\.+$", "")))
        k = F.get(stops, F.lit(0))
        return F.struct(F.array_join(F.slice(words, F.lit(1), k), " ").alias("given"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("left"))

    at = at.withColumn("__go", let(tokens(c("__next.rest")), given_part))
    peeled = F.regexp_extract(F.coalesce(F.get("__segs", F.lit(2)), F.lit("")), _LEADING_INITIALS, 1)
    initials = F.regexp_extract("__next.rest", _LEADING_INITIALS, 1)
    rest = F.slice("__segs", F.lit(3), F.size("__segs"))

    def headed(head: Column, tail: Column) -> Column:
        return F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), tail)

    third = F.substring(F.get("__segs", F.lit(2)), F.length(peeled) + 1, F.length(F.get("__segs", F.lit(2))))
    title_only = (c("__go.left") == "") & (c("__go.given") == "") & (peeled != "")
    moved = F.struct("__next.title", F.when(title_only, F.trim(peeled)).otherwise(c("__go.given")).alias("given"),
                     F.when(title_only, headed(third, F.slice("__segs", F.lit(4), F.size("__segs")))).otherwise(headed(c("__go.left"), rest)).alias("tail"))
    lone = F.struct(F.lit("").alias("title"), F.trim(initials).alias("given"), headed(F.substring(c("__next.rest"), F.length(initials) + 1, F.length("__next.rest")), rest).alias("tail"))
    usual = F.struct("__lf.title", c("__given").alias("given"), more.alias("tail"))
    at = at.withColumn("__last", F.when(alone & (c("__next.title") != ""), moved).when(alone & (initials != ""), lone).otherwise(usual))
    at = at.withColumn("__ltyped", F.transform("__last.tail", lambda s: classify_segment(s, occupations, spelling)))
    ltyped = c("__ltyped")
    son = F.regexp_extract("__raw", r"(?iU)the\s+son\s+of\s+(.+?)(?:,|$)", 1)
    notes = F.concat(_values(ltyped, ["note"]), F.when(son != "", F.array(F.concat(F.lit("son of "), F.regexp_replace(F.trim(son), "[.,;]+$", "")))).otherwise(F.array().cast("array<string>")))
    last_first = F.when(c("__core0") == "", first_last).otherwise(
        _parsed(
            F.when(c("__last.title") != "", "personal").otherwise("bare"), "", c("__last.title"), c("__last.given"), c("__sur"),
            postnominals_anywhere(c("__name"))["post"], _first(_values(ltyped, ["occupation"])), _first(_values(ltyped, ["affiliation"])),
            _first_filled(F.array_join(_values(ltyped, ["location", "ditto"]), ", "), c("__anyplace")), F.array_join(notes, "; "),
        )
    )
    positional = F.concat_ws(" of ", F.regexp_extract("__name", _POSITIONAL, 1), F.regexp_extract("__name", _POSITIONAL, 2))
    lord = F.concat_ws(" ", F.regexp_extract("__name", _BARE_LORD, 1), F.regexp_extract("__name", _BARE_LORD, 2))
    parsed = (
        F.when(c("__name") == "", _parsed("bare"))
        .when(c("__name").rlike(r"(?iU)^a\s+(?:young\s+)?(?:gentleman|lady)$"), _parsed("anonymous", notes=c("__notes")))
        .when(c("__name").rlike(_POSITIONAL), _parsed("titled", F.lower(positional), positional, notes=c("__notes")))
        .when(c("__name").rlike(_BARE_LORD), _parsed("titled", F.lower(lord), lord, notes=c("__notes")))
        .when(c(f"`{order}`") == "last-first", last_first)
        .otherwise(first_last)
    )
    return at.withColumn("__parsed", parsed).select(*kept, "__parsed.*")


def name_types(parsed: DataFrame) -> DataFrame:
    """How many names of each type."""
    return parsed.groupBy("name_type").agg(F.count(F.lit(1)).alias("names"))
