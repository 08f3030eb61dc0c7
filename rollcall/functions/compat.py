"""How far two listed names agree: predicates, scores and the match rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that tell little, and titles that stand for one another.
NON_DISTINCTIVE = ["mr.", "mrs.", "miss", "esq.", ""]
EQUIVALENT = ["mr.", "esq.", ""]
#: Prefixes of surnames, and words that do not tell an occupation.
SURNAME_PREFIX = r"^(?:de la|de|du|la|le|van|von) "
OCCUPATION_STOP = ["and", "the", "of", "at", "law", "&", "mr", "mrs", ""]
#: Titles that stand for one another between editions, with their case.
EDITION_TITLES = [["Mr.", "Esq.", ""], ["Rev.", "Rev. Mr."], ["Mrs.", ""], ["Miss", ""]]

#: Columns of an entry that matching reads.
FIELDS = ["parsed_title", "parsed_first", "parsed_last", "parsed_postnominals", "parsed_occupation", "parsed_affiliation", "parsed_location"]


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def strip_surname_prefix(last: Column) -> Column:
    """H2."""
    return F.regexp_replace(last, SURNAME_PREFIX, "")


def effective_title(title: Column, postnominals: Column) -> Column:
    """H3: the title, lower-cased; Esq. where only the postnominals have it."""
    bare = (F.trim(title) == "") & F.lower(postnominals).contains("esq")
    return F.when(bare, "esq.").otherwise(clean(title))


def _without_mr(title: Column) -> Column:
    return F.array_join(F.filter(F.split(title, r"\s+"), lambda t: t != "mr."), " ")


def titles_compatible(a: Column, b: Column) -> Column:
    """H4, of effective titles."""
    return (a == b) | (a.isin(EQUIVALENT) & b.isin(EQUIVALENT)) | (_without_mr(a) == _without_mr(b))


def is_bare_initial(name: Column) -> Column:
    return F.length(F.trim(F.replace(name, F.lit("."), F.lit("")))) == 1


def is_multi_initial(name: Column, least: int) -> Column:
    """H6: ``least`` single letters or more, and nothing else."""
    return F.trim(F.replace(name, F.lit("."), F.lit(" "))).rlike(rf"(?U)^\S(?:\s+\S){{{least - 1},}}$")


def _first_names(a: Column, b: Column, ia: Column, ib: Column) -> Column:
    same_start = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    short = F.least(F.length(a), F.length(b))
    allowed = F.when(short <= 3, 1).when(short <= 6, 2).otherwise(3)
    return (
        F.when((a == "") | (b == ""), "missing")
        .when(~ia & ~ib, F.when(a == b, "exact").when(same_start & (F.levenshtein(a, b) <= allowed), "fuzzy").otherwise("conflict"))
        .otherwise(F.when(same_start, "initial").otherwise("conflict"))
    )


def first_names(a: Column, b: Column) -> Column:
    """H5: exact, fuzzy, initial, missing or conflict."""
    a, b = clean(a), clean(b)
    return _first_names(a, b, is_bare_initial(a), is_bare_initial(b))


def _agreement(a: Column, b: Column, other: str) -> Column:
    return F.when((a == "") | (b == ""), "missing").when(a == b, "match").otherwise(other)


def _place(c: Column) -> Column:
    return F.replace(clean(c), F.lit("-"), F.lit(""))


def locations(a: Column, b: Column) -> Column:
    """H7."""
    return _agreement(_place(a), _place(b), "conflict")


def postnominals(a: Column, b: Column) -> Column:
    """H8."""
    return _agreement(clean(a), clean(b), "differ")


def _trade(c: Column) -> Column:
    words = F.transform(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: F.btrim(w, F.lit(".,&")))
    return F.array_except(words, F.array(*map(F.lit, OCCUPATION_STOP)))


def _trades(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "missing").when(F.exists(a, lambda w: F.array_contains(b, w)), "match").otherwise("conflict")


def occupations(a: Column, b: Column) -> Column:
    """H9: by the words that tell an occupation."""
    return _trades(_trade(a), _trade(b))


def _body(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _bodies(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), "missing").when(a.contains(b) | b.contains(a), "match").otherwise("conflict")


def affiliations(a: Column, b: Column) -> Column:
    """By letters and digits, one in the other."""
    return _bodies(_body(a), _body(b))


def allowed_distance(last: Column, first: Column) -> Column:
    """Edits allowed in a last name; depends on the first argument's length only."""
    n = F.length(F.trim(last))
    strict = F.when(n <= 4, 0).when(n <= 7, 1).otherwise(2)
    return strict + (first == "exact").cast("int")


def cross_eligible(e, relaxed: bool = True) -> Column:
    """Whether an entry has enough to be matched across books; ``e`` gives a column by name."""
    said = [F.trim(e(c)) != "" for c in ("parsed_location", "parsed_postnominals", "parsed_occupation", "parsed_affiliation")]
    some = said[0] | said[1] | said[2] | said[3]
    if relaxed:
        some = some | (F.trim(e("parsed_first")) != "")
    return ~effective_title(e("parsed_title"), e("parsed_postnominals")).isin(NON_DISTINCTIVE) | some


def signature(e) -> Column:
    """H14."""
    return F.struct(
        effective_title(e("parsed_title"), e("parsed_postnominals")).alias("title"),
        clean(e("parsed_first")).alias("first"), clean(e("parsed_last")).alias("last"), clean(e("parsed_postnominals")).alias("post"),
    )


def _rule(*parts: Column) -> Column:
    return F.concat_ws("+", *parts)


#: Columns of an entry that ``prepared`` makes, for rules that compare it with many others.
PREPARED = ["m_title", "m_kind", "m_plain", "m_first", "m_bare", "m_two", "m_three", "m_place", "m_post", "m_trade", "m_body", "m_raw", "m_last"]


def prepared(e) -> dict[str, Column]:
    """What ``match_rule`` compares, by name: all that can be told from one entry. Titles that are compatible share ``m_kind``."""
    title = effective_title(e("parsed_title"), e("parsed_postnominals"))
    first, raw = F.trim(e("parsed_first")), clean(e("parsed_last"))
    parts = (
        title, F.when(title == "esq.", "").otherwise(_without_mr(title)), _without_mr(title), F.lower(first), is_bare_initial(F.lower(first)), is_multi_initial(first, 2), is_multi_initial(first, 3),
        _place(e("parsed_location")), clean(e("parsed_postnominals")), _trade(e("parsed_occupation")), _body(e("parsed_affiliation")), raw, strip_surname_prefix(raw),
    )
    return dict(zip(PREPARED, parts, strict=True))


def titles_agree(a, b) -> Column:
    """H4 of prepared entries."""
    ta, tb = a("m_title"), b("m_title")
    return (ta == tb) | (ta.isin(EQUIVALENT) & tb.isin(EQUIVALENT)) | (a("m_plain") == b("m_plain"))


def first_status(a, b) -> Column:
    """H5 of prepared entries."""
    return _first_names(a("m_first"), b("m_first"), a("m_bare"), b("m_bare"))


def not_blocked(a, b) -> Column:
    """Whether nothing stands against a match of prepared entries of like titles."""
    return rest_not_blocked(a, b) & titles_agree(a, b) & (first_status(a, b) != "conflict")


def match_rule(a, b, scope: str, distance: Column | None = None, first: Column | None = None) -> Column:
    """H12 of prepared entries that are not blocked; ``distance`` is that of ``m_last``, ``first`` the status of first names."""
    ta, tb = a("m_title"), b("m_title")
    first = first_status(a, b) if first is None else first
    place, post = _agreement(a("m_place"), b("m_place"), "conflict"), _agreement(a("m_post"), b("m_post"), "differ")
    trade, body = _trades(a("m_trade"), b("m_trade")), _bodies(a("m_body"), b("m_body"))
    raw_a, raw_b = a("m_raw"), b("m_raw")
    least = "m_two" if scope == "within_book" else "m_three"
    initials = a(least) & b(least) & (a("m_first") == b("m_first"))

    la, lb, pa, pb = a("m_last"), b("m_last"), a("m_place"), b("m_place")
    in_a = (pb != "") & (pa == "") & (la == F.concat(lb, F.lit(" "), pb))
    in_b = (pa != "") & (pb == "") & (lb == F.concat(la, F.lit(" "), pa))
    absorbed = (la != lb) & (in_a | in_b)
    last = F.when((la != lb) & in_a, lb).otherwise(la)
    distance = F.when(absorbed, 0).otherwise(F.levenshtein(la, lb) if distance is None else distance)
    placed = absorbed | (place == "match")

    identical, distinctive = ta == tb, ~ta.isin(EQUIVALENT)
    alike = identical | (ta.isin(EQUIVALENT) & tb.isin(EQUIVALENT))
    loc, occ = F.when(placed, "loc"), F.when(trade == "match", "occ")
    aff, pst = F.when(body == "match", "aff"), F.when(post == "match", "post")
    named = F.concat(first, F.lit("_first"))
    plain = F.when(first.isin("exact", "initial") & alike | (first == "missing") & identical, _rule(F.lit("exact_last"), named, loc, pst))
    fuzzy = F.when((first == "fuzzy") & alike, _rule(F.lit("exact_last"), named, F.when(distinctive, "title"), loc, pst))

    signals = distinctive.cast("double") + placed.cast("double") + (trade == "match").cast("double") + (body == "match").cast("double")
    signals = signals + F.when(first == "exact", 1.0).when(first == "initial", 0.5).otherwise(0.0) + F.when(post == "match", 0.5).otherwise(0.0)
    near = (distance <= allowed_distance(last, first)) & (signals >= 1)
    far = F.when(near, _rule(F.when(distance == 0, "exact_last").otherwise(F.concat(F.lit("fuzzy_last_"), distance.cast("string"))), named, loc, occ, aff, pst))
    exact = F.when(distance == 0, F.coalesce(plain, fuzzy)) if scope == "within_book" else F.lit(None).cast("string")
    return (
        F.when((raw_a == "") & (raw_b == ""), F.when(initials, "multi_initials"))
        .when((raw_a == "") | (raw_b == ""), None)
        .otherwise(F.coalesce(exact, far))
    )


def rule_of_names(a, b, scope: str, distance: Column, first: Column) -> dict[str, Column]:
    """What two entries' names and titles say of their rule, by name; ``rule_of_both`` tells the rule from it and ``rest_says``.

    Entries of the same names and titles share it, so it is told once for all of them.
    """
    ta, tb, la, lb = a("m_title"), b("m_title"), a("m_last"), b("m_last")
    identical, distinctive = ta == tb, ~ta.isin(EQUIVALENT)
    alike = identical | (ta.isin(EQUIVALENT) & tb.isin(EQUIVALENT))
    named, exact = F.concat(first, F.lit("_first")), F.lit("exact_last")
    plain = F.when(first.isin("exact", "initial") & alike | (first == "missing") & identical, _rule(exact, named))
    fuzzy = F.when((first == "fuzzy") & alike, _rule(exact, named, F.when(distinctive, "title")))
    least = "m_two" if scope == "within_book" else "m_three"
    lone = (a("m_raw") == "") & (b("m_raw") == "")
    both = F.array(F.struct(la.alias("x"), lb.alias("y")), F.struct(lb.alias("x"), la.alias("y")))
    tail = lambda s: F.when(s.x.startswith(F.concat(s.y, F.lit(" "))), s.x.substr(F.length(s.y) + 2, F.length(s.x))).otherwise("")
    return {
        "r_whole": F.when(lone & a(least) & b(least) & (a("m_first") == b("m_first")), "multi_initials"),
        "r_named": (a("m_raw") != "") & (b("m_raw") != ""),
        "r_unlike": la != lb, "r_tails": F.transform(both, tail), "r_zero": distance == 0,
        "r_exact": F.coalesce(plain, fuzzy) if scope == "within_book" else F.lit(None).cast("string"),
        "r_near": distance <= allowed_distance(la, first),
        "r_far": _rule(F.when(distance == 0, exact).otherwise(F.concat(F.lit("fuzzy_last_"), distance.cast("string"))), named),
        "r_none": _rule(exact, named),
        "r_signals": distinctive.cast("double") + F.when(first == "exact", 1.0).when(first == "initial", 0.5).otherwise(0.0),
    }


def names_may_match(r) -> Column:
    """Whether ``rule_of_names`` leaves any rule open."""
    absorbs = r("r_unlike") & ((r("r_tails")[0] != "") | (r("r_tails")[1] != ""))
    return r("r_whole").isNotNull() | (r("r_named") & (r("r_near") | absorbs | (r("r_zero") & r("r_exact").isNotNull())))


def rest_not_blocked(a, b) -> Column:
    """Whether nothing but names and titles stands against a match; what is cheap comes first."""
    apart = F.coalesce((a("book") == b("book")) & (a("edition") == b("edition")), F.lit(False))
    return (
        ~apart & (_agreement(a("m_place"), b("m_place"), "conflict") != "conflict")
        & (_bodies(a("m_body"), b("m_body")) != "conflict") & (_trades(a("m_trade"), b("m_trade")) != "conflict")
    )


def rest_says(a, b, r) -> dict[str, Column]:
    """What all but names and titles says of the rule, by name; ``r`` gives what ``rule_of_names`` says."""
    pa, pb = a("m_place"), b("m_place")
    absorbed = r("r_unlike") & (((pb != "") & (pa == "") & (r("r_tails")[0] == pb)) | ((pa != "") & (pb == "") & (r("r_tails")[1] == pa)))
    return {
        "s_absorbed": absorbed, "s_place": _agreement(pa, pb, "conflict") == "match", "s_post": _agreement(a("m_post"), b("m_post"), "differ") == "match",
        "s_trade": _trades(a("m_trade"), b("m_trade")) == "match", "s_body": _bodies(a("m_body"), b("m_body")) == "match",
    }


def rule_of_both(r) -> Column:
    """H12 of entries that are not blocked, from ``rule_of_names`` and ``rest_says``: the same as ``match_rule``."""
    absorbed, post = r("s_absorbed"), r("s_post")
    placed = absorbed | r("s_place")
    signals = r("r_signals") + placed.cast("double") + r("s_trade").cast("double") + r("s_body").cast("double") + F.when(post, 0.5).otherwise(0.0)
    part = lambda said, name: F.when(said, f"+{name}").otherwise("")
    exact = (absorbed | r("r_zero")) & r("r_exact").isNotNull()
    far = F.when(absorbed | r("r_near"), signals >= 1)
    head = F.when(exact, r("r_exact")).when(far, F.when(absorbed, r("r_none")).otherwise(r("r_far")))
    more = ~F.coalesce(exact, F.lit(False))
    told = F.concat(head, part(placed, "loc"), part(more & r("s_trade"), "occ"), part(more & r("s_body"), "aff"), part(post, "post"))
    return F.when(r("r_whole").isNotNull(), r("r_whole")).when(r("r_named"), told)


def entries_match(a, b, scope: str = "within_book") -> Column:
    """The rule by which two entries match, or null. ``a`` and ``b`` give columns by name; order matters."""
    x, y = (prepared(e) | {c: e(c) for c in ("book", "edition")} for e in (a, b))
    return F.when(not_blocked(x.get, y.get), match_rule(x.get, y.get, scope))


def edition_titles_compatible(a: Column, b: Column) -> Column:
    """A rule of its own, with regard to case."""
    a, b = F.trim(a), F.trim(b)
    out = a == b
    for group in EDITION_TITLES:
        out = out | (a.isin(group) & b.isin(group))
    return out


def last_name_score(a: Column, b: Column) -> Column:
    """H16."""
    a, b = clean(a), clean(b)
    ratio = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return (
        F.when((a == "") | (b == ""), 0.0).when(a == b, 3.0).when(ratio >= 0.85, 2.5)
        .when(ratio >= 0.70, 1.5).when(ratio >= 0.55, 0.8).otherwise(0.0)
    )


def first_name_score(a: Column, b: Column) -> Column:
    """H17."""
    a, b = clean(a), clean(b)
    starts = ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))
    return (
        F.when((a == "") | (b == ""), 0.3).when(a == b, 1.0).when(starts, 0.7)
        .when(F.substring(a, 1, 1) != F.substring(b, 1, 1), -0.5).otherwise(0.3)
    )


def pair_scores(dep, arr) -> dict[str, Column]:
    """Parts of the score of a departure and an arrival, and their sum (0 without a like last name)."""
    last = last_name_score(dep("parsed_last"), arr("parsed_last"))
    title = F.when(edition_titles_compatible(dep("parsed_title"), arr("parsed_title")), 1.0).otherwise(-1.0)
    first = first_name_score(dep("parsed_first"), arr("parsed_first"))
    (da, aa), (dp, ap) = ((F.lower(dep(c)), F.lower(arr(c))) for c in ("parsed_location", "parsed_postnominals"))
    place = F.when((da == "") | (aa == ""), 0.0).when(da == aa, 1.0).otherwise(-0.3)
    post = F.when((dp != "") & (dp == ap), 0.5).otherwise(0.0)
    parts = {"s_last": last, "s_title": title, "s_first": first, "s_loc": place, "s_post": post}
    return parts | {"score": F.when(last == 0.0, 0.0).otherwise(last + title + first + place + post)}
