"""DuckDB SQL for the queries of the catalogue, over the same views."""

from __future__ import annotations

from rollcall.functions import present, text
from rollcall.operators import ingest, order, parse
from rollcall.plans import views

N = f"WITH n AS ({views.NAMELIST})"
S = f"WITH s AS ({views.SUBSCRIPTIONS})"
L = f"""{N}, l AS (SELECT CAST(row_ord % 4 AS INT) AS file, row_ord, no, listed_as, full_book AS book, full_author AS author, edition, year,
  CASE WHEN row_ord % 3 = 0 THEN concat('R ', listed_as) ELSE ' ' END AS refined FROM n)"""


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(values) -> str:
    return "|".join(v if "\\" in v else v.replace(".", r"\.") for v in values)


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"


def _text(new: str) -> str:
    return f"{N} SELECT row_ord, {new} AS name FROM n"


def _chain(c: str, pairs) -> str:
    for pattern, to, flags in pairs:
        c = f"regexp_replace({c}, '{pattern}', '{to}', '{flags}')"
    return c


_titles = _chain("listed_as", [(rf"\b{k}\b", v, "gi") for k, v in sorted(text.TITLE_ABBREVIATIONS.items(), key=lambda x: -len(x[0]))])
_periods = _chain("listed_as", [*((rf"\b{a}\b\.?", f"{a}.", "gi") for a in text.ABBREVIATIONS), (r"\bMiss\b\.?", "Miss", "gi")])
_firsts = {"jn.": "John", "jn": "John"}
for _k, _v in text.NAME_ABBREVIATIONS.items():
    _firsts.setdefault(_k.lower(), _v)
    _firsts.setdefault(_k.rstrip(".").lower(), _v)
_first_values = ", ".join(f"('{k}', '{v}')" for k, v in _firsts.items())
_given = _list(["john", "mary", "thomas", "william", "ann", "joseph", "james"])

VOTES = f"""{N}, core AS (
  SELECT concat_ws('|', author, book, edition) AS list_key, row_ord, list_filter({_words("normalized_name")},
    lambda t: NOT list_contains({_list(order.TITLE_TOKENS + order.POST_TOKENS)}, lower(t)) AND NOT regexp_matches(t, '^[-–—]+$')) AS k FROM n
), known AS (
  SELECT *, coalesce(list_position(list_transform(k, lambda t: list_contains({_given}, trim(lower(t), '.,;:'))), TRUE), 0) AS spot,
    regexp_matches(coalesce(k[1], ''), '^[A-Z]\\.?$') AS ahead, regexp_matches(coalesce(k[len(k)], ''), '^[A-Z]\\.?$') AS behind FROM core
), votes AS (
  SELECT list_key, row_ord, CASE WHEN len(k) < 2 THEN 0 WHEN spot = 1 THEN 2 WHEN spot > 1 THEN -2 WHEN ahead AND NOT behind THEN 1
    WHEN behind AND NOT ahead THEN -1 ELSE 0 END AS vote, CASE WHEN len(k) >= 2 THEN trim(lower(k[1]), '.,;:') END AS lead,
    CASE WHEN len(k) >= 2 THEN trim(lower(k[len(k)]), '.,;:') END AS trail FROM known
), fractions AS (
  SELECT list_key, coalesce(avg(u), 0.0) AS alpha_lead, coalesce(avg(v), 0.0) AS alpha_trail FROM (
    SELECT list_key, CASE WHEN lead <> '' AND pl <> '' THEN CAST(pl <= lead AS INT) END AS u, CASE WHEN trail <> '' AND pt <> '' THEN CAST(pt <= trail AS INT) END AS v
    FROM (SELECT *, lag(lead) OVER w AS pl, lag(trail) OVER w AS pt FROM votes WHERE lead IS NOT NULL WINDOW w AS (PARTITION BY list_key ORDER BY row_ord)))
  GROUP BY list_key
)"""

PAIRS = f"""{N}, p AS (
  SELECT a.*, b.row_ord AS b_row, b.edition AS b_edition, b.parsed_title AS b_title, b.parsed_first AS b_first, b.parsed_last AS b_last,
    b.parsed_postnominals AS b_post, b.parsed_occupation AS b_occ, b.parsed_affiliation AS b_aff, b.parsed_location AS b_loc
  FROM n a JOIN n b ON a.parsed_last = b.parsed_last AND a.book = b.book AND a.row_ord < b.row_ord WHERE a.parsed_last <> ''
), q AS (
  SELECT *, CASE WHEN trim(parsed_title) = '' AND lower(parsed_postnominals) LIKE '%esq%' THEN 'esq.' ELSE lower(trim(parsed_title)) END AS ta,
    CASE WHEN trim(b_title) = '' AND lower(b_post) LIKE '%esq%' THEN 'esq.' ELSE lower(trim(b_title)) END AS tb,
    lower(trim(parsed_first)) AS fa, lower(trim(b_first)) AS fb, lower(trim(parsed_postnominals)) AS pa, lower(trim(b_post)) AS pb,
    replace(lower(trim(parsed_location)), '-', '') AS la, replace(lower(trim(b_loc)), '-', '') AS lb,
    list_filter(list_transform(string_split_regex(lower(parsed_occupation), '\\s+'), lambda w: trim(w, '.,&')), lambda w: w NOT IN ('and', 'the', 'of', 'at', 'law', '&', 'mr', 'mrs', '')) AS oa,
    list_filter(list_transform(string_split_regex(lower(b_occ), '\\s+'), lambda w: trim(w, '.,&')), lambda w: w NOT IN ('and', 'the', 'of', 'at', 'law', '&', 'mr', 'mrs', '')) AS ob,
    regexp_replace(lower(parsed_affiliation), '[^a-z0-9]', '', 'g') AS aa, regexp_replace(lower(b_aff), '[^a-z0-9]', '', 'g') AS ab
  FROM p
), r AS (
  SELECT *, ta = tb OR (ta IN ('mr.', 'esq.', '') AND tb IN ('mr.', 'esq.', ''))
      OR array_to_string(list_filter(string_split(ta, ' '), lambda t: t <> 'mr.'), ' ') = array_to_string(list_filter(string_split(tb, ' '), lambda t: t <> 'mr.'), ' ') AS titles_ok,
    CASE WHEN fa = '' OR fb = '' THEN 'missing'
      WHEN length(trim(replace(fa, '.', ''))) <> 1 AND length(trim(replace(fb, '.', ''))) <> 1 THEN
        CASE WHEN fa = fb THEN 'exact' WHEN fa[1] = fb[1] AND levenshtein(fa, fb) <= (CASE WHEN least(length(fa), length(fb)) <= 3 THEN 1 WHEN least(length(fa), length(fb)) <= 6 THEN 2 ELSE 3 END) THEN 'fuzzy' ELSE 'conflict' END
      WHEN fa[1] = fb[1] THEN 'initial' ELSE 'conflict' END AS first_,
    CASE WHEN la = '' OR lb = '' THEN 'missing' WHEN la = lb THEN 'match' ELSE 'conflict' END AS loc_,
    CASE WHEN pa = '' OR pb = '' THEN 'missing' WHEN pa = pb THEN 'match' ELSE 'differ' END AS post_,
    CASE WHEN len(oa) = 0 OR len(ob) = 0 THEN 'missing' WHEN list_has_any(oa, ob) THEN 'match' ELSE 'conflict' END AS occ_,
    CASE WHEN aa = '' OR ab = '' THEN 'missing' WHEN contains(aa, ab) OR contains(ab, aa) THEN 'match' ELSE 'conflict' END AS aff_
  FROM q
)"""


def _compat(value: str) -> str:
    return f"{PAIRS} SELECT row_ord AS a, b_row AS b, {value} AS verdict FROM r"


TITLED = f"WITH t AS ({views.TITLED}), h AS ({views.HOLDERS})"
HELD = f"""{TITLED}, m AS (
  SELECT t.row_ord, count(*) AS c, min(h.person_name) AS holder FROM t JOIN h ON h.title_key = t.title_key
    AND CAST(t.year AS INT) BETWEEN coalesce(try_cast(h.start_year AS INT), -99999) AND coalesce(try_cast(h.end_year AS INT), 99999) GROUP BY t.row_ord
), x AS (SELECT t.*, CASE WHEN m.c = 1 THEN m.holder END AS holder FROM t LEFT JOIN m ON m.row_ord = t.row_ord)"""

GRAPH = f"""{S}, e AS (SELECT DISTINCT person_id, book FROM s), z AS (SELECT book, count(*) AS persons FROM e GROUP BY book),
w AS (SELECT book, min(CAST(year AS INT)) AS y FROM s GROUP BY book),
o AS (SELECT book, persons, row_number() OVER (ORDER BY w.y, book) AS place FROM z JOIN w USING (book)),
c AS (SELECT x.book AS a, y.book AS b, count(*) AS n FROM e x JOIN e y ON x.person_id = y.person_id AND x.book <> y.book GROUP BY ALL),
g AS (SELECT x.book AS work_a, y.book AS work_b, x.persons AS size_a, y.persons AS size_b, coalesce(c.n, 0) AS shared, (SELECT count(DISTINCT person_id) FROM e) AS population
  FROM o x JOIN o y ON x.place < y.place LEFT JOIN c ON c.a = x.book AND c.b = y.book)"""

_SEG = f"""{N}, x AS (
  SELECT row_ord, i - 1 AS k, regexp_replace(trim(seg), '[.,;: ]+$', '') AS seg FROM (SELECT row_ord, unnest(p) AS seg, generate_subscripts(p, 1) AS i FROM (SELECT row_ord, string_split_regex(listed_as, '[,;]') AS p FROM n))
), y AS (SELECT *, list_transform({_words("seg")}, lambda w: regexp_replace(lower(w), '\\.+$', '')) AS bare FROM x)"""

_AFF = parse.AFFILIATION.replace("(?iU)", "").replace("'", "''")
_COUNT = parse.COPY_COUNT.replace("(?iU)", "")
_RING = f"""{GRAPH}, f AS (
  SELECT z.book, CAST(z.book[7] AS INT) % 3 AS community, z.persons, w.y FROM z JOIN w USING (book)
), a AS (
  SELECT *, sqrt(greatest(200.0 + 3800.0 * persons / max(persons) OVER (), pow(12.0 * 0.62 * length(format('{{:,}}', persons)) / 0.72, 2))) AS radius,
    row_number() OVER (ORDER BY community, y, book) - 1 AS place FROM f
), b AS (SELECT *, sum(radius) OVER () AS total, lag(community) OVER (ORDER BY place) AS before FROM a
), d AS (SELECT *, CASE WHEN before IS NULL THEN 0.0 WHEN before = community THEN 0.02 * total ELSE 0.06 * total END AS gap FROM b
), k AS (SELECT *, sum(gap + radius) OVER (ORDER BY place) AS stop, sum(gap + radius) OVER () + (CASE WHEN first_value(community) OVER v <> last_value(community) OVER v THEN 0.06 * total ELSE 0.0 END) AS whole
  FROM d WINDOW v AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), ring AS (SELECT book, community, place, radius, pi() / 2 - 2 * pi() * (stop - radius / 2) / whole AS angle FROM k)"""

SQL = {
    "entry_id": L + """ SELECT row_ord, concat_ws('-', regexp_replace(string_split_regex(trim(author), '\\s+')[1], ',+$', ''),
      coalesce(list_filter(string_split_regex(trim(book), '\\s+'), lambda w: lower(w) NOT IN ('a', 'an', 'the'))[1], string_split_regex(trim(book), '\\s+')[1]),
      edition, printf('%04d', row_ord)) AS entry_id FROM l WHERE trim(book) <> '' AND trim(author) <> ''""",
    "auto_number": L + """, m AS (SELECT *, coalesce(max(try_cast(trim(no) AS INT)) OVER (PARTITION BY file, edition), 0) AS top FROM l),
      k AS (SELECT *, row_number() OVER (PARTITION BY file, edition, trim(no) = '' ORDER BY row_ord) AS turn FROM m WHERE trim(author) <> '' AND trim(book) <> '' AND trim(edition) <> '' AND trim(listed_as) <> '')
      SELECT row_ord, CAST(CASE WHEN trim(no) = '' THEN top + turn ELSE try_cast(trim(no) AS INT) END AS BIGINT) AS number FROM k""",
    "blank_filter": L + " SELECT row_ord, author, book FROM l WHERE trim(author) <> '' AND trim(book) <> '' AND trim(edition) <> '' AND trim(listed_as) <> ''",
    "dup_key_check": L + " SELECT file, concat_ws('-', edition, no) AS entry_id, count(*) AS \"rows\" FROM l GROUP BY 1, 2 HAVING count(*) > 1",
    "refined_coalesce": L + " SELECT row_ord, CASE WHEN trim(refined) <> '' THEN refined ELSE listed_as END AS normalization_input FROM l",
    "extra_union": L + " SELECT row_ord, book, '' AS year FROM l WHERE row_ord % 2 = 0 UNION ALL SELECT row_ord, '' AS book, year FROM l WHERE row_ord % 2 = 1",
    "compound_split": N + f""", x AS (SELECT entry_id, listed_as AS nm, instr(listed_as, ' and ') AS p FROM n),
      y AS (SELECT *, trim(substr(nm, 1, p - 1)) AS lft, trim(substr(nm, p + 5)) AS rgt FROM x),
      z AS (SELECT *, array_to_string({_words("rgt")}, ' ') AS w FROM y),
      k AS (SELECT *, p > 0 AND list_has_any({_words("lft")}, {_list(ingest.COMPOUND_TITLES)}) AND regexp_matches(w, '^(?:(?:Dowager|Right|Most) )?(?:{_any(ingest.COMPOUND_TITLES)})(?: .*)?$') AS two,
        trim(regexp_extract(w, '^(?:(?:Dowager|Right|Most) )?(?:{_any(ingest.COMPOUND_TITLES)})(?: (.*))?$', 1)) AS more FROM z)
      SELECT concat(entry_id, 'a') AS entry_id, entry_id AS source_entry_id, concat(entry_id, 'a') AS person_id, CASE WHEN more <> '' THEN concat(lft, ' ', more) ELSE lft END AS name FROM k WHERE two
      UNION ALL SELECT concat(entry_id, 'b'), entry_id, concat(entry_id, 'b'), rgt FROM k WHERE two UNION ALL SELECT entry_id, entry_id, entry_id, nm FROM k WHERE NOT two""",
    "norm_punct": _text("replace(replace(translate(listed_as, ',;', '  '), '[?]', ''), ' & ', ' and ')"),
    "norm_spelling": _text("replace(regexp_replace(regexp_replace(regexp_replace(listed_as, '\\bNew Town\\b', 'Newtown', 'gi'), '\\bWyndham\\b', chr(1), 'gi'), '\\bWundham\\b', 'Wyndham', 'gi'), chr(1), 'Windham')"),
    "norm_titles": _text(_titles),
    "norm_periods": _text(_periods),
    "norm_honorifics": _text(_chain("listed_as", [("(?:His|Her) Grace the\\s+", "", "gi"), ("(?:His|Her) (?:Royal )?Highness the\\s+", "", "gi"), ("His\\s+Excellen(?:ce|cy)\\s+(?:the\\s+)?", "", "gi")])),
    "norm_first_names": N + f""", m(k, v) AS (VALUES {_first_values}), t AS (SELECT row_ord, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT row_ord, {_words("listed_as")} AS w FROM n)),
      g AS (SELECT row_ord, bool_or(regexp_replace(lower(tok), '\\.+$', '') IN ('mr','esq','sir','rev','capt','col','dr','lt','adm','sgt','prof','hon')) AS he,
        bool_or(regexp_replace(lower(tok), '\\.+$', '') IN ('mrs','miss','ms','dame','lady')) AS she FROM t GROUP BY row_ord)
      SELECT row_ord, string_agg(coalesce(CASE WHEN lower(tok) IN ('fran.', 'fran') THEN CASE WHEN he AND NOT she THEN 'Francis' WHEN she AND NOT he THEN 'Frances' END END, v, tok), ' ' ORDER BY i) AS name
      FROM t JOIN g USING (row_ord) LEFT JOIN m ON m.k = lower(tok) GROUP BY row_ord""",
    "norm_annotations": _text("regexp_replace(listed_as, '" + "|".join(f"(?:{p})" for p in text.COPIES) + "', '', 'gi')"),
    "norm_ditto": _text("regexp_replace(listed_as, '\\s+(?:\\d+\\s+)?(?:of\\s+)?(?:ditto|do\\.?)\\s*$', '', 'i')"),
    "norm_dashes": _text("regexp_replace(regexp_replace(listed_as, '[-–—]{2,}', '----', 'g'), '(----)([A-Za-z])', '\\1 \\2', 'g')"),
    "norm_trailing": N + f""", x AS (SELECT row_ord, regexp_replace(listed_as, ':+$', '') AS y FROM n), z AS (SELECT *, string_split_regex(y, '\\s+')[-1] AS last_ FROM x)
      SELECT row_ord, regexp_replace(regexp_replace(CASE WHEN suffix(y, '.') AND NOT list_contains({_list(text.ABBREVIATIONS)}, regexp_replace(last_, '\\.+$', ''))
        AND NOT (length(last_) <= 4 AND regexp_matches(last_, '[A-Za-z]\\.')) THEN substr(y, 1, length(y) - 1) ELSE y END, '\\.\\s*\\.', '.', 'g'), '\\b({"|".join(text.WHOLE_WORDS)})\\.\\s', '\\1 ', 'gi') AS name FROM z""",
    "order_votes": VOTES + " SELECT row_ord, vote, lead, trail FROM votes",
    "order_sorted_fraction": VOTES + " SELECT * FROM fractions",
    "order_detect": VOTES + """, t AS (SELECT list_key, CAST(sum(greatest(vote, 0)) AS BIGINT) AS fl, CAST(sum(greatest(-vote, 0)) AS BIGINT) AS lf FROM votes GROUP BY list_key),
      d AS (SELECT t.*, fl + lf AS n_votes, lf / greatest(fl + lf, 1) AS part, coalesce(alpha_lead, 0.0) AS alpha_lead, coalesce(alpha_trail, 0.0) AS alpha_trail FROM t LEFT JOIN fractions USING (list_key)),
      k AS (SELECT *, CASE WHEN n_votes >= 5 AND part >= 0.6 THEN 1 WHEN n_votes >= 5 AND part <= 0.4 THEN 2 WHEN n_votes >= 5 AND alpha_lead - alpha_trail >= 0.15 THEN 3 WHEN n_votes >= 5 AND alpha_trail - alpha_lead >= 0.15 THEN 4
        WHEN n_votes < 5 AND alpha_lead >= 0.9 AND alpha_lead - alpha_trail >= 0.15 THEN 3 WHEN n_votes < 5 AND alpha_trail >= 0.9 AND alpha_trail - alpha_lead >= 0.15 THEN 4 ELSE 5 END AS w FROM d)
      SELECT list_key, CASE WHEN w IN (1, 3) THEN 'last-first' ELSE 'first-last' END AS "order", CASE WHEN w <= 2 THEN 'high' ELSE 'low' END AS confidence,
        CASE WHEN w <= 2 THEN 'votes' WHEN w <= 4 THEN 'alphabetization' ELSE 'default' END AS source, n_votes, fl, lf, alpha_lead, alpha_trail FROM k""",
    "leading_titles": N + f""", x AS (SELECT row_ord, normalized_name, regexp_extract(normalized_name, '^((?:(?:{_any(parse.LEADING_PAIRS)}|{_any(parse.LEADING)})(?:\\s+|$))*)', 1, 'i') AS t FROM n)
      SELECT row_ord, trim(t) AS title, substr(normalized_name, length(t) + 1) AS rest FROM x""",
    "split_first_last": N + """, x AS (SELECT row_ord, trim(concat_ws(' ', parsed_first, parsed_last)) AS nm FROM n), y AS (SELECT *, regexp_extract(nm, '^((?:(?:[A-Z]\\.|----)(?:\\s+|$))+)', 1) AS i FROM x)
      SELECT row_ord, CASE WHEN i <> '' THEN trim(i) WHEN regexp_matches(nm, '\\s') THEN regexp_extract(nm, '^(\\S+)', 1) ELSE '' END AS first_name,
        CASE WHEN i <> '' THEN substr(nm, length(i) + 1) WHEN regexp_matches(nm, '\\s') THEN regexp_extract(nm, '^\\S+\\s+(.*)$', 1) ELSE nm END AS last_name FROM y""",
    "residual_types": _SEG + f""", z AS (SELECT *, CASE WHEN seg = '' THEN '' WHEN regexp_matches(seg, '^(?:\\d+\\s+)?(?:ditto|do\\.?)$', 'i') THEN 'ditto' WHEN regexp_matches(seg, '{_COUNT}', 'i') THEN 'note'
        WHEN regexp_matches(seg, '{_AFF}', 'i') THEN 'affiliation'
        WHEN len(list_filter(bare, lambda w: w NOT IN ('esq', 'bart', 'jun', 'sen', 'ditto', 'do'))) = 0 THEN CASE WHEN list_has_any(bare, ['esq', 'bart', 'jun', 'sen']) THEN 'postnominal' ELSE 'note' END
        WHEN len(list_filter({_words("seg")}, lambda w: NOT regexp_matches(w, '^[A-Z]{{1,2}}\\.*$'))) = 0 THEN 'postnominal'
        WHEN list_has_any(bare, ['bookseller', 'printer', 'attorney']) THEN 'occupation' WHEN len(list_filter({_words("seg")}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN 'location' ELSE 'note' END AS kind FROM y)
      SELECT row_ord, k, kind, CASE WHEN kind = '' THEN '' WHEN kind = 'ditto' THEN 'ditto' WHEN kind = 'affiliation' THEN regexp_extract(seg, '{_AFF}', 0, 'i') ELSE seg END AS said FROM z""",
    "notes_extract": N + f""", x AS (SELECT row_ord, [trim(regexp_extract(listed_as, '{_COUNT}', 1, 'i')), CASE WHEN regexp_matches(listed_as, '\\bditto\\b', 'i') THEN 'ditto' ELSE '' END,
        CASE WHEN regexp_matches(listed_as, '\\bregiment\\b', 'i') THEN regexp_extract(listed_as, '(\\d+\\w*\\s+regiment\\b)', 1, 'i') ELSE '' END,
        CASE WHEN contains(lower(listed_as), 'the son of') THEN concat('son of ', regexp_extract(listed_as, 'the\\s+son\\s+of\\s+(.+?)(?:,|$)', 1, 'i')) ELSE '' END,
        trim(regexp_extract(listed_as, '\\bof the (?:Royal Navy|Inner Temple|Middle Temple)\\b', 0, 'i'))] AS parts FROM n)
      SELECT row_ord, array_to_string(list_filter(parts, lambda p: p <> ''), '; ') AS notes FROM x""",
    "compat_titles": _compat("titles_ok"),
    "compat_first": _compat("first_"),
    "compat_location": _compat("loc_"),
    "compat_postnominals": _compat("post_"),
    "compat_occupation": _compat("occ_"),
    "compat_affiliation": _compat("aff_"),
    "allowed_distance": _compat("CAST((CASE WHEN length(trim(parsed_last)) <= 4 THEN 0 WHEN length(trim(parsed_last)) <= 7 THEN 1 ELSE 2 END) + CAST(first_ = 'exact' AS INT) AS INT)"),
    "match_pairs": PAIRS + """, k AS (SELECT *, ta = tb AS same, ta = tb OR (ta IN ('mr.', 'esq.', '') AND tb IN ('mr.', 'esq.', '')) AS alike, ta NOT IN ('mr.', 'esq.', '') AS distinct_,
        (CASE WHEN ta NOT IN ('mr.', 'esq.', '') THEN 1.0 ELSE 0 END) + (CASE first_ WHEN 'exact' THEN 1.0 WHEN 'initial' THEN 0.5 ELSE 0 END) + (CASE WHEN loc_ = 'match' THEN 1.0 ELSE 0 END)
        + (CASE WHEN occ_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN aff_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN post_ = 'match' THEN 0.5 ELSE 0 END) AS signals FROM r
        WHERE edition <> b_edition AND titles_ok AND first_ <> 'conflict' AND loc_ <> 'conflict' AND occ_ <> 'conflict' AND aff_ <> 'conflict'),
      v AS (SELECT row_ord AS a, b_row AS b, CASE WHEN (first_ IN ('exact', 'initial') AND alike) OR (first_ = 'missing' AND same)
          THEN concat_ws('+', 'exact_last', concat(first_, '_first'), CASE WHEN loc_ = 'match' THEN 'loc' END, CASE WHEN post_ = 'match' THEN 'post' END)
        WHEN first_ = 'fuzzy' AND alike THEN concat_ws('+', 'exact_last', 'fuzzy_first', CASE WHEN distinct_ THEN 'title' END, CASE WHEN loc_ = 'match' THEN 'loc' END, CASE WHEN post_ = 'match' THEN 'post' END)
        WHEN signals >= 1 THEN concat_ws('+', 'exact_last', concat(first_, '_first'), CASE WHEN loc_ = 'match' THEN 'loc' END, CASE WHEN occ_ = 'match' THEN 'occ' END, CASE WHEN aff_ = 'match' THEN 'aff' END, CASE WHEN post_ = 'match' THEN 'post' END) END AS verdict FROM k)
      SELECT * FROM v WHERE verdict IS NOT NULL""",
    "fuzzy_last_pairs": N + """, d AS (SELECT DISTINCT lower(parsed_last) AS s FROM n WHERE parsed_last <> '') SELECT x.s AS a, y.s AS b, CAST(levenshtein(x.s, y.s) AS INT) AS distance FROM d x JOIN d y ON x.s < y.s AND levenshtein(x.s, y.s) <= 3""",
    "coexistence_pairs": N + """, x AS (SELECT DISTINCT book, edition, CASE WHEN trim(parsed_title) = '' AND lower(parsed_postnominals) LIKE '%esq%' THEN 'esq.' ELSE lower(trim(parsed_title)) END AS title,
        lower(trim(parsed_last)) AS "last", lower(trim(parsed_first)) AS f, lower(trim(parsed_postnominals)) AS p FROM n WHERE trim(parsed_last) <> '')
      SELECT DISTINCT a.title, a."last", a.f AS first_a, a.p AS post_a, b.f AS first_b, b.p AS post_b FROM x a JOIN x b USING (book, edition, title, "last") WHERE (a.f < b.f OR (a.f = b.f AND a.p < b.p)) AND ((a.f = '') <> (b.f = '') OR a.p <> b.p)""",
    "cross_eligible_strict": N + " SELECT row_ord FROM n WHERE lower(trim(parsed_title)) NOT IN ('mr.', 'mrs.', 'miss', 'esq.', '') OR trim(parsed_location) <> '' OR trim(parsed_postnominals) <> '' OR trim(parsed_occupation) <> '' OR trim(parsed_affiliation) <> ''",
    "cross_eligible_relaxed": N + " SELECT row_ord FROM n WHERE lower(trim(parsed_title)) NOT IN ('mr.', 'mrs.', 'miss', 'esq.', '') OR trim(parsed_location) <> '' OR trim(parsed_postnominals) <> '' OR trim(parsed_occupation) <> '' OR trim(parsed_affiliation) <> '' OR trim(parsed_first) <> ''",
    "title_groups": HELD + """, g AS (SELECT *, count(*) OVER (PARTITION BY title_key) AS size FROM x), k AS (SELECT title_key, count(*) AS terms FROM h GROUP BY title_key),
      y AS (SELECT g.*, CASE WHEN k.terms > 1 THEN coalesce(holder, '_unresolved_') ELSE '' END AS part FROM g LEFT JOIN k USING (title_key) WHERE size >= 2),
      b AS (SELECT title_key, count(DISTINCT part) > 1 AS split FROM y GROUP BY title_key), z AS (SELECT y.* REPLACE (CASE WHEN b.split THEN part ELSE '' END AS part), b.split FROM y JOIN b USING (title_key)),
      p AS (SELECT title_key, part, split, count(*) AS c, count(DISTINCT (book, edition)) AS d, min(row_ord) AS f FROM z GROUP BY ALL),
      q AS (SELECT DISTINCT title_key, '' AS part, TRUE AS parent, -1 AS f FROM p UNION ALL SELECT title_key, part, FALSE, f FROM p WHERE split AND c >= 2),
      r AS (SELECT *, row_number() OVER (ORDER BY title_key, f) AS num FROM q)
      SELECT z.row_ord, printf('tt_%04d', r.num) AS group_id, CASE WHEN p.c <> p.d THEN '' ELSE 'y' END AS "match", coalesce(holder, '') AS title_holder, CASE WHEN z.split THEN 'title_holder' ELSE 'title_same' END AS match_tier
      FROM z JOIN p ON p.title_key = z.title_key AND p.part = z.part JOIN r ON r.title_key = z.title_key AND r.part = z.part AND r.parent = NOT z.split WHERE NOT z.split OR p.c >= 2""",
    "title_collisions": TITLED + " SELECT title_key, count(*) AS entries, count(*) <> count(DISTINCT (book, edition)) AS collides FROM t GROUP BY title_key HAVING count(*) >= 2",
    "title_holder_range": HELD + " SELECT row_ord, title_key, holder FROM x WHERE holder IS NOT NULL",
    "group_to_pairs": f"WITH r AS ({views.REVIEWED})" + """, l AS (SELECT *, first_value("match") OVER (PARTITION BY group_id ORDER BY row_ord) AS head FROM r), p AS (SELECT a.*, b.entry_id AS eb, b.normalized_name AS nb, concat_ws('|', b.book, b.edition) AS cb, b."match" AS mb
        FROM l a JOIN l b ON a.group_id = b.group_id AND a.row_ord < b.row_ord WHERE a.head IN ('y', 'n')), v AS (SELECT *, concat_ws('|', book, edition) AS ca, CASE WHEN head = 'n' THEN 'n' WHEN "match" = 'x' AND mb = 'x' THEN NULL WHEN "match" = 'x' OR mb = 'x' THEN 'n' ELSE 'y' END AS verdict FROM p)
      SELECT least(entry_id, eb) AS entry_a, greatest(entry_id, eb) AS entry_b, verdict, CASE WHEN entry_id <= eb THEN normalized_name ELSE nb END AS name_a, CASE WHEN entry_id <= eb THEN nb ELSE normalized_name END AS name_b,
        CASE WHEN entry_id <= eb THEN ca ELSE cb END AS context_a, CASE WHEN entry_id <= eb THEN cb ELSE ca END AS context_b FROM v WHERE verdict IS NOT NULL""",
    "identity_collapse": f"WITH m AS ({views.MATCHES})" + """, l AS (SELECT *, first_value("match") OVER w AS head, min(row_ord) OVER (PARTITION BY file, group_id) AS g FROM m WINDOW w AS (PARTITION BY file, group_id ORDER BY row_ord)),
      k AS (SELECT *, first_value(entry_id) OVER (PARTITION BY file, group_id ORDER BY row_ord) AS canonical, count(*) OVER (PARTITION BY file, group_id) AS size FROM l WHERE head = 'y' AND "match" <> 'x')
      SELECT entry_id, arg_max(canonical, file * 1000000000000 + row_ord) AS person_id, count(DISTINCT (file, group_id)) AS "groups" FROM k WHERE size >= 2 GROUP BY entry_id""",
    "edition_overview": S + """, a AS (SELECT DISTINCT person_id, CAST(edition AS BIGINT) AS ed FROM s), t AS (SELECT ed, count(*) AS total, lag(ed) OVER (ORDER BY ed) AS prev FROM a GROUP BY ed),
      c AS (SELECT t.ed, count(*) AS stayed FROM t JOIN a x ON x.ed = t.ed JOIN a y ON y.person_id = x.person_id AND y.ed = t.prev GROUP BY t.ed)
      SELECT t.ed AS edition, t.total, t.total - coalesce(stayed, 0) AS new, coalesce(stayed, 0) AS continued, coalesce(p.total, 0) - coalesce(stayed, 0) AS departed FROM t LEFT JOIN c ON c.ed = t.ed LEFT JOIN t p ON p.ed = t.prev""",
    "arrivals_departures": N + """ SELECT concat_ws('-', parsed_first, parsed_last, book) AS person_id, min(CAST(edition AS INT)) AS first_ed, max(CAST(edition AS INT)) AS last_ed, string_agg(DISTINCT edition, ',' ORDER BY edition) AS editions FROM n GROUP BY 1""",
    "missed_match_scores": N + """, p AS (SELECT concat_ws('-', parsed_first, parsed_last, parsed_title, book) AS pid, min(CAST(edition AS INT)) AS lo, max(CAST(edition AS INT)) AS hi, string_agg(DISTINCT edition, ',' ORDER BY edition) AS eds,
        arg_min({'t': trim(parsed_title), 'f': trim(parsed_first), 'l': trim(parsed_last), 'p': trim(parsed_postnominals), 'c': trim(parsed_location)}, row_ord - CAST(1000000000 AS BIGINT) * (CAST(trim(parsed_title) <> '' AS INT) + CAST(trim(parsed_first) <> '' AS INT)
          + CAST(trim(parsed_last) <> '' AS INT) + CAST(trim(parsed_postnominals) <> '' AS INT) + CAST(trim(parsed_location) <> '' AS INT))) AS s FROM n GROUP BY 1),
      m AS (SELECT d.pid AS dep_pid, a.pid AS arr_pid, d.eds AS dep_editions, a.eds AS arr_editions, d.s AS ds, a.s AS zs, lower(d.s.l) AS dl, lower(a.s.l) AS al, lower(d.s.f) AS df, lower(a.s.f) AS af, lower(d.s.c) AS dc, lower(a.s.c) AS ac FROM p d JOIN p a ON d.hi + 1 = a.lo WHERE d.s.l <> '' AND a.s.l <> ''),
      k AS (SELECT *, CASE WHEN dl = al THEN 3.0::DOUBLE ELSE CASE WHEN q >= 0.85 THEN 2.5::DOUBLE WHEN q >= 0.7 THEN 1.5::DOUBLE WHEN q >= 0.55 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END END AS s1 FROM (SELECT *, 1.0::DOUBLE - levenshtein(dl, al)::DOUBLE / greatest(length(dl), length(al)) AS q FROM m)),
      r AS (SELECT *, s1 + (CASE WHEN ds.t = zs.t OR (ds.t IN ('Mr.', 'Esq.', '') AND zs.t IN ('Mr.', 'Esq.', '')) OR (ds.t IN ('Rev.', 'Rev. Mr.') AND zs.t IN ('Rev.', 'Rev. Mr.')) OR (ds.t IN ('Mrs.', '') AND zs.t IN ('Mrs.', '')) OR (ds.t IN ('Miss', '') AND zs.t IN ('Miss', '')) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)
        + (CASE WHEN df = '' OR af = '' THEN 0.3::DOUBLE WHEN df = af THEN 1.0::DOUBLE WHEN (length(df) = 1 AND starts_with(af, df)) OR (length(af) = 1 AND starts_with(df, af)) THEN 0.7::DOUBLE WHEN df[1] <> af[1] THEN -0.5::DOUBLE ELSE 0.3::DOUBLE END)
        + (CASE WHEN dc = '' OR ac = '' THEN 0.0::DOUBLE WHEN dc = ac THEN 1.0::DOUBLE ELSE -0.3::DOUBLE END) + (CASE WHEN ds.p <> '' AND lower(ds.p) = lower(zs.p) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM k WHERE s1 > 0)
      SELECT dep_pid, arr_pid, score, ds.l AS dep_last, zs.l AS arr_last, dep_editions, arr_editions FROM r WHERE score >= 2.5""",
    "work_nodes": S + " SELECT book, arg_min(author, row_ord) AS author, min(CAST(year AS INT)) AS first_year, max(CAST(year AS INT)) AS last_year, book AS label FROM s GROUP BY book",
    "person_nodes": S + " SELECT person_id, arg_max(normalized_name, row_ord) AS normalized_name, arg_max(normalized_name, row_ord) AS label FROM s GROUP BY person_id",
    "edges": S + " SELECT DISTINCT person_id, book FROM s",
    "author_conflicts": S + ", k AS (SELECT book, arg_min(author, row_ord) AS kept FROM s GROUP BY book) SELECT s.book, kept, s.author, count(*) AS \"rows\" FROM s JOIN k ON k.book = s.book WHERE s.author <> kept GROUP BY ALL",
    "overlap_count": GRAPH + " SELECT work_a, work_b, CAST(shared AS DOUBLE) AS \"value\" FROM g",
    "overlap_jaccard": GRAPH + " SELECT work_a, work_b, CASE WHEN size_a + size_b - shared > 0 THEN shared / (size_a + size_b - shared) ELSE 0.0 END AS \"value\" FROM g",
    "overlap_repr": GRAPH + " SELECT work_a, work_b, CASE WHEN size_a * size_b > 0 THEN shared / (size_a * size_b / population) ELSE 0.0 END AS \"value\" FROM g",
    "shared_persons": S + ", k AS (SELECT person_id, arg_max(normalized_name, row_ord) AS normalized_name, count(DISTINCT book) AS num_works, string_agg(DISTINCT book, '; ' ORDER BY book) AS works FROM s GROUP BY person_id) SELECT * FROM k WHERE num_works >= 2",
    "projected_edges": GRAPH + " SELECT work_a, work_b, shared / (size_a + size_b - shared) AS weight FROM g WHERE shared > 0",
    "community_order": GRAPH + ", m AS (SELECT book, w.y, CASE WHEN book[7] = '3' THEN -1 ELSE CAST(book[7] AS INT) % 3 END AS community FROM w) SELECT book, community, CAST(row_number() OVER (ORDER BY community < 0, community, y, book) - 1 AS INT) AS place FROM m",
    "book_color": """WITH b AS (SELECT p_partkey AS id, md5(concat_ws(' ', 'The', p_name, 'and the', p_type, 'of', p_brand)) AS h FROM part), x AS (SELECT id, list_transform(range(1, 33), lambda i: instr('0123456789abcdef', h[i]) - 1) AS d FROM b)
      SELECT id, ['#1f77b4','#aec7e8','#ff7f0e','#ffbb78','#4C4A6C','#98df8a','#d62728','#ff9896','#9467bd','#c5b0d5','#8c564b','#c49c94','#e377c2','#f7b6d2','#7f7f7f','#c7c7c7','#bcbd22','#dbdb8d','#17becf','#9edae5'][CAST((16 * list_sum(d[1:31]) + d[32]) % 20 AS INT) + 1] AS color FROM x""",
    "author_last": "SELECT p_partkey AS id, CASE WHEN contains(p_type, ',') THEN trim(split_part(p_type, ',', 1)) ELSE string_split_regex(trim(p_type), '\\s+')[-1] END AS surname FROM part",
    "book_abbr": """WITH b AS (SELECT p_partkey AS id, string_split_regex(trim(concat_ws(' ', 'The', p_name, 'and the', p_type, 'of', p_brand)), '\\s+') AS w FROM part)
      SELECT id, array_to_string(list_transform(list_filter(w, lambda t: lower(t) NOT IN ('a', 'an', 'the', 'of', 'in', 'on', 'to', 'for')), lambda t: CASE WHEN lower(t) = 'and' THEN '&' ELSE upper(t[1]) END), '') AS abbr FROM b""",
    "short_title": """WITH RECURSIVE b AS (SELECT p_partkey AS id, regexp_replace(trim(concat_ws(' ', 'The', p_name, 'and the', p_type, 'of', p_brand)), '^(?:the|an|a)\\s+', '', 'i') AS t FROM part),
      u AS (SELECT id, CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) ELSE t END AS t FROM b), w AS (SELECT id, t, string_split_regex(t, '\\s+') AS ws FROM u),
      k AS (SELECT id, 0 AS i, '' AS kept, FALSE AS stop FROM w UNION ALL SELECT k.id, i + 1, CASE WHEN length(kept) + length(ws[i + 1]) + 1 > 24 THEN kept WHEN kept = '' THEN ws[i + 1] ELSE concat(kept, ' ', ws[i + 1]) END, length(kept) + length(ws[i + 1]) + 1 > 24
        FROM k JOIN w ON w.id = k.id WHERE NOT stop AND i < len(ws)), f AS (SELECT id, arg_max(kept, i) AS kept FROM k GROUP BY id)
      SELECT w.id, CASE WHEN length(t) <= 24 THEN t ELSE concat(regexp_replace(CASE WHEN regexp_replace(kept, '(?:(?:^|\\s+)(?:a|an|the|of|in|on|to|for))+$', '', 'i') <> '' THEN regexp_replace(kept, '(?:(?:^|\\s+)(?:a|an|the|of|in|on|to|for))+$', '', 'i') ELSE rtrim(t[1:24]) END, '[,;:]+$', ''), '…') END AS title FROM w JOIN f ON f.id = w.id""",
    "chord_widths": GRAPH + ", k AS (SELECT *, min(shared) OVER () AS lo, max(shared) OVER () AS hi FROM g WHERE shared > 0) SELECT work_a, work_b, shared, CASE WHEN hi = lo THEN 3.0 ELSE 0.5 + 11.5 * ((shared - lo) / (hi - lo)) END AS width FROM k",
    "ring_layout": _RING + " SELECT book, community, angle, cos(angle) AS x, sin(angle) AS y, radius FROM ring",
    "value_range": GRAPH + ", k AS (SELECT shared / (size_a * size_b / population) AS v FROM g) SELECT least(min(v), 0.999::DOUBLE) AS vmin, 1.0::DOUBLE AS vcenter, greatest(max(v), 1.0001::DOUBLE) AS vmax FROM k",
}

SQL["ledger_harvest"] = SQL["group_to_pairs"].replace("WITH r AS", f"WITH o AS ({views.LEDGER}), r AS", 1).replace("SELECT least(entry_id, eb) AS entry_a", ", f AS (SELECT least(entry_id, eb) AS entry_a", 1) + """)
  SELECT coalesce(f.entry_a, o.entry_a) AS entry_a, coalesce(f.entry_b, o.entry_b) AS entry_b, coalesce(f.verdict, o.verdict) AS verdict,
    CASE WHEN o.verdict IS NOT NULL AND f.verdict <> o.verdict THEN concat('[was ', o.verdict, ', now ', f.verdict, ']') ELSE '' END AS note,
    CASE WHEN o.verdict IS NULL OR f.verdict <> o.verdict THEN f.name_a ELSE o.name_a END AS name_a, CASE WHEN o.verdict IS NULL OR f.verdict <> o.verdict THEN f.context_b ELSE o.context_b END AS context_b
  FROM f FULL JOIN o ON f.entry_a = o.entry_a AND f.entry_b = o.entry_b"""

_SPACING = [(r"\.-([A-Z][a-z])", r". \1", "g"), (r"\.([A-Za-z])", r". \1", "g"), ("([a-z])([A-Z])", r"\1 \2", "g"), (r"\bMc ([A-Z])", r"Mc\1", "g"),
            (r"\bMac ([A-Z])", r"Mac\1", "g"), (r"([a-z])of(\s|[A-Z])", r"\1 of\2", "g"), (r"\b([A-Z]) \.", r"\1.", "g")]
_HONORIFICS = [(r"(?:His|Her) Grace the\s+", "", "gi"), (r"(?:His|Her) (?:Royal )?Highness the\s+", "", "gi"), (r"His\s+Excellen(?:ce|cy)\s+(?:the\s+)?", "", "gi")]
_PEERS = f"(?:Dowager )?(?:{text.PEERAGES})"
# Where a pattern has to look ahead, letters are taken along, and a second pass finds what the first has stepped over.
_INITIALS = [(r"\b([A-Z])\.\s*([A-Z])\.", r"\1. \2.", "g"), *[(r"\b([A-Z])\s([A-Z][.\s])", r"\1. \2", "g")] * 2, (r"(\. [A-Z]) ([A-Z])", r"\1. \2", "g")]


def _peerage(c: str) -> str:
    """No title is taken for a place: a Dowager who follows is put out of sight."""
    hidden = _chain(c, [(rf"\b({_PEERS})\s+Dowager\b", r"\1 !owager", "g")])
    return f"replace({_chain(hidden, [(rf'\b({_PEERS})\s+([A-Z])', r'\1 of \2', 'g')])}, '!owager', 'Dowager')"


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _spelt(c: str) -> str:
    return f"replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\bNew Town\\b', 'Newtown', 'gi'), '\\bWyndham\\b', chr(1), 'gi'), '\\bWundham\\b', 'Wyndham', 'gi'), chr(1), 'Windham')"


def _from(new: str, old: str = "listed_as") -> str:
    """An expression over the listed name as one over a column of another name."""
    return new.replace("listed_as", old)


_POST = "|".join(x.replace(".", r"\.") for x in parse.POSTNOMINAL_PAIRS + parse.POSTNOMINALS)
_WIDE_POST = "|".join(x.replace(".", r"\.").replace(" ", "  ") for x in parse.POSTNOMINAL_PAIRS + parse.POSTNOMINALS)
_COPIES = "|".join(f"(?:{p})" for p in text.COPIES)
_TITLES_OF = "|".join(text.TITLES_WITH_OF)
_PLAIN_TITLE = "CASE WHEN trim(parsed_title) = '' AND lower(parsed_postnominals) LIKE '%esq%' THEN 'esq.' ELSE lower(trim(parsed_title)) END"
_CROSS = PAIRS.replace("b.row_ord AS b_row,", "b.row_ord AS b_row, b.book AS b_book,").replace(
    "ON a.parsed_last = b.parsed_last AND a.book = b.book AND a.row_ord < b.row_ord WHERE a.parsed_last <> ''",
    "ON substr(a.parsed_last, 1, 2) = substr(b.parsed_last, 1, 2) AND a.row_ord < b.row_ord WHERE a.parsed_last <> '' AND b.parsed_last <> ''",
)
_PREFIX = "^(?:de la|de|du|la|le|van|von) "
_BOOKS = "b AS (SELECT p_partkey AS id, p_type AS author, concat_ws(' ', 'The', p_name, 'and the', p_type, 'of', p_brand) AS book FROM part)"
_IDS = SQL["identity_collapse"]
_FILE_NAMES = [present.ISOLATE_COLOR, *present.CLUSTER_COLORS]

SQL |= {
    "norm_spacing": _text(_chain("listed_as", _SPACING)),
    "norm_squeeze": _text(_squeezed("concat('  ', translate(listed_as, ',', chr(9)))")),
    "norm_the": _text("regexp_replace(listed_as, '^The\\s+', '', 'i')"),
    "norm_geographic_of": _text(f"replace(replace(regexp_replace(concat(listed_as, ' of Kent and Duke of York'), '(^|\\s)({_TITLES_OF})(\\.*) of ', '\\1\\2\\3!of ', 'gi'), ' of ', ' '), '!of ', ' of ')"),
    "norm_changed": N + f""" SELECT count(*) FILTER (replace(replace(translate(listed_as, ',;', '  '), '[?]', ''), ' & ', ' and ') <> listed_as) AS punct,
      count(*) FILTER (regexp_replace(listed_as, '\\s+(?:\\d+\\s+)?(?:of\\s+)?(?:ditto|do\\.?)\\s*$', '', 'i') <> listed_as) AS ditto,
      count(*) FILTER ({_chain("listed_as", [("[-–—]{2,}", "----", "g"), ("(----)([A-Za-z])", r"\1 \2", "g")])} <> listed_as) AS dashes FROM n""",
    "norm_peerage_of": _text(_peerage("listed_as")),
    "norm_initials": _text(_chain("listed_as", _INITIALS)),
    "norm_full": N + f""", a AS (SELECT row_ord, {_squeezed(_chain("replace(replace(translate(listed_as, ',;', '  '), '[?]', ''), ' & ', ' and ')", _SPACING))} AS x FROM n),
      b AS (SELECT row_ord, {_spelt("x")} AS x FROM a), c AS (SELECT row_ord, {_from(_titles, "x")} AS x FROM b), d AS (SELECT row_ord, {_from(_periods, "x")} AS x FROM c),
      e AS (SELECT row_ord, {_peerage(_chain("x", _HONORIFICS))} AS x FROM d),
      m(k, v) AS (VALUES {_first_values}), t AS (SELECT row_ord, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT row_ord, {_words("x")} AS w FROM e)),
      g AS (SELECT row_ord, bool_or(regexp_replace(lower(tok), '\\.+$', '') IN ('mr','esq','sir','rev','capt','col','dr','lt','adm','sgt','prof','hon')) AS he,
        bool_or(regexp_replace(lower(tok), '\\.+$', '') IN ('mrs','miss','ms','dame','lady')) AS she FROM t GROUP BY row_ord),
      f AS (SELECT row_ord, string_agg(coalesce(CASE WHEN lower(tok) IN ('fran.', 'fran') THEN CASE WHEN he AND NOT she THEN 'Francis' WHEN she AND NOT he THEN 'Frances' END END, v, tok), ' ' ORDER BY i) AS x
        FROM t JOIN g USING (row_ord) LEFT JOIN m ON m.k = lower(tok) GROUP BY row_ord),
      h AS (SELECT row_ord, regexp_replace(regexp_replace(regexp_replace(coalesce(f.x, ''), '^The\\s+', '', 'i'), '{_COPIES}', '', 'gi'), '\\s+(?:\\d+\\s+)?(?:of\\s+)?(?:ditto|do\\.?)\\s*$', '', 'i') AS x FROM n LEFT JOIN f USING (row_ord)),
      j AS (SELECT row_ord, regexp_replace({_chain("x", [("[-–—]{2,}", "----", "g"), ("(----)([A-Za-z])", r"\1 \2", "g"), *_INITIALS])}, ':+$', '') AS y FROM h),
      z AS (SELECT *, string_split_regex(y, '\\s+')[-1] AS last_ FROM j)
      SELECT row_ord, {_squeezed(f'''regexp_replace(regexp_replace(CASE WHEN suffix(y, '.') AND NOT list_contains({_list(text.ABBREVIATIONS)}, regexp_replace(last_, '\\.+$', ''))
        AND NOT (length(last_) <= 4 AND regexp_matches(last_, '[A-Za-z]\\.')) THEN substr(y, 1, length(y) - 1) ELSE y END, '\\.\\s*\\.', '.', 'g'), '\\b({"|".join(text.WHOLE_WORDS)})\\.\\s', '\\1 ', 'gi')''')} AS name FROM z""",
    "order_joined": SQL["order_detect"].replace("SELECT list_key, CASE WHEN w IN (1, 3)", ", q AS (SELECT list_key, CASE WHEN w IN (1, 3)", 1) + """)
      SELECT n.row_ord, q."order" AS name_order FROM n JOIN q ON q.list_key = concat_ws('|', author, book, edition)""",
    "order_overrides": f"""SELECT list_key, CASE split_part(list_key, '|', 3) WHEN '1' THEN 'last-first' WHEN '2' THEN 'first-last' ELSE "order" END AS "order",
      CASE WHEN split_part(list_key, '|', 3) IN ('1', '2') THEN 'high' ELSE confidence END AS confidence, CASE WHEN split_part(list_key, '|', 3) IN ('1', '2') THEN 'override' ELSE source END AS source FROM ({SQL["order_detect"]}) x""",
    "trailing_postnominals": N + f""", x AS (SELECT row_ord, trim(concat_ws(' ', parsed_last, parsed_postnominals, CASE WHEN row_ord % 3 = 0 THEN 'Jun.' END)) AS nm FROM n),
      y AS (SELECT *, regexp_extract(nm, '((?:(?:^|\\s+)(?:{_POST}))+)$', 1, 'i') AS p FROM x) SELECT row_ord, trim(p) AS post, trim(substr(nm, 1, length(nm) - length(p))) AS rest FROM y""",
    "postnominals_anywhere": N + f""", x AS (SELECT row_ord, concat(' ', replace(trim(concat_ws(' ', parsed_postnominals, parsed_last, CASE WHEN row_ord % 3 = 0 THEN 'bart. M. P. x' END)), ' ', '  '), ' ') AS nm FROM n)
      SELECT row_ord, replace(array_to_string(list_transform(regexp_extract_all(nm, ' (?:{_WIDE_POST}) ', 0, 'i'), lambda p: trim(p)), ' '), '  ', ' ') AS post, {_squeezed(f"regexp_replace(nm, ' (?:{_WIDE_POST}) ', '', 'gi')")} AS rest FROM x""",
    "location_removed": N + f""", x AS (SELECT row_ord, parsed_location AS place, trim(concat_ws(' ', parsed_first, parsed_last, CASE WHEN row_ord % 2 = 0 THEN parsed_location END)) AS nm FROM n),
      y AS (SELECT *, {_words("nm")} AS w, {_words("place")} AS p FROM x)
      SELECT row_ord, CASE WHEN place = '' OR nm = '' THEN nm WHEN lower(array_to_string(w[greatest(1, len(w) - len(p) + 1):len(w)], ' ')) = lower(array_to_string(p, ' ')) THEN array_to_string(w[1:len(w) - len(p)], ' ') ELSE array_to_string(w, ' ') END AS name FROM y""",
    "words_corrected": _text(f"array_to_string(list_transform({_words('listed_as')}, lambda w: CASE lower(w) WHEN 'birch' THEN 'Beech' WHEN 'green' THEN 'Greene' ELSE w END), ' ')"),
    "surname_prefixes": N + f" SELECT row_ord, regexp_replace(lower(parsed_last), '{_PREFIX}', '') AS bare FROM n",
    "initials_only": N + """ SELECT row_ord, length(trim(replace(parsed_first, '.', ''))) = 1 AS one, regexp_matches(trim(replace(trim(parsed_first), '.', ' ')), '^\\S(?:\\s+\\S){1,}$') AS two,
      regexp_matches(trim(replace(trim(parsed_first), '.', ' ')), '^\\S(?:\\s+\\S){2,}$') AS three FROM n""",
    "signatures": N + f""" SELECT row_ord, {_PLAIN_TITLE} AS title, lower(trim(parsed_first)) AS "first", lower(trim(parsed_last)) AS "last", lower(trim(parsed_postnominals)) AS post FROM n""",
    "match_pairs_cross": _CROSS + f""", k AS (SELECT *, regexp_replace(lower(trim(parsed_last)), '{_PREFIX}', '') AS na, regexp_replace(lower(trim(b_last)), '{_PREFIX}', '') AS nb FROM r
        WHERE (edition <> b_edition OR book <> b_book) AND titles_ok AND first_ <> 'conflict' AND loc_ <> 'conflict' AND occ_ <> 'conflict' AND aff_ <> 'conflict'),
      u AS (SELECT *, na <> nb AND lb <> '' AND la = '' AND na = concat(nb, ' ', lb) AS in_a, na <> nb AND la <> '' AND lb = '' AND nb = concat(na, ' ', la) AS in_b FROM k),
      v AS (SELECT *, CASE WHEN in_a OR in_b THEN 0 ELSE levenshtein(na, nb) END AS d, in_a OR in_b OR loc_ = 'match' AS placed, length(CASE WHEN in_a THEN nb ELSE na END) AS size FROM u),
      w AS (SELECT *, (CASE WHEN ta NOT IN ('mr.', 'esq.', '') THEN 1.0 ELSE 0 END) + (CASE first_ WHEN 'exact' THEN 1.0 WHEN 'initial' THEN 0.5 ELSE 0 END) + (CASE WHEN placed THEN 1.0 ELSE 0 END)
        + (CASE WHEN occ_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN aff_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN post_ = 'match' THEN 0.5 ELSE 0 END) AS signals FROM v)
      SELECT row_ord AS a, b_row AS b, concat_ws('+', CASE WHEN d = 0 THEN 'exact_last' ELSE concat('fuzzy_last_', d) END, concat(first_, '_first'), CASE WHEN placed THEN 'loc' END, CASE WHEN occ_ = 'match' THEN 'occ' END,
        CASE WHEN aff_ = 'match' THEN 'aff' END, CASE WHEN post_ = 'match' THEN 'post' END) AS verdict FROM w
      WHERE signals >= 1 AND d <= (CASE WHEN size <= 4 THEN 0 WHEN size <= 7 THEN 1 ELSE 2 END) + CAST(first_ = 'exact' AS INT)""",
    "identity_apply": f"WITH i AS ({_IDS}), n AS ({views.NAMELIST}) SELECT n.row_ord, coalesce(i.person_id, n.person_id) AS person_id FROM n LEFT JOIN i ON i.entry_id = n.entry_id",
    "identity_conflicts": f'SELECT entry_id, "groups" FROM ({_IDS}) i WHERE "groups" > 1',
    "group_order": f"WITH m AS ({views.MATCHES}) SELECT row_ord, group_id, min(row_ord) OVER (PARTITION BY group_id) AS group_ord FROM m",
    "author_filter": N + " SELECT row_ord FROM n WHERE full_author = 'Peter Hollis'",
    "review_view": f"WITH r AS ({views.REVIEWED}) SELECT " + ", ".join(f"rpad(CASE WHEN length({x}) > 7 THEN concat(substr({x}, 1, 6), '…') ELSE {x} END, 7, ' ') AS {y}" for x, y in (("group_id", "group_id"), ("CAST(row_ord AS VARCHAR)", "place"), ("normalized_name", "normalized_name"), ("book", "book"))) + " FROM r",
    "run_counters": N + " SELECT count(*) AS \"rows\", count(*) FILTER (parsed_title <> '') AS titled, count(*) FILTER (parsed_location <> '') AS placed, count(*) FILTER (regexp_matches(trim(no), '^[0-9]+$')) AS numbered FROM n",
    "person_labels": N + """, x AS (SELECT row_ord, array_to_string(list_filter([trim(parsed_title), trim(parsed_first), trim(parsed_last)], lambda p: p <> ''), ' ') AS nm, array_to_string(list_filter([trim(parsed_postnominals), trim(parsed_location)], lambda p: p <> ''), ', ') AS more FROM n)
      SELECT row_ord, CASE WHEN more <> '' THEN concat(nm, ' (', more, ')') ELSE nm END AS label FROM x""",
    "edition_report": f"SELECT dep_pid, arr_pid, score, concat(dep_editions[-1], '→', arr_editions[1]) AS edition_boundary FROM ({SQL['missed_match_scores']}) x ORDER BY score DESC, dep_pid, arr_pid LIMIT 50",
    "pending_review": f"WITH r AS ({views.REVIEWED})" + """, f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY row_ord) AS k FROM r) SELECT group_id, row_ord, match_rule FROM f WHERE k = 1 AND lower(trim("match")) NOT IN ('y', 'n') AND contains(match_rule, 'exact')""",
    "review_actions": f"WITH r AS ({views.REVIEWED})" + """, f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY row_ord) AS k, bool_or(row_ord % 4 = 0) OVER (PARTITION BY group_id) AS acted FROM r)
      SELECT group_id, row_ord, CASE WHEN NOT acted THEN '' WHEN k = 3 THEN 'x' ELSE 'y' END AS "match" FROM f""",
    "ledger_apply": f"WITH RECURSIVE r AS ({views.REVIEWED}), o AS ({views.LEDGER})" + """, h AS (SELECT group_id, arg_min(entry_id, row_ord) AS lead, count(*) AS n FROM r GROUP BY group_id),
      k AS (SELECT a.group_id, a.entry_id AS x, b.entry_id AS y, o.verdict FROM r a JOIN r b ON a.group_id = b.group_id AND a.entry_id < b.entry_id JOIN o ON o.entry_a = a.entry_id AND o.entry_b = b.entry_id),
      s AS (SELECT group_id, lead AS entry FROM h UNION SELECT s.group_id, CASE WHEN k.x = s.entry THEN k.y ELSE k.x END FROM s JOIN k ON k.group_id = s.group_id AND k.verdict = 'y' AND (k.x = s.entry OR k.y = s.entry)),
      e AS (SELECT r.group_id, r.row_ord, r.entry_id, s.entry IS NOT NULL AS tied FROM r LEFT JOIN s ON s.group_id = r.group_id AND s.entry = r.entry_id),
      d AS (SELECT k.group_id, a.tied AND b.tied AS torn, CASE WHEN a.tied AND NOT b.tied THEN k.y WHEN b.tied AND NOT a.tied THEN k.x END AS out_ FROM k JOIN e a ON a.group_id = k.group_id AND a.entry_id = k.x JOIN e b ON b.group_id = k.group_id AND b.entry_id = k.y WHERE k.verdict = 'n'),
      g AS (SELECT h.group_id, h.n, (SELECT count(*) FROM e WHERE e.group_id = h.group_id AND tied) AS inside, (SELECT count(*) FROM d WHERE d.group_id = h.group_id) AS apart,
        (SELECT count(*) FROM d WHERE d.group_id = h.group_id AND torn) AS torn, (SELECT count(DISTINCT out_) FROM d WHERE d.group_id = h.group_id) AS refused FROM h)
      SELECT e.group_id, e.row_ord, CASE WHEN inside = 1 AND n >= 2 AND 2 * apart = n * (n - 1) THEN 'n' WHEN inside > 1 AND torn = 0 AND refused = n - inside THEN CASE WHEN tied THEN 'y' ELSE 'x' END ELSE '' END AS "match"
      FROM e JOIN g ON g.group_id = e.group_id""",
    "ring_shrink": _RING + """, q AS (SELECT place, cos(angle) AS x, sin(angle) AS y, radius FROM ring), t AS (SELECT x, y, radius, coalesce(lead(x) OVER v, first_value(x) OVER v) AS nx, coalesce(lead(y) OVER v, first_value(y) OVER v) AS ny, coalesce(lead(radius) OVER v, first_value(radius) OVER v) AS nr
        FROM q WINDOW v AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT least(1.0::DOUBLE, least(1.0::DOUBLE, min(CASE WHEN radius + nr > 0 THEN sqrt(pow(x - nx, 2) + pow(y - ny, 2)) / ((radius + nr) * 0.002::DOUBLE / 2) END)) * 0.95::DOUBLE) AS factor FROM t""",
    "community_colors": f"WITH {_BOOKS}, x AS (SELECT id, {_list(_FILE_NAMES)}[CASE WHEN id % 13 = 0 THEN 1 ELSE CAST((id % 13 - 1) % 10 AS INT) + 2 END] AS color FROM b)" + """,
      y AS (SELECT id, color, CAST(concat('0x', color[2:3]) AS INT)::DOUBLE / 255 AS r, CAST(concat('0x', color[4:5]) AS INT)::DOUBLE / 255 AS g, CAST(concat('0x', color[6:7]) AS INT)::DOUBLE / 255 AS b FROM x),
      z AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS light FROM y), s AS (SELECT *, CASE WHEN light > 0.45 THEN 0.45::DOUBLE / light ELSE 1.0::DOUBLE END AS f FROM z) SELECT id, color, r * f AS r, g * f AS g, b * f AS b FROM s""",
    "highlights": f"WITH {_BOOKS} SELECT id, contains(lower(author), 'steel') OR contains(lower(book), 'steel') AS hit, FALSE AS none FROM b",
    "chord_curves": """WITH a AS (SELECT p_partkey AS id, cos(p_partkey) AS ax, cos(p_partkey * 2) AS bx, sin(p_partkey) AS ay, sin(p_partkey * 2) AS by_ FROM part),
      c AS (SELECT *, (0.55::DOUBLE - 0.45::DOUBLE * sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)) / 2) / 1.5::DOUBLE AS bow, unnest(range(5)) AS k FROM a), t AS (SELECT *, k / 4.0::DOUBLE AS t FROM c)
      SELECT id, k, (1 - t) * (1 - t) * ax + 2 * (1 - t) * t * (ax + bx) * bow + t * t * bx AS x, (1 - t) * (1 - t) * ay + 2 * (1 - t) * t * (ay + by_) * bow + t * t * by_ AS y FROM t""",
    "list_scan": N + """, x AS (SELECT CAST(1 - row_ord % 2 AS INT) AS file, row_ord, listed_as, full_book AS book, CASE WHEN row_ord % 2 = 0 THEN entry_id ELSE '' END AS own0, CASE WHEN row_ord % 2 = 1 THEN entry_id ELSE '' END AS own1 FROM n)
      SELECT file, row_number() OVER (ORDER BY file, row_ord) - 1 AS row_ord, listed_as, book, own0, own1 FROM x""",
    "skipped_lists": "SELECT 'c.csv' AS name",
    "required_columns": "SELECT unnest(['book,shelf', 'shelf']) AS asked",
    "optional_tables": f"WITH h AS ({views.HOLDERS}) SELECT title_key, person_name, '' AS wikidata_id, start_year, end_year FROM h",
    "lexicons": "SELECT * FROM (VALUES ('word', 'attorney', ''), ('word', 'printer', ''), ('pair', 'Wundham', 'Wyndham'), ('pair', 'New Town', 'Newtown')) t(kind, word, correction)",
    "csv_sink": N + " SELECT entry_id, listed_as, full_book FROM n",
    "csv_replaced": N + " SELECT entry_id, listed_as FROM n WHERE contains(listed_as, 'Birch')",
    "ledger_file": f"WITH l AS ({views.LEDGER}) SELECT entry_a, entry_b, verdict, name_a, name_b, context_a, context_b, note FROM l",
    "candidates_file": N + " SELECT entry_id, book, edition, TRUE AS wrote, FALSE AS none FROM n",
    "graphml_round_trip": S + """, f AS (SELECT * FROM s WHERE book < 'Brand#3'), w AS (SELECT book, arg_min(author, row_ord) AS author, min(CAST(year AS INT)) AS first_year, max(CAST(year AS INT)) AS last_year FROM f GROUP BY book),
      p AS (SELECT person_id, arg_max(concat('<&"> ', normalized_name), row_ord) AS normalized_name FROM f GROUP BY person_id), e AS (SELECT DISTINCT person_id, book FROM f)
      SELECT e.person_id, e.book, author, first_year, last_year, normalized_name FROM e JOIN w ON w.book = e.book JOIN p ON p.person_id = e.person_id""",
    "drawing_shapes": GRAPH + " SELECT (SELECT count(*) FROM z) AS works, (SELECT count(*) FROM g WHERE shared > 0) AS chords, (SELECT count(*) FROM z) AS labels",
}


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_FIRST_MAP = f"MAP({_list(_firsts)}, {_list(_firsts.values())})"
_HE, _SHE = _list(text.MASCULINE), _list(text.FEMININE)


def _spelt_names(c: str) -> str:
    """Abbreviated first names spelt out, as one expression."""
    bare = "list_transform(fw, lambda t: regexp_replace(lower(t), '\\.+$', ''))"
    francis = f"CASE WHEN list_has_any({bare}, {_HE}) AND NOT list_has_any({bare}, {_SHE}) THEN 'Francis' WHEN list_has_any({bare}, {_SHE}) AND NOT list_has_any({bare}, {_HE}) THEN 'Frances' END"
    full = f"array_to_string(list_transform(fw, lambda t: coalesce(CASE WHEN lower(t) IN ('fran.', 'fran') THEN fr END, {_FIRST_MAP}[lower(t)], t)), ' ')"
    return _with(_words(c), "fw", _with(francis, "fr", full))


def _normal(c: str) -> str:
    """The whole normalisation as one expression."""
    c = _squeezed(_chain(f"replace(replace(translate({c}, ',;', '  '), '[?]', ''), ' & ', ' and ')", _SPACING))
    c = _peerage(_chain(_from(_periods, _from(_titles, _spelt(c))), _HONORIFICS))
    c = f"regexp_replace(regexp_replace(regexp_replace({_spelt_names(c)}, '^The\\s+', '', 'i'), '{_COPIES}', '', 'gi'), '\\s+(?:\\d+\\s+)?(?:of\\s+)?(?:ditto|do\\.?)\\s*$', '', 'i')"
    c = f"regexp_replace({_chain(c, [('[-–—]{2,}', '----', 'g'), ('(----)([A-Za-z])', r'\1 \2', 'g'), *_INITIALS])}, ':+$', '')"
    last = "string_split_regex(ny, '\\s+')[-1]"
    short = f"CASE WHEN suffix(ny, '.') AND NOT list_contains({_list(text.ABBREVIATIONS)}, regexp_replace({last}, '\\.+$', '')) AND NOT (length({last}) <= 4 AND regexp_matches({last}, '[A-Za-z]\\.')) THEN substr(ny, 1, length(ny) - 1) ELSE ny END"
    return _squeezed(f"regexp_replace(regexp_replace({_with(c, 'ny', short)}, '\\.\\s*\\.', '.', 'g'), '\\b({'|'.join(text.WHOLE_WORDS)})\\.\\s', '\\1 ', 'gi')")


def _ended(c: str) -> str:
    return f"regexp_replace({c}, '[.,;: ]+$', '')"


def _sql(pattern: str) -> str:
    """A pattern of the parser for the other engine, which has no flag for Unicode classes and quotes signs otherwise."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


_TAIL, _PLACE = _sql(parse.COPY_TAIL), parse._PLACE
_SPELL_MAP = "MAP(['wundham', 'wyndham', 'new town'], ['Wyndham', 'Windham', 'Newtown'])"


def _corrected(c: str) -> str:
    return f"array_to_string(list_transform({_words(c)}, lambda w: coalesce({_SPELL_MAP}[lower(w)], w)), ' ')"


def _location(c: str) -> str:
    """The place that a listed name has after "of" or after a postnominal."""
    word = "regexp_replace(lower(string_split(trim(op[i - 1]), ' ')[-1]), '\\.+$', '')"
    skip = f"trim(op[i - 1]) = '' OR trim(op[i]) = '' OR list_contains({_list(parse.BEFORE_OF)}, {word}) OR starts_with(lower(trim(op[i])), 'the ') OR starts_with(lower(trim(op[i])), 'ditto')"
    after = f"list_filter(list_transform(range(2, len(op) + 1), lambda i: CASE WHEN NOT ({skip}) THEN {_ended(f"trim(regexp_replace(trim(op[i]), '{_TAIL}', ''))")} END), lambda x: x <> '')[1]"
    cut = _ended(f"trim(regexp_replace(sg[k], '{_TAIL}', ''))")
    others_ = f"list_filter(list_transform(sg[k + 1:len(sg)], lambda q: {_ended('q')}), lambda q: q <> '')[1]"
    within = f"regexp_extract({cut}, '{parse._AFTER_POST}', 1)"
    across = f"CASE WHEN regexp_matches({cut}, '(?i)^(?:esq|bart|jun|sen)\\.*$') THEN regexp_extract(coalesce({others_}, ''), '^({_PLACE})$', 1) ELSE '' END"
    fit = lambda x: f"CASE WHEN {x} <> '' AND NOT list_contains({_list(parse.NO_PLACES)}, lower({x})) THEN {x} END"
    post = f"list_filter(list_transform(range(1, len(sg) + 1), lambda k: coalesce({fit(within)}, {fit(across)})), lambda x: x IS NOT NULL)[1]"
    found = _with(f"string_split_regex({_squeezed(f"translate({c}, ',;', '  ')")}, '(?i)\\bof\\b')", "op", after)
    found_post = _with(f"list_transform(string_split_regex({c}, '[,;]'), lambda s: trim(s))", "sg", post)
    return _corrected(f"coalesce({found}, {found_post}, '')")


def _segment(c: str) -> str:
    """{t: type, v: value} of a segment after the name."""
    bare = f"list_transform({_words('sx')}, lambda w: regexp_replace(lower(w), '\\.+$', ''))"
    aff = _sql(parse.AFFILIATION)
    of = lambda t, v="sx": f"{{'t': '{t}', 'v': {v}}}"
    return _with(_ended(f"trim({c})"), "sx", f"""CASE WHEN sx = '' THEN {of("", "''")} WHEN regexp_matches(sx, '(?i)^(?:\\d+\\s+)?(?:ditto|do\\.?)$') THEN {of("ditto", "'ditto'")}
      WHEN regexp_matches(sx, '{_sql(parse.COPY_COUNT)}') THEN {of("note")} WHEN regexp_matches(sx, '{aff}') THEN {of("affiliation", f"regexp_extract(sx, '{aff}', 0)")}
      WHEN len(list_filter({bare}, lambda w: NOT list_contains({_list(parse.NO_PLACES)}, w))) = 0 THEN CASE WHEN list_has_any({bare}, ['esq', 'bart', 'jun', 'sen']) THEN {of("postnominal")} ELSE {of("note")} END
      WHEN len(list_filter({_words("sx")}, lambda w: NOT regexp_matches(w, '^[A-Z]{{1,2}}\\.*$'))) = 0 THEN {of("postnominal")}
      WHEN list_has_any({bare}, ['bookseller', 'printer', 'attorney']) THEN {of("occupation")}
      WHEN len(list_filter({_words("sx")}, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN {of("location", _corrected("sx"))} ELSE {of("note")} END""")


_LEAD = f"^((?:(?:{_any(parse.LEADING_PAIRS)}|{_any(parse.LEADING)})(?:\\s+|$))*)"
_ANYWHERE = f"""{{'post': replace(array_to_string(list_transform(regexp_extract_all(pw, ' (?:{_WIDE_POST}) ', 0, 'i'), lambda p: trim(p)), ' '), '  ', ' '), 'rest': {_squeezed(f"regexp_replace(pw, ' (?:{_WIDE_POST}) ', '', 'gi')")}}}"""


def _anywhere(c: str) -> str:
    return _with(f"concat(' ', replace({_squeezed(c)}, ' ', '  '), ' ')", "pw", _ANYWHERE)


def _without(name: str, place: str) -> str:
    return f"""CASE WHEN {place} = '' OR {name} = '' THEN {name} ELSE {_with(_words(name), "wn", _with(_words(place), "wp", "CASE WHEN lower(array_to_string(wn[greatest(1, len(wn) - len(wp) + 1):len(wn)], ' ')) = lower(array_to_string(wp, ' ')) THEN array_to_string(wn[1:len(wn) - len(wp)], ' ') ELSE array_to_string(wn, ' ') END"))} END"""


def _filled(*values: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} <> '' THEN {v}" for v in values) + " ELSE '' END"


def _typed(column: str, *kinds: str) -> str:
    return f"list_transform(list_filter({column}, lambda s: s.t IN ({', '.join(repr(k) for k in kinds)})), lambda s: s.v)"


_EMBEDDED, _OFFICE, _POSITIONAL = _sql(parse._EMBEDDED), _sql(parse._OFFICE), _sql(parse._POSITIONAL)
_SON = "(?i)the\\s+son\\s+of\\s+(.+?)(?:,|$)"
_NOTES_OF = f"""array_to_string(list_filter([trim(regexp_extract(raw, '{_sql(parse.COPY_COUNT)}', 1)), CASE WHEN regexp_matches(raw, '(?i)\\bditto\\b') THEN 'ditto' ELSE '' END,
  CASE WHEN regexp_matches(raw, '(?i)\\bregiment\\b') THEN regexp_extract(raw, '(?i)(\\d+\\w*\\s+regiment\\b)', 1) ELSE '' END,
  CASE WHEN contains(lower(raw), 'the son of') AND regexp_extract(raw, '{_SON}', 1) <> '' THEN concat('son of ', regexp_replace(trim(regexp_extract(raw, '{_SON}', 1)), '[.,;]+$', '')) ELSE '' END,
  trim(regexp_extract(raw, '(?i)\\bof the (?:Royal Navy|Inner Temple|Middle Temple)\\b', 0))], lambda p: p <> ''), '; ')"""
_SPLIT = """CASE WHEN regexp_extract({0}, '^((?:(?:[A-Z]\\.|----)(?:\\s+|$))+)', 1) <> '' THEN {{'first': trim(regexp_extract({0}, '^((?:(?:[A-Z]\\.|----)(?:\\s+|$))+)', 1)), 'last': substr({0}, length(regexp_extract({0}, '^((?:(?:[A-Z]\\.|----)(?:\\s+|$))+)', 1)) + 1)}}
  WHEN regexp_matches({0}, '\\s') THEN {{'first': regexp_extract({0}, '^(\\S*)', 1), 'last': regexp_extract({0}, '^\\S*\\s+(.*)$', 1)}} ELSE {{'first': '', 'last': {0}}} END"""
_COLUMNS = ("name_type", "title_key", "parsed_title", "parsed_first", "parsed_last", "parsed_postnominals", "parsed_occupation", "parsed_affiliation", "parsed_location", "parsed_notes")


def _row(*values: str) -> str:
    return "{" + ", ".join(f"'{c}': {v}" for c, v in zip(_COLUMNS, values, strict=True)) + "}"


_E = "''"
PARSE = N + f""", p0 AS MATERIALIZED (SELECT row_ord, listed_as AS raw, trim({_normal("listed_as")}) AS nm, row_ord % 4 = 0 AS backwards FROM n),
p1 AS MATERIALIZED (SELECT *, list_filter(list_transform(string_split_regex(raw, '[,;]'), lambda s: trim(s)), lambda s: s <> '') AS segs FROM p0),
p2 AS MATERIALIZED (SELECT *, {_normal("coalesce(segs[1], raw)")} AS core0, {_NOTES_OF} AS notes, {_location("raw")} AS anyplace FROM p1),
p3 AS MATERIALIZED (SELECT *, len(segs) > 1 AND core0 <> '' AS cored FROM p2),
p4 AS MATERIALIZED (SELECT *, CASE WHEN cored THEN core0 ELSE nm END AS core, CASE WHEN cored THEN segs[1] ELSE raw END AS coreraw, CASE WHEN cored THEN segs[2:len(segs)] ELSE [] END AS tail_ FROM p3),
p5 AS MATERIALIZED (SELECT *, trim(regexp_extract(core, '{_LEAD}', 1, 'i')) AS fl_title, substr(core, length(regexp_extract(core, '{_LEAD}', 1, 'i')) + 1) AS fl_rest FROM p4),
p6 AS MATERIALIZED (SELECT *, regexp_replace(fl_rest, '^the\\s+', '', 'i') AS rest, {_location("coreraw")} AS place_a, {_location("core")} AS place_b FROM p5),
p7 AS MATERIALIZED (SELECT *, regexp_matches(rest, '{_POSITIONAL}') OR regexp_matches(rest, '{parse._BARE_LORD}') OR list_contains({_list(parse.TRIGGERS)}, regexp_replace(lower(coalesce({_words("rest")}[1], '')), '\\.+$', '')) AS ranked, {_filled("place_a", "place_b")} AS place FROM p6),
p8 AS MATERIALIZED (SELECT *, array_to_string(list_filter({_words(_without("fl_rest", "place"))}, lambda t: lower(t) <> 'of'), ' ') AS bare FROM p7),
p9 AS MATERIALIZED (SELECT *, regexp_extract(bare, '((?:(?:^|\\s+)(?:{_POST}))+)$', 1, 'i') AS tp FROM p8),
pa AS MATERIALIZED (SELECT *, CASE WHEN trim(tp) <> '' THEN {{'post': trim(tp), 'rest': trim(substr(bare, 1, length(bare) - length(tp)))}} ELSE {_anywhere("trim(substr(bare, 1, length(bare) - length(tp)))")} END AS e FROM p9),
pb AS MATERIALIZED (SELECT *, regexp_extract(e.rest, '{_EMBEDDED}', 0) AS emb, regexp_extract(e.rest, '{_OFFICE}', 0) AS off_ FROM pa),
pc AS MATERIALIZED (SELECT *, {_filled("emb", "off_")} AS office, CASE WHEN emb <> '' THEN regexp_replace(e.rest, '{_EMBEDDED}', '') ELSE regexp_extract(e.rest, '(?i)^(.*?){_OFFICE[4:]}', 1) END AS before FROM pb),
pd AS MATERIALIZED (SELECT *, CASE WHEN office <> '' THEN trim(before) ELSE e.rest END AS own FROM pc),
pe AS MATERIALIZED (SELECT *, {_SPLIT.format("own")} AS nms, list_transform(tail_, lambda s: {_segment("s")}) AS typed FROM pd),
pf AS MATERIALIZED (SELECT *, CASE WHEN ranked THEN {_row("'titled'", "lower(rest)", "concat_ws(' ', CASE WHEN fl_title <> '' THEN fl_title END, rest)", _E, _E, _E, _E, _E, _E, "notes")}
  ELSE {_row("CASE WHEN fl_title <> '' THEN 'personal' ELSE 'bare' END", _E, "fl_title", "nms.first", "nms.last", _filled("e.post", f"array_to_string({_typed('typed', 'postnominal')}, ' ')"),
    f"coalesce({_typed('typed', 'occupation')}[1], '')", f"coalesce({_typed('typed', 'affiliation')}[1], '')", _filled("place", f"array_to_string({_typed('typed', 'location', 'ditto')}, ', ')", "anyplace"),
    "array_to_string(list_filter([office, notes], lambda x: x <> ''), '; ')")} END AS fl FROM pe),
pg AS MATERIALIZED (SELECT *, coalesce({_words("core0")}[1], '') AS sur FROM pf),
ph AS MATERIALIZED (SELECT *, substr(core0, length(sur) + 2) AS lrest FROM pg),
pi_ AS MATERIALIZED (SELECT *, trim(regexp_extract(lrest, '{_LEAD}', 1, 'i')) AS lf_title, substr(lrest, length(regexp_extract(lrest, '{_LEAD}', 1, 'i')) + 1) AS lf_rest FROM ph),
pj AS MATERIALIZED (SELECT *, trim(substr(lf_rest, 1, length(lf_rest) - length(regexp_extract(lf_rest, '((?:(?:^|\\s+)(?:{_POST}))+)$', 1, 'i')))) AS given FROM pi_),
pk AS MATERIALIZED (SELECT *, lf_title = '' AND given = '' AND len({_words("core0")}) = 1 AND len(segs) > 1 AS alone, {_normal("coalesce(segs[2], '')")} AS nx FROM pj),
pl AS MATERIALIZED (SELECT *, trim(regexp_extract(nx, '{_LEAD}', 1, 'i')) AS nx_title, substr(nx, length(regexp_extract(nx, '{_LEAD}', 1, 'i')) + 1) AS nx_rest FROM pk),
pm AS MATERIALIZED (SELECT *, {_words("nx_rest")} AS nw FROM pl),
pn AS MATERIALIZED (SELECT *, coalesce(list_filter(range(0, len(nw)), lambda i: list_contains(['esq', 'bart', 'jun', 'sen', 'bookseller', 'printer', 'attorney'], regexp_replace(lower(nw[i + 1]), '\\.+$', '')))[1], len(nw)) AS stop FROM pm),
po AS MATERIALIZED (SELECT *, array_to_string(nw[1:stop], ' ') AS go_given, array_to_string(nw[stop + 1:len(nw)], ' ') AS go_left, regexp_extract(coalesce(segs[3], ''), '^((?:[A-Z]\\.(?:\\s+|$))+)', 1) AS peeled, regexp_extract(nx_rest, '^((?:[A-Z]\\.(?:\\s+|$))+)', 1) AS ini FROM pn),
pq AS MATERIALIZED (SELECT *, go_left = '' AND go_given = '' AND peeled <> '' AS only_title, substr(coalesce(segs[3], ''), length(peeled) + 1) AS third FROM po),
pr AS MATERIALIZED (SELECT *, CASE WHEN alone AND nx_title <> '' THEN {{'title': nx_title, 'given': CASE WHEN only_title THEN trim(peeled) ELSE go_given END,
    'tail': CASE WHEN only_title THEN list_concat(CASE WHEN third <> '' THEN [third] ELSE [] END, segs[4:len(segs)]) ELSE list_concat(CASE WHEN go_left <> '' THEN [go_left] ELSE [] END, segs[3:len(segs)]) END}}
  WHEN alone AND ini <> '' THEN {{'title': '', 'given': trim(ini), 'tail': list_concat(CASE WHEN substr(nx_rest, length(ini) + 1) <> '' THEN [substr(nx_rest, length(ini) + 1)] ELSE [] END, segs[3:len(segs)])}}
  ELSE {{'title': lf_title, 'given': given, 'tail': segs[2:len(segs)]}} END AS lst FROM pq),
ps AS MATERIALIZED (SELECT *, list_transform(lst.tail, lambda s: {_segment("s")}) AS lt, regexp_extract(raw, '{_SON}', 1) AS son FROM pr),
pt AS MATERIALIZED (SELECT *, CASE WHEN core0 = '' THEN fl ELSE {_row("CASE WHEN lst.title <> '' THEN 'personal' ELSE 'bare' END", _E, "lst.title", "lst.given", "sur", f"{_anywhere('nm')}.post", f"coalesce({_typed('lt', 'occupation')}[1], '')",
    f"coalesce({_typed('lt', 'affiliation')}[1], '')", _filled(f"array_to_string({_typed('lt', 'location', 'ditto')}, ', ')", "anyplace"),
    f"array_to_string(list_concat({_typed('lt', 'note')}, CASE WHEN son <> '' THEN [concat('son of ', regexp_replace(trim(son), '[.,;]+$', ''))] ELSE [] END), '; ')")} END AS lf FROM ps),
pu AS MATERIALIZED (SELECT row_ord, CASE WHEN nm = '' THEN {_row("'bare'", *[_E] * 9)} WHEN regexp_matches(nm, '(?i)^a\\s+(?:young\\s+)?(?:gentleman|lady)$') THEN {_row("'anonymous'", *[_E] * 8, "notes")}
  WHEN regexp_matches(nm, '{_POSITIONAL}') THEN {_row("'titled'", f"lower(concat_ws(' of ', regexp_extract(nm, '{_POSITIONAL}', 1), regexp_extract(nm, '{_POSITIONAL}', 2)))", f"concat_ws(' of ', regexp_extract(nm, '{_POSITIONAL}', 1), regexp_extract(nm, '{_POSITIONAL}', 2))", *[_E] * 6, "notes")}
  WHEN regexp_matches(nm, '{parse._BARE_LORD}') THEN {_row("'titled'", f"lower(concat_ws(' ', regexp_extract(nm, '{parse._BARE_LORD}', 1), regexp_extract(nm, '{parse._BARE_LORD}', 2)))", f"concat_ws(' ', regexp_extract(nm, '{parse._BARE_LORD}', 1), regexp_extract(nm, '{parse._BARE_LORD}', 2))", *[_E] * 6, "notes")}
  WHEN backwards THEN lf ELSE fl END AS r FROM pt)"""

SQL |= {
    "location_extract": N + f" SELECT row_ord, {_location('listed_as')} AS location FROM n",
    "parse_full": PARSE + " SELECT row_ord, " + ", ".join(f"r.{c}" for c in _COLUMNS) + " FROM pu",
    "name_type_tally": PARSE + " SELECT r.name_type, count(*) AS names FROM pu GROUP BY 1",
}

_LONE = "regexp_matches(trim(replace(trim({0}), '.', ' ')), '^\\S(?:\\s+\\S)+$')"
_BLOCK = f"CASE WHEN trim(parsed_last) <> '' THEN lower(trim(parsed_last)) WHEN {_LONE.format('parsed_first')} THEN concat('!', lower(trim(parsed_first))) END"
_NEAR_LASTS = f"""lasts AS (SELECT DISTINCT lower(trim(parsed_last)) AS s, regexp_replace(lower(trim(parsed_last)), '{_PREFIX}', '') AS p FROM n WHERE trim(parsed_last) <> ''),
near AS (SELECT x.s AS a, y.s AS b, CAST(least(levenshtein(x.s, y.s), levenshtein(x.p, y.p)) AS INT) AS distance FROM lasts x JOIN lasts y ON x.s < y.s AND least(levenshtein(x.s, y.s), levenshtein(x.p, y.p)) <= 3)"""
_MET = PAIRS.replace(
    "ON a.parsed_last = b.parsed_last AND a.book = b.book AND a.row_ord < b.row_ord WHERE a.parsed_last <> ''",
    f"""ON a.book = b.book AND a.row_ord <> b.row_ord WHERE (a.parsed_last <> '' AND b.parsed_last <> '' AND least(levenshtein(lower(a.parsed_last), lower(b.parsed_last)),
      levenshtein(regexp_replace(lower(a.parsed_last), '{_PREFIX}', ''), regexp_replace(lower(b.parsed_last), '{_PREFIX}', ''))) <= 3)
    OR (a.parsed_last = '' AND b.parsed_last = '' AND {_LONE.format("a.parsed_first")} AND lower(trim(a.parsed_first)) = lower(trim(b.parsed_first)))""",
)
_WITHIN = _MET + f""", k AS (SELECT *, regexp_replace(lower(trim(parsed_last)), '{_PREFIX}', '') AS na, regexp_replace(lower(trim(b_last)), '{_PREFIX}', '') AS nb,
    ta = tb AS same, ta = tb OR (ta IN ('mr.', 'esq.', '') AND tb IN ('mr.', 'esq.', '')) AS alike, ta NOT IN ('mr.', 'esq.', '') AS distinct_ FROM r
    WHERE edition <> b_edition AND titles_ok AND first_ <> 'conflict' AND loc_ <> 'conflict' AND occ_ <> 'conflict' AND aff_ <> 'conflict'),
  u AS (SELECT *, na <> nb AND lb <> '' AND la = '' AND na = concat(nb, ' ', lb) AS in_a, na <> nb AND la <> '' AND lb = '' AND nb = concat(na, ' ', la) AS in_b FROM k),
  v AS (SELECT *, CASE WHEN in_a OR in_b THEN 0 ELSE levenshtein(na, nb) END AS d, in_a OR in_b OR loc_ = 'match' AS placed, length(CASE WHEN in_a THEN nb ELSE na END) AS size FROM u),
  w AS (SELECT *, (CASE WHEN distinct_ THEN 1.0 ELSE 0 END) + (CASE first_ WHEN 'exact' THEN 1.0 WHEN 'initial' THEN 0.5 ELSE 0 END) + (CASE WHEN placed THEN 1.0 ELSE 0 END)
    + (CASE WHEN occ_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN aff_ = 'match' THEN 1.0 ELSE 0 END) + (CASE WHEN post_ = 'match' THEN 0.5 ELSE 0 END) AS signals FROM v),
  x AS (SELECT row_ord AS a, b_row AS b, first_, CASE WHEN parsed_last = '' THEN 'multi_initials'
    WHEN d = 0 AND ((first_ IN ('exact', 'initial') AND alike) OR (first_ = 'missing' AND same)) THEN concat_ws('+', 'exact_last', concat(first_, '_first'), CASE WHEN placed THEN 'loc' END, CASE WHEN post_ = 'match' THEN 'post' END)
    WHEN d = 0 AND first_ = 'fuzzy' AND alike THEN concat_ws('+', 'exact_last', 'fuzzy_first', CASE WHEN distinct_ THEN 'title' END, CASE WHEN placed THEN 'loc' END, CASE WHEN post_ = 'match' THEN 'post' END)
    WHEN signals >= 1 AND d <= (CASE WHEN size <= 4 THEN 0 WHEN size <= 7 THEN 1 ELSE 2 END) + CAST(first_ = 'exact' AS INT)
    THEN concat_ws('+', CASE WHEN d = 0 THEN 'exact_last' ELSE concat('fuzzy_last_', d) END, concat(first_, '_first'), CASE WHEN placed THEN 'loc' END, CASE WHEN occ_ = 'match' THEN 'occ' END, CASE WHEN aff_ = 'match' THEN 'aff' END, CASE WHEN post_ = 'match' THEN 'post' END) END AS rule FROM w),
  rules AS MATERIALIZED (SELECT * FROM x WHERE rule IS NOT NULL)"""
_CLUSTERS = _WITHIN.replace("WITH n", "WITH RECURSIVE n", 1) + f""", e AS MATERIALIZED (SELECT row_ord, book, edition, block, concat_ws('/', st, sf, sl, sp) AS sig, st, sf, sl, sp, row_number() OVER (PARTITION BY book, block ORDER BY row_ord) AS i, min(row_ord) OVER (PARTITION BY book, block) AS first_row
    FROM (SELECT *, {_BLOCK} AS block, {_PLAIN_TITLE} AS st, lower(trim(parsed_first)) AS sf, lower(trim(parsed_last)) AS sl, lower(trim(parsed_postnominals)) AS sp FROM n) WHERE block IS NOT NULL),
  apart AS (SELECT a.book, a.block, list(DISTINCT concat(a.sig, '#', b.sig)) AS signs FROM e a JOIN e b ON a.book = b.book AND a.block = b.block AND a.edition = b.edition AND a.st = b.st AND a.sl = b.sl AND a.sl <> ''
    WHERE a.sig <> b.sig AND ((a.sf = '') <> (b.sf = '') OR a.sp <> b.sp) GROUP BY ALL),
  seen AS MATERIALIZED (SELECT e.*, coalesce(m.met, []) AS met, coalesce(apart.signs, []) AS apart FROM e LEFT JOIN (SELECT b, list({{'seed': a, 'rule': rule}}) AS met FROM rules GROUP BY b) m ON m.b = e.row_ord LEFT JOIN apart ON apart.book = e.book AND apart.block = e.block),
  rec AS (SELECT book, block, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(seed BIGINT, rule VARCHAR, members BIGINT[], signs VARCHAR[])[]) AS cs FROM (SELECT DISTINCT book, block FROM e)
    UNION ALL SELECT book, block, i + 1, CASE WHEN pick IS NULL THEN list_append(cs, {{'seed': row_ord, 'rule': CAST(NULL AS VARCHAR), 'members': [row_ord], 'signs': [sig]}})
      ELSE list_transform(cs, lambda c: CASE WHEN c.seed = pick.seed THEN {{'seed': c.seed, 'rule': coalesce(c.rule, list_filter(met, lambda x: x.seed = c.seed)[1].rule), 'members': list_append(c.members, row_ord), 'signs': list_append(c.signs, sig)}} ELSE c END) END
    FROM (SELECT r.book, r.block, r.i, r.cs, s.row_ord, s.sig, s.met, list_filter(r.cs, lambda c: len(list_filter(s.met, lambda x: x.seed = c.seed)) > 0 AND len(list_filter(c.signs, lambda g: list_contains(s.apart, concat(g, '#', s.sig)))) = 0)[1] AS pick
      FROM rec r JOIN seen s ON s.book = r.book AND s.block = r.block AND s.i = r.i + 1)),
  final AS MATERIALIZED (SELECT book, block, unnest(cs) AS c FROM (SELECT book, block, arg_max(cs, i) AS cs FROM rec GROUP BY book, block)),
  found AS MATERIALIZED (SELECT book, block, c.seed AS seed, c.rule AS rule, c.members AS members FROM final WHERE len(c.members) > 1)"""

SQL |= {
    "match_entries": N + f""", t AS (SELECT row_ord, min(row_ord) OVER (PARTITION BY book) AS book_ord, {_BLOCK} AS block, trim(parsed_last) = '' AND {_LONE.format("parsed_first")} AS initials FROM n WHERE parsed_title <> 'Sir') SELECT row_ord, block, initials, book_ord FROM t""",
    "last_name_pairs": N + f", {_NEAR_LASTS} SELECT a, b, distance FROM near",
    "match_pairs_within": _WITHIN + " SELECT a, b, rule, first_ AS said FROM rules",
    "exact_clusters": _CLUSTERS + " SELECT seed, CAST(generate_subscripts(members, 1) - 1 AS BIGINT) AS seq, unnest(members) AS row_ord, rule FROM found",
    "single_links": _CLUSTERS + f""", {_NEAR_LASTS}, seeds AS (SELECT f.seed, f.block, e.first_row FROM found f JOIN e ON e.row_ord = f.seed
      WHERE f.block[1] <> '!' AND NOT (contains(f.rule, 'fuzzy_first') AND NOT (contains(f.rule, '+title') OR contains(f.rule, '+loc') OR contains(f.rule, '+post')))),
    alone AS (SELECT row_ord, block FROM e WHERE block[1] <> '!' AND row_ord NOT IN (SELECT unnest(members) FROM found)),
    hits AS (SELECT l.row_ord, s.seed, s.first_row, r.rule, r.first_, d.distance FROM alone l JOIN rules r ON r.a = l.row_ord JOIN seeds s ON s.seed = r.b JOIN near d ON d.a = least(l.block, s.block) AND d.b = greatest(l.block, s.block)),
    best AS (SELECT *, row_number() OVER (PARTITION BY row_ord ORDER BY first_row, seed) AS k FROM hits)
    SELECT row_ord, seed, concat('fuzzy_last_', distance, '+', regexp_replace(rule, '^[^+]*\\+', '')) AS rule, distance <= 2 AND first_ = 'exact' AS sure FROM best WHERE k = 1""",
}
