"""Queries over the views, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import compat, present, text
from rollcall.operators import clusters, editions, graph, identity, ingest, ledger, order, parse, titles
from rollcall.operators.fuzzy import fuzzy_self_join
from rollcall.plans import views
from rollcall.plans.sql import SQL
from rollcall.sources.shared import saved
from rollcall.sources.sinks import counters
from rollcall.sources.tables import filter_author, with_group_order

#: Small lexicons for the queries.
SPELLING = {"Wundham": "Wyndham", "Wyndham": "Windham", "New Town": "Newtown"}
GIVEN = ["john", "mary", "thomas", "william", "ann", "joseph", "james"]
TRADES = ["bookseller", "printer", "attorney"]

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def names(spark, sf_dir) -> DataFrame:
    return views.view(spark, sf_dir, views.NAMELIST)


def subscriptions(spark, sf_dir) -> DataFrame:
    return views.view(spark, sf_dir, views.SUBSCRIPTIONS)


def c(name: str):
    return F.col(name)


def lists(spark, sf_dir) -> DataFrame:
    """The list view under the names that ingest reads."""
    at = names(spark, sf_dir).select((c("row_ord") % 4).cast("int").alias("file"), "row_ord", c("no").alias("no."), c("listed_as").alias("listed as"),
                                     c("full_book").alias("book"), c("full_author").alias("author"), "edition", "year")
    return at.withColumn("refined listing", F.when(c("row_ord") % 3 == 0, F.concat(F.lit("R "), c("listed as"))).otherwise(" "))


@query
def entry_id(spark, sf_dir):
    at = lists(spark, sf_dir).where("trim(book) <> '' and trim(author) <> ''")
    return at.select("row_ord", ingest.entry_id(c("author"), c("book"), c("edition"), c("row_ord")).alias("entry_id"))


@query
def auto_number(spark, sf_dir):
    return ingest.number_rows(lists(spark, sf_dir)).select("row_ord", c("number").cast("long").alias("number"))


@query
def blank_filter(spark, sf_dir):
    return ingest.drop_blank(lists(spark, sf_dir)).select("row_ord", "author", "book")


@query
def dup_key_check(spark, sf_dir):
    at = lists(spark, sf_dir).select("file", F.concat_ws("-", c("edition"), F.col("`no.`")).alias("entry_id"))
    return ingest.duplicate_ids(at)


@query
def refined_coalesce(spark, sf_dir):
    at = lists(spark, sf_dir)
    return at.select("row_ord", ingest.refined(at).alias("normalization_input"))


@query
def extra_union(spark, sf_dir):
    at = lists(spark, sf_dir)
    left = at.where("row_ord % 2 = 0").select("row_ord", "book")
    return left.unionByName(at.where("row_ord % 2 = 1").select("row_ord", "year"), allowMissingColumns=True).na.fill("")


@query
def compound_split(spark, sf_dir):
    at = names(spark, sf_dir).select("entry_id", c("entry_id").alias("person_id"), c("listed_as").alias("normalization input"))
    return ingest.split_compounds(at).select("entry_id", "source_entry_id", "person_id", c("normalization input").alias("name"))


def _text(spark, sf_dir, new) -> DataFrame:
    return names(spark, sf_dir).select("row_ord", new.alias("name"))


@query
def norm_punct(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_punctuation(c("listed_as")))


@query
def norm_spelling(spark, sf_dir):
    return _text(spark, sf_dir, text.replace_words(c("listed_as"), SPELLING))


@query
def norm_titles(spark, sf_dir):
    return _text(spark, sf_dir, text.replace_words(c("listed_as"), text.TITLE_ABBREVIATIONS))


@query
def norm_periods(spark, sf_dir):
    return _text(spark, sf_dir, text.abbreviation_periods(c("listed_as")))


@query
def norm_honorifics(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_honorifics(c("listed_as")))


@query
def norm_first_names(spark, sf_dir):
    return _text(spark, sf_dir, text.expand_first_names(c("listed_as")))


@query
def norm_annotations(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_annotations(c("listed_as")))


@query
def norm_ditto(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_ditto(c("listed_as")))


@query
def norm_dashes(spark, sf_dir):
    return _text(spark, sf_dir, text.normalize_dashes(c("listed_as")))


@query
def norm_trailing(spark, sf_dir):
    return _text(spark, sf_dir, text.clean_periods(text.strip_trailing(c("listed_as"))))


@query
def norm_spacing(spark, sf_dir):
    return _text(spark, sf_dir, text.repair_spacing(c("listed_as")))


@query
def norm_squeeze(spark, sf_dir):
    return _text(spark, sf_dir, text.squeeze(F.concat(F.lit("  "), F.translate("listed_as", ",", "\t"))))


@query
def norm_the(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_leading_the(c("listed_as")))


@query
def norm_geographic_of(spark, sf_dir):
    return _text(spark, sf_dir, text.strip_geographic_of(F.concat(c("listed_as"), F.lit(" of Kent and Duke of York"))))


@query
def norm_changed(spark, sf_dir):
    return names(spark, sf_dir).agg(*[text.changed(c("listed_as"), step(c("listed_as"))).alias(n) for n, step in (("punct", text.strip_punctuation), ("ditto", text.strip_ditto), ("dashes", text.normalize_dashes))])


@query
def norm_peerage_of(spark, sf_dir):
    return _text(spark, sf_dir, text.insert_peerage_of(c("listed_as")))


@query
def norm_initials(spark, sf_dir):
    return _text(spark, sf_dir, text.standardize_initials(c("listed_as")))


@query
def norm_full(spark, sf_dir):
    return _text(spark, sf_dir, text.normalize_name(c("listed_as"), SPELLING))


@query
def order_votes(spark, sf_dir):
    return order.entry_votes(names(spark, sf_dir), GIVEN).select("row_ord", "vote", "lead", "trail")


@query
def order_sorted_fraction(spark, sf_dir):
    return order.sorted_fractions(order.entry_votes(names(spark, sf_dir), GIVEN))


@query
def order_detect(spark, sf_dir):
    return order.detect_orders(names(spark, sf_dir), GIVEN)


@query
def order_overrides(spark, sf_dir):
    rows = names(spark, sf_dir)
    keys = rows.select(order.list_key().alias("list_key"), "edition").distinct()
    said = keys.select(F.concat(F.lit(" "), c("list_key")).alias("list_key"), F.when(c("edition") == "1", " Last-First").when(c("edition") == "2", "first-last").otherwise("sideways").alias("order"))
    return order.detect_orders(rows, GIVEN, said).select("list_key", "order", "confidence", "source")


@query
def order_joined(spark, sf_dir):
    rows = names(spark, sf_dir)
    return order.with_order(rows, order.detect_orders(rows, GIVEN)).select("row_ord", "name_order")


@query
def trailing_postnominals(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", F.trim(F.concat_ws(" ", "parsed_last", "parsed_postnominals", F.when(c("row_ord") % 3 == 0, "Jun."))).alias("name"))
    return at.select("row_ord", parse.trailing_postnominals(c("name")).alias("x")).select("row_ord", "x.post", "x.rest")


@query
def postnominals_anywhere(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", F.trim(F.concat_ws(" ", "parsed_postnominals", "parsed_last", F.when(c("row_ord") % 3 == 0, "bart. M. P. x"))).alias("name"))
    return at.select("row_ord", parse.postnominals_anywhere(c("name")).alias("x")).select("row_ord", "x.post", "x.rest")


@query
def location_removed(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", "parsed_location", F.trim(F.concat_ws(" ", "parsed_first", "parsed_last", F.when(c("row_ord") % 2 == 0, c("parsed_location")))).alias("name"))
    return at.select("row_ord", parse.without_location(c("name"), c("parsed_location")).alias("name"))


@query
def words_corrected(spark, sf_dir):
    return _text(spark, sf_dir, parse.correct_words(c("listed_as"), {"birch": "Beech", "Green": "Greene"}))


@query
def leading_titles(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", parse.leading_titles(c("normalized_name")).alias("x")).select("row_ord", "x.title", "x.rest")


@query
def split_first_last(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", F.trim(F.concat_ws(" ", "parsed_first", "parsed_last")).alias("name"))
    return at.select("row_ord", parse.split_personal_name(c("name")).alias("x")).select("row_ord", c("x.first").alias("first_name"), c("x.last").alias("last_name"))


@query
def residual_types(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", F.posexplode(F.split("listed_as", "[,;]")).alias("k", "seg"))
    at = at.select("row_ord", c("k").cast("long").alias("k"), parse.classify_segment(c("seg"), TRADES, {}).alias("x"))
    return at.select("row_ord", "k", c("x.type").alias("kind"), c("x.value").alias("said"))


@query
def notes_extract(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", parse.notes_of(c("listed_as")).alias("notes"))


@query
def location_extract(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", parse.location_of(c("listed_as"), SPELLING).alias("location"))


@query
def parse_full(spark, sf_dir):
    at = names(spark, sf_dir).select("row_ord", c("listed_as").alias("normalization input"), text.normalize_name(c("listed_as"), SPELLING).alias("normalized_name"),
                                     F.when(c("row_ord") % 4 == 0, "last-first").otherwise("first-last").alias("name_order"))
    return parse.parse_names(at, TRADES, SPELLING).select("row_ord", *parse.PARSED)


@query
def name_type_tally(spark, sf_dir):
    return parse.name_types(parse_full(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    """Pairs of rows of one last name and book, the earlier first."""
    at = names(spark, sf_dir).where("parsed_last <> ''")
    a, b = (at.select(*[c(x).alias(f"{side}_{x}") for x in at.columns]) for side in "ab")
    return a.join(b, (c("a_parsed_last") == c("b_parsed_last")) & (c("a_book") == c("b_book")) & (c("a_row_ord") < c("b_row_ord")))


def _side(s: str):
    return lambda name: F.col(f"{s}_{name}")


def _compat(spark, sf_dir, value) -> DataFrame:
    return _pairs(spark, sf_dir).select(c("a_row_ord").alias("a"), c("b_row_ord").alias("b"), value.alias("verdict"))


@query
def compat_titles(spark, sf_dir):
    a, b = (compat.effective_title(c(f"{s}_parsed_title"), c(f"{s}_parsed_postnominals")) for s in "ab")
    return _compat(spark, sf_dir, compat.titles_compatible(a, b))


@query
def compat_first(spark, sf_dir):
    return _compat(spark, sf_dir, compat.first_names(c("a_parsed_first"), c("b_parsed_first")))


@query
def compat_location(spark, sf_dir):
    return _compat(spark, sf_dir, compat.locations(c("a_parsed_location"), c("b_parsed_location")))


@query
def compat_postnominals(spark, sf_dir):
    return _compat(spark, sf_dir, compat.postnominals(c("a_parsed_postnominals"), c("b_parsed_postnominals")))


@query
def compat_occupation(spark, sf_dir):
    return _compat(spark, sf_dir, compat.occupations(c("a_parsed_occupation"), c("b_parsed_occupation")))


@query
def compat_affiliation(spark, sf_dir):
    return _compat(spark, sf_dir, compat.affiliations(c("a_parsed_affiliation"), c("b_parsed_affiliation")))


@query
def surname_prefixes(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", compat.strip_surname_prefix(F.lower("parsed_last")).alias("bare"))


@query
def initials_only(spark, sf_dir):
    first = c("parsed_first")
    return names(spark, sf_dir).select("row_ord", compat.is_bare_initial(first).alias("one"), compat.is_multi_initial(F.trim(first), 2).alias("two"), compat.is_multi_initial(F.trim(first), 3).alias("three"))


@query
def signatures(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", compat.signature(c).alias("s")).select("row_ord", "s.title", "s.first", "s.last", "s.post")


@query
def match_pairs_cross(spark, sf_dir):
    """Pairs whose last names begin with the same two letters, the earlier row first."""
    none = spark.createDataFrame([], "entry_id string")
    at = clusters.eligible_entries(names(spark, sf_dir).where("parsed_last <> ''"), none).where("block is not null")
    at = saved(at.withColumn("start", F.substring("parsed_last", 1, 2)).select("row_ord", "book", "edition", "block", "last", "start", *compat.PREPARED), "cross-entries")
    near = clusters.name_pairs(at).select("a", "b").union(clusters.absorbing_pairs(at)).distinct()
    found = clusters.matching_pairs(at, saved(near, "cross-names"), "cross_book", once=F.expr("a_row_ord < b_row_ord and a_start = b_start"), more=["start"])
    return found.select("a", "b", c("rule").alias("verdict"))


@query
def allowed_distance(spark, sf_dir):
    return _compat(spark, sf_dir, compat.allowed_distance(c("a_parsed_last"), compat.first_names(c("a_parsed_first"), c("b_parsed_first"))))


@query
def match_pairs(spark, sf_dir):
    rule = compat.entries_match(_side("a"), _side("b"), "within_book")
    return _compat(spark, sf_dir, rule).where("verdict is not null")


@query
def fuzzy_last_pairs(spark, sf_dir):
    return fuzzy_self_join(names(spark, sf_dir).select(F.lower("parsed_last").alias("last")).where("last <> ''"), "last", 3)


@query
def coexistence_pairs(spark, sf_dir):
    return clusters.coexistence_pairs(names(spark, sf_dir))


@query
def cross_eligible_strict(spark, sf_dir):
    return names(spark, sf_dir).where(compat.cross_eligible(F.col, relaxed=False)).select("row_ord")


@query
def cross_eligible_relaxed(spark, sf_dir):
    return names(spark, sf_dir).where(compat.cross_eligible(F.col, relaxed=True)).select("row_ord")


def _titles(spark, sf_dir) -> DataFrame:
    holders = views.view(spark, sf_dir, views.HOLDERS)
    return titles.match_titles(views.view(spark, sf_dir, views.TITLED), holders)


@query
def title_groups(spark, sf_dir):
    return _titles(spark, sf_dir).select("row_ord", "group_id", "match", "title_holder", "match_tier")


@query
def title_collisions(spark, sf_dir):
    at = views.view(spark, sf_dir, views.TITLED).groupBy("title_key")
    at = at.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("book", "edition").alias("places"))
    return at.where("entries >= 2").select("title_key", "entries", (c("entries") != c("places")).alias("collides"))


@query
def title_holder_range(spark, sf_dir):
    at = titles.holders_in_year(views.view(spark, sf_dir, views.TITLED), views.view(spark, sf_dir, views.HOLDERS))
    return at.where("holder is not null").select("row_ord", "title_key", "holder")


def _matches(spark, sf_dir, across: bool = True) -> DataFrame:
    none = spark.createDataFrame([], "entry_id string")
    return clusters.match_components(names(spark, sf_dir), none, across=across)


def _entries(spark, sf_dir):
    """Entries, and near last names, as the match operators take them."""
    none = spark.createDataFrame([], "entry_id string")
    at = clusters.eligible_entries(names(spark, sf_dir), none).where("block is not null")
    at = saved(at.withColumn("first_row", F.min("row_ord").over(Window.partitionBy("book", "block"))), "entries")
    return at, saved(clusters.name_pairs(at), "entry-names")


@query
def match_entries(spark, sf_dir):
    none = names(spark, sf_dir).where("parsed_title = 'Sir'").select("entry_id")  # as if a title run had matched them
    at = clusters.eligible_entries(names(spark, sf_dir), none)
    return at.select("row_ord", F.translate("block", "\u0001", "!").alias("block"), "initials", "book_ord")


@query
def last_name_pairs(spark, sf_dir):
    return clusters.name_pairs(clusters.eligible_entries(names(spark, sf_dir), spark.createDataFrame([], "entry_id string")))


@query
def match_pairs_within(spark, sf_dir):
    at, near = _entries(spark, sf_dir)
    return clusters.matching_pairs(at, near, "within_book").select("a", "b", "rule", c("first").alias("said"))


@query
def exact_clusters(spark, sf_dir):
    at, _ = _entries(spark, sf_dir)
    return clusters.exact_clusters(at, ["book_ord"]).select("seed", "seq", "row_ord", "rule")


@query
def single_links(spark, sf_dir):
    at, near = _entries(spark, sf_dir)
    found = saved(clusters.exact_clusters(at, ["book_ord"]), "entry-clusters")
    seeds = found.where("seq = 0 and not (rule like '%fuzzy_first%' and rule not like '%+title%' and rule not like '%+loc%' and rule not like '%+post%')")
    seeds = seeds.join(at.select("row_ord", "initials", "first_row"), "row_ord").where("not initials").select("seed", "block", "first_row")
    return clusters.single_links(at, found, seeds, near)


@query
def component_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("group_id", "match", "row_ord", "match_rule", "match_tier")


@query
def cluster_within(spark, sf_dir):
    return _matches(spark, sf_dir, across=False).where("match_tier in ('auto_within', 'candidate_within')").select("group_id", "row_ord", "match_rule")


@query
def singleton_linkage(spark, sf_dir):
    return _matches(spark, sf_dir, across=False).where("match_tier like '%linkage'").select("group_id", "row_ord", "match_rule", "match_tier")


@query
def cluster_merge(spark, sf_dir):
    return _matches(spark, sf_dir, across=False).where("match_rule like '%cluster_merge' or match_tier = 'candidate_cluster_merge'").select("group_id", "row_ord", "match_rule")


@query
def cluster_cross(spark, sf_dir):
    return _matches(spark, sf_dir).where("match_tier like '%cross'").select("group_id", "row_ord", "match_rule", "match_tier")


@query
def group_to_pairs(spark, sf_dir):
    return ledger.group_pairs(views.view(spark, sf_dir, views.REVIEWED)).select("entry_a", "entry_b", "verdict", "name_a", "name_b", "context_a", "context_b")


@query
def ledger_harvest(spark, sf_dir):
    return ledger.harvest(views.view(spark, sf_dir, views.REVIEWED), views.view(spark, sf_dir, views.LEDGER)).select("entry_a", "entry_b", "verdict", "note", "name_a", "context_b")


@query
def ledger_apply(spark, sf_dir):
    fresh = views.view(spark, sf_dir, views.REVIEWED).withColumn("match", F.lit(""))
    return ledger.apply_ledger(fresh, views.view(spark, sf_dir, views.LEDGER)).select("group_id", "row_ord", "match")


@query
def review_actions(spark, sf_dir):
    fresh = views.view(spark, sf_dir, views.REVIEWED).withColumn("match", F.lit(""))
    acts = fresh.where("row_ord % 4 = 0").select("group_id", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(a).alias("action"), F.lit(p).alias("position")) for k, a, p in ((1, "x", 3), (2, "y", 0))])).alias("x"))
    return ledger.apply_review(fresh, acts.select("group_id", "x.*")).select("group_id", "row_ord", "match")


@query
def pending_review(spark, sf_dir):
    return ledger.pending_groups(views.view(spark, sf_dir, views.REVIEWED), "exact")


@query
def identity_collapse(spark, sf_dir):
    return identity.person_ids(views.view(spark, sf_dir, views.MATCHES))


@query
def identity_apply(spark, sf_dir):
    rows = names(spark, sf_dir).select("row_ord", "entry_id", "person_id")
    return identity.collapse(rows, views.view(spark, sf_dir, views.MATCHES)).select("row_ord", "person_id")


@query
def identity_conflicts(spark, sf_dir):
    return identity.person_ids(views.view(spark, sf_dir, views.MATCHES)).where("groups > 1").select("entry_id", "groups")


@query
def group_order(spark, sf_dir):
    return with_group_order(views.view(spark, sf_dir, views.MATCHES)).select("row_ord", "group_id", "group_ord")


@query
def author_filter(spark, sf_dir):
    return filter_author(names(spark, sf_dir).withColumn("author", F.concat(F.lit(" "), c("full_author"), F.lit(" "))), "Peter Hollis").select("row_ord")


@query
def review_view(spark, sf_dir):
    return ledger.display_groups(views.view(spark, sf_dir, views.REVIEWED).withColumn("at", c("row_ord").cast("string")), width=7).select("group_id", c("at").alias("place"), "normalized_name", "book")


@query
def run_counters(spark, sf_dir):
    return counters(names(spark, sf_dir), titled="parsed_title <> ''", placed="parsed_location <> ''", numbered="trim(no) rlike '^[0-9]+$'")


@query
def person_labels(spark, sf_dir):
    return names(spark, sf_dir).select("row_ord", editions.label(c).alias("label"))


@query
def edition_report(spark, sf_dir):
    at = names(spark, sf_dir).withColumn("person_id", F.concat_ws("-", "parsed_first", "parsed_last", "parsed_title", "book"))
    found = editions.missed_matches(at, 2.5).orderBy(F.desc("score"), "dep_pid", "arr_pid").limit(50)  # a report of the best 50
    return found.select("dep_pid", "arr_pid", "score", "edition_boundary")


@query
def edition_overview(spark, sf_dir):
    return editions.edition_overview(subscriptions(spark, sf_dir)).select(*[c(x).cast("long").alias(x) for x in ("edition", "total", "new", "continued", "departed")])


@query
def arrivals_departures(spark, sf_dir):
    at = names(spark, sf_dir).withColumn("person_id", F.concat_ws("-", "parsed_first", "parsed_last", "book"))
    return editions.persons(at).select("person_id", "first_ed", "last_ed", "editions")


@query
def missed_match_scores(spark, sf_dir):
    at = names(spark, sf_dir).withColumn("person_id", F.concat_ws("-", "parsed_first", "parsed_last", "parsed_title", "book"))
    return editions.missed_matches(at, 2.5).select("dep_pid", "arr_pid", "score", "dep_last", "arr_last", "dep_editions", "arr_editions")


@query
def work_nodes(spark, sf_dir):
    return graph.work_nodes(subscriptions(spark, sf_dir))


@query
def person_nodes(spark, sf_dir):
    return graph.person_nodes(subscriptions(spark, sf_dir))


@query
def edges(spark, sf_dir):
    return graph.edges(subscriptions(spark, sf_dir))


@query
def author_conflicts(spark, sf_dir):
    return graph.author_conflicts(subscriptions(spark, sf_dir))


def _graph(spark, sf_dir):
    rows = subscriptions(spark, sf_dir)
    return graph.edges(rows), graph.work_nodes(rows)


@query
def overlap_count(spark, sf_dir):
    return graph.overlap_measure(*_graph(spark, sf_dir), "count")


@query
def overlap_jaccard(spark, sf_dir):
    return graph.overlap_measure(*_graph(spark, sf_dir), "jaccard")


@query
def overlap_repr(spark, sf_dir):
    return graph.overlap_measure(*_graph(spark, sf_dir), "repr")


@query
def shared_persons(spark, sf_dir):
    return graph.shared_persons(subscriptions(spark, sf_dir))


@query
def projected_edges(spark, sf_dir):
    return graph.projected_edges(graph.overlap(*_graph(spark, sf_dir)))


@query
def communities(spark, sf_dir):
    links, works = _graph(spark, sf_dir)
    return graph.communities(works, graph.projected_edges(graph.overlap(links, works)), resolution=1.0)


@query
def community_order(spark, sf_dir):
    works = graph.work_nodes(subscriptions(spark, sf_dir))
    member = works.select("book", F.when(F.substring("book", 7, 1) == "3", -1).otherwise(F.substring("book", 7, 1).cast("int") % 3).alias("community"))
    return graph.community_order(works, member).select("book", "community", "place")


def _books(spark, sf_dir) -> DataFrame:
    views.tables(spark, sf_dir)
    return spark.table("part").select(c("p_partkey").alias("id"), c("p_type").alias("author"), F.concat_ws(" ", F.lit("The"), c("p_name"), F.lit("and the"), c("p_type"), F.lit("of"), c("p_brand")).alias("book"))


@query
def book_color(spark, sf_dir):
    return _books(spark, sf_dir).select("id", present.book_color(c("book")).alias("color"))


@query
def short_title(spark, sf_dir):
    return _books(spark, sf_dir).select("id", present.short_title(c("book")).alias("title"))


@query
def author_last(spark, sf_dir):
    return _books(spark, sf_dir).select("id", present.author_last(c("author")).alias("surname"))


@query
def book_abbr(spark, sf_dir):
    return _books(spark, sf_dir).select("id", present.book_abbr(c("book")).alias("abbr"))


@query
def community_colors(spark, sf_dir):
    at = _books(spark, sf_dir).select("id", (c("id") % 13 - 1).cast("int").alias("community"))
    at = at.select("id", present.community_color(c("community")).alias("color"))
    return at.select("id", "color", present.dark_fill(c("color")).alias("x")).select("id", "color", "x.r", "x.g", "x.b")


@query
def highlights(spark, sf_dir):
    return _books(spark, sf_dir).select("id", present.is_highlighted(" Steel ", c("author"), c("book")).alias("hit"), present.is_highlighted(" ", c("author"), c("book")).alias("none"))


@query
def chord_curves(spark, sf_dir):
    at = _books(spark, sf_dir).select("id", *[(F.cos if k < 2 else F.sin)(c("id") * (1 + k % 2)).alias(n) for k, n in enumerate(("ax", "bx", "ay", "by"))])
    at = at.select("id", F.posexplode(present.chord_curve(c("ax"), c("ay"), c("bx"), c("by"), samples=5)).alias("k", "p"))
    return at.select("id", c("k").cast("long").alias("k"), "p.x", "p.y")


@query
def chord_widths(spark, sf_dir):
    return present.chord_widths(graph.overlap(*_graph(spark, sf_dir)))


def _ring(spark, sf_dir) -> DataFrame:
    links, works = _graph(spark, sf_dir)
    member = works.select("book", (F.substring("book", 7, 1).cast("int") % 3).alias("community"))
    ordered = graph.community_order(works, member).select("book", "community", "place")
    return saved(present.ring_layout(ordered.join(present.node_areas(graph.work_sizes(links)), "book")), "ring")


@query
def ring_layout(spark, sf_dir):
    return _ring(spark, sf_dir).select("book", "community", "angle", "x", "y", "radius")


@query
def ring_shrink(spark, sf_dir):
    return present.shrink_factor(_ring(spark, sf_dir), points=0.002)


@query
def value_range(spark, sf_dir):
    return present.value_range(graph.overlap(*_graph(spark, sf_dir)), "repr")


from rollcall.plans import files  # noqa: E402  its queries read what it writes

QUERIES |= files.QUERIES
ORACLES = {name: SQL[name] for name in QUERIES if name in SQL}
