"""Replace personal data by keyed surrogates, with DataFrame functions only.

Each entity found in a text is reduced to a canonical form; a keyed digest of
type and canonical form makes the surrogate, so that one person's number is
replaced alike wherever and however it is written. The surrogates of all
distinct entities are then checked: where two would share one, or one equals an
entity of the corpus, all but one are drawn again, from the third draw on from
longer forms; what still collides after some draws gets a form with its rank.

A name is a given name and a surname, each with a surrogate of its own, so that
Dr. John Smith, Mr. John Smith and Mr. Smith stay one family and one person. A
given name has the gender of the titles that it is seen with in the whole table.
In a document that names somebody with a title, the name is replaced where it
stands alone, too.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import discard, let, others, quoted, saved, sieve
from rollcall.operators.skew import spread_join

#: Titles before names, by gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oskar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irma Julia Klara Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Andrea Chris Dana Eden Frankie Gale Jamie Kim Lee Maxime Noel Robin Sam Sascha Toni".split(),
    ("cyrillic", "m"): "Адам Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μάνος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φίλιππος Χρήστος".split(),
    ("greek", "f"): "Αγγελική Βάσω Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Όλγα Ρένα Σοφία Χαρά".split(),
}
#: Syllables of surnames, one for each hexadecimal digit.
SYLLABLES = {
    "latin": "bal cor den fam gol har jun kel lim mor nat pel rin sol tur vam".split(),
    "cyrillic": "бал вор ден фам гол хар зун кел лим мор нат пел рин сол тур жам".split(),
    "greek": "βαλ γορ δεν φαμ κολ χαρ ζουν κελ λιμ μορ νατ πελ ριν σολ τουρ ξαμ".split(),
}
_ANY_TITLE = "|".join(t for group in TITLES.values() for t in group)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What counts as an entity, in the order in which alternatives are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}][\p{L}\p{N}_.%+-]*+@(?:[\p{L}\p{N}-]++\.(?=[\p{L}\p{N}-]++\.|\p{L}{2}))++\p{L}{2,}",
    "secret": r"(?<!\w)(?i:token|secret|password|passwd|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9_+/-]{12,}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{_ANY_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?",
}
_EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Endings of made-up given names by script and gender.
ENDINGS = {"latin": {"m": "", "f": "a", "n": "i"}, "cyrillic": {"m": "", "f": "а", "n": "ен"}, "greek": {"m": "ος", "f": "α", "n": "ης"}}
#: The countries' letters and check digits stand before the account, whose letters count from 10.
IBAN_MODULUS, IBAN_REST = 97, 98
#: Attempts from here on are ranks, which are written out in the surrogate.
RANKED = 1_000_000_000
_SECRET_HEAD = r"^\w[\w-]*\s?[=:]\s?[\"']?"


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_EVERY), F.lit(0))


def entity_type(m: Column) -> Column:
    """Which of the patterns a found entity is of, told by its form."""
    return (
        F.when(m.rlike(rf"{_SECRET_HEAD}\w"), F.lit("secret"))
        .when(m.contains("@"), F.lit("email"))
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{12}"), F.lit("iban"))
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.lit("ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone"))
        .when(m.rlike(r"^\d"), F.lit("card"))
        .otherwise(F.lit("name"))
    )


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, r"^(\p{L}+)", 1)
    return F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")


def canonical(kind: Column, m: Column) -> Column:
    """What makes two found entities the same one."""
    digits = F.regexp_replace(m, r"\D", "")
    code = F.regexp_extract(m, r"^(\+\d{1,3})(?=[ .(-])", 1)
    phone = F.when(code != "", F.concat(code, F.lit(" "), F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}(?=[ .(-])", ""), r"\D", ""))).otherwise(digits)
    return (
        F.when(kind == "secret", F.regexp_replace(m, _SECRET_HEAD, ""))
        .when(kind == "email", F.lower(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "ip", m)
        .when(kind == "phone", phone)
        .when(kind == "name", F.regexp_replace(m, r"^\p{L}+\.? ", ""))
        .otherwise(digits)
    )


def parts(kind: Column, m: Column) -> Column:
    """The entities of a mention, as structs of kind and value: given name and surname of a name, else the one that it is."""
    one = lambda k, v: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), v.alias("value"))

    def named(whole: Column) -> Column:
        two = F.split(whole, "[ -]", 2)
        first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        return (
            F.when(whole.contains(" "), F.array(one("given", F.concat(_gender(m), F.lit(":"), first)), one("surname", second)))
            .when(whole.contains("-"), F.array(one("surname", first), one("surname", second)))
            .otherwise(F.array(one("surname", whole)))
        )

    return let(canonical(kind, m), lambda value: F.when(kind == "name", named(value)).otherwise(F.array(one(kind, value))))


def _redrawn(value: Column, digest: Column, first: int = 0) -> Column:
    """``value`` with its digits and letters from place ``first`` on drawn from the digest, kind by kind."""
    numbers = F.translate(digest, "abcdef", "147036")
    letters = F.translate(digest, "0123456789abcdef", "bdfghklmnprstvza")

    def draw(c: Column, i: Column) -> Column:
        k = F.pmod(i * 5 + F.floor(i / 64), F.lit(64)).cast("int") + 1
        return (
            F.when(i < first, c).when(c.rlike("[0-9]"), F.substring(numbers, k, F.lit(1)))
            .when(c.rlike(r"\p{Ll}"), F.substring(letters, k, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(F.substring(letters, k, F.lit(1)))).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, "(?!^)(?!$)", -1), draw), "")


def _number(digest: Column, start: int, length: int = 4) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("int")


def _luhn_sum(digits: Column) -> Column:
    places = F.reverse(F.split(digits, "(?!^)(?!$)", -1))
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(value: Column, digest: Column) -> Column:
    """A number of the same scheme and length, which passes the check digit test if ``value`` does."""
    free = _redrawn(value, digest, 1)
    head = F.substring(free, F.lit(1), F.length(free) - 1)
    fixed = F.concat(head, F.pmod(10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return F.when(_luhn_sum(value) % 10 == 0, fixed).otherwise(free)


def _more_digits(digest: Column, attempt: Column, after: int) -> Column:
    """Digits behind a number: one for each attempt behind ``after``, 12 at most, or the rank."""
    drawn = F.substring(F.translate(digest, "abcdef", "147036"), F.lit(50), F.least(attempt - after, F.lit(12)))
    return F.when(attempt >= RANKED, F.lpad((attempt - RANKED).cast("string"), 16, "0")).when(attempt > after, drawn).otherwise("")


def _mod97(account: Column) -> Column:
    """The remainder by which account numbers are checked, of the account with its first four signs moved to its end."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % IBAN_MODULUS
    return F.aggregate(F.split(turned, "(?!^)(?!$)", -1), F.lit(0), step)


def _account(value: Column, digest: Column) -> Column:
    """An account of the same country and form, which passes the check digit test if ``value`` does."""
    free = _redrawn(value, digest, 4)
    bare = F.concat(F.substring(free, 1, 2), F.lit("00"), F.substring(free, F.lit(5), F.length(free)))
    fixed = F.concat(F.substring(free, 1, 2), F.lpad((IBAN_REST - _mod97(bare)).cast("string"), 2, "0"), F.substring(free, F.lit(5), F.length(free)))
    return F.when(_mod97(value) == 1, fixed).otherwise(_redrawn(value, digest, 2))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _spelled(hexadecimal: Column, words: Column) -> Column:
    return F.array_join(F.transform(F.split(hexadecimal, "(?!^)(?!$)", -1), lambda c: F.element_at(words, F.conv(c, 16, 10).cast("int") + 1)), "")


def _made_up(script: Column, digest: Column, attempt: Column, least: int) -> Column:
    """A word of ``least`` syllables, one more for each attempt behind the first, 8 more at most; or of 16 that tell the rank."""
    out = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        words = F.array(*map(F.lit, syllables))
        drawn = _spelled(F.substring(digest, F.lit(2), least + F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(8))), words)
        out = F.when(script == s, F.when(attempt >= RANKED, _spelled(F.lpad(F.hex(attempt - RANKED), 16, "0"), words)).otherwise(drawn)).otherwise(out)
    return F.initcap(out)


def _known_gender(gender: Column, name: Column, script: Column) -> Column:
    """The gender said, else that of the lists of names, else by the ending where the script's names tell it."""
    listed = F.lit(None).cast("string")
    for (_, g), names in GIVEN.items():
        listed = F.when(name.isin(names), g).otherwise(listed)
    ending = F.when(script == "latin", "n").when(name.rlike("[аяαη]$"), "f").otherwise("m")
    return F.when(gender != "n", gender).otherwise(F.coalesce(listed, ending))


def _given(value: Column, digest: Column, attempt: Column) -> Column:
    """A given name of the same script and gender, another one than ``value`` (gender:name); made up from the second draw on."""
    name = F.substring(value, 3, 1000)

    def made(script: Column) -> Column:
        def of(gender: Column) -> Column:
            listed = ending = F.lit("")
            for s, by_gender in ENDINGS.items():
                for g, end in by_gender.items():
                    here = (script == s) & (gender == g)
                    ending = F.when(here, end).otherwise(ending)
                    if names := GIVEN.get((s, g)):
                        at = _number(digest, 1, 1)
                        word = lambda k, names=names: F.element_at(F.array(*map(F.lit, names)), F.pmod(k, F.lit(len(names))) + 1)
                        listed = F.when(here, F.when(word(at) == name, word(at + 1)).otherwise(word(at))).otherwise(listed)
            return F.when((attempt == 0) & (listed != ""), listed).otherwise(F.concat(_made_up(script, digest, attempt, 2), ending))

        return let(_known_gender(F.substring(value, 1, 1), name, script), of)

    return let(_script(name), made)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a canonical entity, in canonical form.

    Of an attempt from ``RANKED`` on, surrogates of one kind differ if their
    attempts do.
    """
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 256)

    def made(d: Column) -> Column:
        long = F.concat(d, F.sha2(d.cast("binary"), 256))
        repeated = F.repeat(long, F.ceil(F.length(value) / 128).cast("int"))
        octets = [F.lit(1) + _number(d, 1) % 223, *[_number(d, k) % 256 for k in (5, 9, 13)]]
        rank = attempt - RANKED
        ranks = [F.lit(1) + rank % 223, *[F.floor(rank / n).cast("int") % 256 for n in (223, 223 * 256, 223 * 65536)]]
        octets = [F.when(attempt >= RANKED, r).otherwise(o) for r, o in zip(ranks, octets, strict=True)]
        suffix = F.when(attempt >= RANKED, F.lower(F.lpad(F.hex(rank), 16, "0"))).otherwise("")
        drawn_hex = F.concat(F.substring(repeated, F.lit(1), F.length(value)), suffix)
        return (
            F.when(kind == "email", F.concat(_redrawn(F.substring_index(value, "@", 1), d), suffix, F.lit("@"), F.substring(F.translate(F.reverse(d), "0123456789", "ghklmnprst"), 1, 8), F.lit(".example.org")))
            .when((kind == "secret") & value.rlike("^[0-9a-fA-F]+$"), F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(drawn_hex)).otherwise(drawn_hex))
            .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
            .when(kind == "iban", F.when(attempt < RANKED, _account(value, d)).otherwise(F.concat(_redrawn(value, d, 2), _more_digits(d, attempt, 24))))
            .when((kind == "phone") & value.startswith("+"), F.concat(F.substring_index(value, " ", 1), F.lit(" "), _redrawn(F.substring_index(value, " ", -1), d), _more_digits(d, attempt, 1)))
            .when(kind == "phone", F.concat(_redrawn(value, d), _more_digits(d, attempt, 1)))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_redrawn(value, d), 2, 8), _more_digits(d, attempt, 24)))
            .when(kind == "card", F.concat(_card(value, d), _more_digits(d, attempt, 24)))
            .when(kind == "given", _given(value, d, attempt))
            .when(kind == "surname", _made_up(_script(value), d, attempt, 4))
            .otherwise(F.concat(_redrawn(value, d), suffix))
        )

    return let(digest, made)


def rendered(kind: Column, m: Column, new: Column) -> Column:
    """A canonical surrogate in the format in which the entity was written; digits that it has more come last."""
    digits = F.regexp_replace(new, r"\D", "")
    folded = F.aggregate(
        F.split(m, "(?!^)(?!$)", -1),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["used"] + 1, F.lit(1))).alias("out"), (acc["used"] + 1).alias("used")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["used"].alias("used"))),
        lambda acc: F.concat(acc["out"], F.substring(digits, acc["used"] + 1, F.length(digits))),
    )
    upper = (F.upper(m) == m) & (F.lower(m) != m)
    head = F.regexp_extract(m, f"({_SECRET_HEAD})", 1)
    spaced = F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))
    return (
        F.when(kind == "secret", F.concat(head, new))
        .when(kind == "email", F.when(upper, F.upper(new)).otherwise(new))
        .when(kind == "iban", F.when(m.contains(" "), spaced).otherwise(new))
        .when(kind == "ip", new)
        .otherwise(folded)
    )


def rendered_name(m: Column, new: Column) -> Column:
    """The surrogates of a name's parts, in an array, in the form in which the name was written."""
    title, gap = F.regexp_extract(m, r"^(\p{L}+\.? )", 1), F.regexp_extract(m, r"^\p{L}+\.? \p{L}+([ -])", 1)
    return F.concat(title, _joined(new, gap))


def _joined(two: Column, gap: Column) -> Column:
    return F.concat(F.get(two, F.lit(0)), F.when(F.size(two) > 1, F.concat(gap, F.get(two, F.lit(1)))).otherwise(""))


def redraws(found: DataFrame, key: str, most_draws: int = 12) -> DataFrame:
    """Rows (kind, value, attempt) of the entities whose first surrogate is taken; ``found`` has (kind, value) once each.

    After ``most_draws`` draws an attempt is ``RANKED`` and a rank that no other
    has; a rank whose form is an entity of the corpus gives way to the next one,
    so that every entity gets a surrogate of its own in the end.
    """
    ranked = RANKED
    drawn = saved(found.withColumn("attempt", F.lit(0)).withColumn("new", surrogate(F.col("kind"), F.col("value"), F.lit(0), key)), "surrogates-drawn")
    for turn in itertools.count():
        real = found.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        least = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count(F.lit(1)).alias("many"))
        taken = saved(least.join(real, ["kind", "new"], "left").where("many > 1 or real"), "surrogates-taken")
        if taken.isEmpty():
            discard(taken)
            return drawn.where("attempt > 0").select("kind", "value", "attempt")
        again = drawn.join(taken, ["kind", "new"], "left")
        lost = F.col("many").isNotNull() & (F.col("real").isNotNull() | (F.col("first.value") != F.col("value")))
        attempt = F.col("attempt") + lost.cast("int")
        again = again.select("kind", "value", attempt.alias("attempt"), "new", lost.alias("lost"))
        if turn >= most_draws:
            some = again.where("lost").select("kind", "value", (F.row_number().over(Window.partitionBy("kind").orderBy("value")) + ranked).alias("rank"))
            some = saved(some, "surrogates-ranked")
            ranked += some.count()
            again = again.join(some, ["kind", "value"], "left").withColumn("attempt", F.coalesce("rank", "attempt")).drop("rank")
        new = F.when(F.col("lost"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("new"))
        after = saved(again.select("kind", "value", "attempt", new.alias("new")), "surrogates-drawn")
        discard(drawn, taken)
        drawn = after


def _with_genders(found: DataFrame) -> DataFrame:
    """``found`` (kind, value) plus ``known``: a given name without a gender gets the one that it has elsewhere, if it is only one."""
    name, gender = F.substring("value", 3, 1000), F.substring("value", 1, 1)
    seen = found.where("kind = 'given'").select(name.alias("name"), gender.alias("gender"))
    told = seen.groupBy("name").agg(F.bool_or(F.col("gender") == "m").alias("m"), F.bool_or(F.col("gender") == "f").alias("f")).where("m <> f")
    told = told.select(F.lit("given").alias("kind"), F.concat(F.lit("n:"), "name").alias("value"), F.concat(F.when(F.col("m"), "m:").otherwise("f:"), "name").alias("known"))
    return found.join(told, ["kind", "value"], "left").withColumn("known", F.coalesce("known", "value"))


def _bare_names(text: Column, names: Column) -> Column:
    """``text`` with the names of an array of (name, new) replaced wherever they stand as whole words, the longest first."""
    longest = F.array_sort(names, lambda a, b: F.when(F.length(a["name"]) > F.length(b["name"]), -1).when(F.length(a["name"]) < F.length(b["name"]), 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    any_ = F.array_join(F.transform(longest, lambda x: x["name"]), "|")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), any_, F.lit(r")(?!\p{L})"))

    def replaced(p: Column) -> Column:
        met = F.regexp_extract_all(text, p, F.lit(0))
        new = F.transform(met, lambda w: F.get(F.filter(names, lambda x: x["name"] == w), F.lit(0))["new"])
        return _woven(F.split(text, p, -1), new)

    return let(pattern, replaced)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, plus ``n_entities``; one row per row.

    Emails, phone, card and account numbers, social security numbers, IP
    addresses, secrets and names after a title are replaced by surrogates of
    their type, format, script and gender. One entity has one surrogate in the
    whole table and two entities never share one; the mapping depends on
    ``key``, and on the table only where draws collide. Names that stand after
    a title somewhere in a text are replaced in all of it, with or without given
    name; ``n_entities`` counts the mentions with a title only.

    A null text stays null and an empty one empty, with no entities. Texts are
    read whole. Repeated rows are treated alike. Columns named like the new
    one, in whatever case, are replaced. An empty table gives an empty result.
    Only texts with an entity whose first draw was taken, or whose gender another
    text tells, are shuffled.
    """
    kinds = F.transform(entities(F.col("text")), lambda m: F.struct(entity_type(m).alias("kind"), m.alias("m")))
    each = F.array_distinct(F.flatten(F.transform(kinds, lambda x: parts(x["kind"], x["m"]))))
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]
    some = docs.where(F.col("text").rlike(_EVERY)).select(*keys, F.explode(each).alias("x")).select("k1", "k2", "x.kind", "x.value")
    some = saved(some, "surrogates-found")
    known = saved(_with_genders(some.select("kind", "value").distinct()), "surrogates-known")
    again = redraws(known.select("kind", F.col("known").alias("value")).distinct(), key).withColumnRenamed("value", "known")
    special = known.join(again, ["kind", "known"], "left").where("attempt is not null or known <> value")
    special = saved(special.select("kind", "value", "known", F.coalesce("attempt", F.lit(0)).alias("attempt")), "surrogates-special")

    kept = others(docs.columns, ("text", "n_entities"))
    rows = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)) for c in kept]).alias("doc"), "text", *keys)
    name = F.concat_ws(":", "kind", "value").alias("name")
    told = "array<struct<name:string,known:string,attempt:int>>"
    if not special.isEmpty():
        per_text = some.distinct().join(special, ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_list(F.struct(name, "known", "attempt")).cast(told).alias("special"))
        per_text = saved(per_text, "surrogates-texts")
        may, clear = sieve(rows, per_text)
        copies = may.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
        total = copies.agg(F.sum("rows")).first()[0] or 0
        may = may.withColumn("by", F.xxhash64("doc"))
        may = spread_join(may, copies.join(per_text, ["k1", "k2"], "left"), ["k1", "k2"], "by", "rows", total, "left")
        rows = clear.withColumn("special", F.lit(None).cast(told)).unionByName(may.select("doc", "text", "k1", "k2", "special"))
    else:
        rows = rows.withColumn("special", F.lit(None).cast(told))

    def new(part: Column) -> Column:
        said = F.get(F.filter("special", lambda x: x["name"] == F.concat_ws(":", part["kind"], part["value"])), F.lit(0))
        return let(said, lambda x: surrogate(part["kind"], F.coalesce(x["known"], part["value"]), F.coalesce(x["attempt"], F.lit(0)), key))

    def replacement(m: Column) -> Column:
        def of(kind: Column) -> Column:
            made = F.transform(parts(kind, m), new)
            return let(made, lambda made: F.when(kind == "name", rendered_name(m, made)).otherwise(rendered(kind, m, F.get(made, F.lit(0)))))

        return let(entity_type(m), of)

    def bare(m: Column) -> Column:
        """(name, surrogate) of a mention of a name, whole and by its surname."""
        whole = F.regexp_replace(m, r"^\p{L}+\.? ", "")
        gap, last = F.regexp_extract(whole, "[ -]", 0), F.substring_index(whole, " ", -1)

        def both(made: Column) -> Column:
            full, end = _joined(made, gap), F.element_at(made, -1)
            return F.array(F.struct(whole.alias("name"), full.alias("new")), F.struct(last.alias("name"), F.when(gap == " ", end).otherwise(full).alias("new")))

        return let(F.transform(parts(F.lit("name"), m), new), both)

    found, gaps = entities(F.col("text")), F.split("text", _EVERY, -1)
    named = F.filter(found, lambda m: entity_type(m) == "name")
    has, has_name = F.col("text").rlike(_EVERY), F.col("text").rlike(PATTERNS["name"])
    names = F.array_distinct(F.flatten(F.transform(named, bare)))
    cleared = F.when(has_name & (F.size(named) > 0), let(names, lambda n: F.transform(gaps, lambda gap: _bare_names(gap, n)))).otherwise(gaps)
    replaced = _woven(cleared, F.transform(found, replacement))
    made = rows.select("doc", F.when(has, replaced).otherwise(F.col("text")).alias("text"), F.when(has, F.size(found)).otherwise(F.lit(0)).cast("long").alias("n_entities"))
    return made.select(*[F.col(f"doc.{quoted(c)}") for c in kept], "text", "n_entities")


def _woven(gaps: Column, found: Column) -> Column:
    """Gaps and replacements in turn, joined; there is one gap more than there are replacements."""
    pairs = F.zip_with(gaps, found, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
    return F.array_join(pairs, "")
