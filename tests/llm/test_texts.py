"""Operators on single texts: language, pages, licences, media, personal data."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import language_id, media_sniff
from rollcall.llm.html_extract import extract_main_text, main_text
from rollcall.llm.licence_scan import BASE_PHRASES, TEMPLATES, Scanner, SuffixAutomaton, scan_licences
from rollcall.llm.surrogates import redraws, replace_entities

LANGUAGES = {
    "en": "the and that with this from have they were which their would there could been people about into other than".split(),
    "de": "der die und nicht auch eine einen werden durch über zwischen schön größe müssen würde können straße für ihren sich".split(),
    "fr": "les des est une dans pour être été avec sont mais où même très français leur nous vous après déjà".split(),
}


def sentences(language, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(LANGUAGES[language], n))


@pytest.fixture(scope="module")
def net(spark):
    rows = [(k, sentences(lang, k, 60), lang) for k, lang in enumerate(list(LANGUAGES) * 60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.training_samples(docs)
    assert samples == language_id.training_samples(docs.repartition(3))
    assert {language for language, _ in samples} == set(LANGUAGES)
    return language_id.fit_languages(docs)


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(k,) for k in range(50)], "doc_id long")
    got = [r[0] for r in rows.select(language_id.held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(50)]


def test_languages(spark, net):
    rows = [(k, sentences(lang, 1000 + k, 5 + 37 * k), lang) for k, lang in enumerate(list(LANGUAGES) * 8)]
    rows += [(90, None, "und"), (91, "", "und"), (92, "1234 -- 5!", "und"), (93, sentences("de", 5, 30000), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = language_id.identify_languages(docs, net).collect()
    want = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= len(rows) - 1
    assert all(0 <= r.score <= 1 for r in got) and {r.doc_id for r in got if r.lang_pred == "und"} == {90, 91, 92}
    nothing = language_id.train([])
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.new_network(["a", "b", "c"], hidden=3)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    net.embed, net.recur, net.out, net.bias = (p.astype(np.float64) for p in net.parameters())
    windows = rng.integers(97, 101, (4, 6)).astype(np.uint8)
    valid, labels = np.ones((4, 6)), np.array([0, 1, 2, 1])
    valid[2, 4:] = 0
    _, slopes = language_id.loss_and_gradients(net, windows, valid, labels)
    for p, g in zip(net.parameters(), slopes, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p is net.embed:
                at = (at[0], int(windows[0, 0]), at[2])
            old = p[at]
            p[at] = old + 1e-3
            up = language_id.loss_and_gradients(net, windows, valid, labels)[0]
            p[at] = old - 1e-3
            down = language_id.loss_and_gradients(net, windows, valid, labels)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_reader_agrees_with_training_network():
    net = language_id.new_network(["a", "b"], hidden=4)
    windows = np.random.default_rng(1).integers(0, 255, (5, 9)).astype(np.uint8)
    p = language_id.Reader(net).positions(windows)
    loss, _ = language_id.loss_and_gradients(net, windows, np.ones((5, 9), np.float32), np.zeros(5, int))
    assert p.shape == (9, 5, 2) and float(-np.log(p[..., 0]).mean()) == pytest.approx(float(loss), rel=1e-4)


PROSE = "It was the best of the days that we had in the town, and it is not the first time that the people of it were there with us for so long. " * 2
PAGES = {
    f"<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><a>Home</a></nav><article><h1>Head</h1><p>{PROSE}<p>By &amp;&nbsp;me.<p><b>Bold</b>face</article><footer>&copy; 2</footer></body>": "Head " + " ".join(PROSE.split()) + " By & me. Boldface",
    f"<div class='main'><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div id='comments'><p>{PROSE}</p></div><div class='sidebar-left'>{PROSE}</div><form>{PROSE}</form>": " ".join([*PROSE.split(), "Short.", *PROSE.split()]),
    f"<main><p>{PROSE}</p><aside>{PROSE}</aside><ul class='social share'><li>Tweet</li></ul></main><!-- <p>{PROSE}</p> -->": " ".join(PROSE.split()),
    "<nav><ul><li><a href='#'>One</a><li><a href='#'>Two</a></ul></nav>": "",
    "": "",
    "<p": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert main_text(page) == PAGES[page]


def test_prose_beside_an_article_tag():
    """A teaser in an article tag does not take the page's body away, nor does the body short blocks elsewhere."""
    body = " ".join([*PROSE.split(), "Short.", *PROSE.split()])
    card = "<article class='card'><h2>More</h2><p>Soon in town.</p></article>"
    page = f"<p>Menu</p>{card}<div class='content'><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div>"
    assert body in main_text(page)
    medium = PROSE[:110]
    assert " ".join([medium.strip()] * 4) in main_text(f"{card}<div class='content'>{f'<p>{medium}</p>' * 4}</div>")
    assert main_text(f"<p>You are here</p><article><p>{PROSE}</p><p>By me</p></article><p>Back to top</p>") == f"{' '.join(PROSE.split())} By me"


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "side-by-side", "menu-open", "content search", "widget"])
def test_names_of_wrappers(name):
    """A wrapper named like a part beside the article does not take the article away, and such parts are still dropped."""
    text = " ".join(PROSE.split())
    comments = f"<div id='comments'><article class='comment'><p>{PROSE}</p></article></div>"
    card = "<div class='related-posts'><article><p>Soon in town.</p></article></div>"
    assert main_text(f"<div class='{name}'><article><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></article></div>{card}") == f"Head {text} {text}"
    assert main_text(f"<div class='{name}'><p>{PROSE}</p><p>{PROSE}</p></div><div class='sidebar-left'>{PROSE}</div>") == f"{text} {text}"
    assert main_text(f"<article><p>{PROSE}</p></article>{comments}{card}") == text


RUSSIAN = "Это было лучшее время для всех жителей города, и никто не знал, когда они снова увидят такие дни вместе с друзьями. " * 3
CHINESE = "那是最好的日子我们在城里住了很久人们都说这样的时光不会再来所以大家都很珍惜每一天" * 6
TABLE = " ".join(f"row{k} {k * 7}.5 kg" for k in range(40))


def test_blocks_of_few_stop_words():
    """Languages without a list, tables and paragraphs full of links stay in the article."""
    links = "<ul><li><a href='#'>Один</a></li><li><a href='#'>Два</a></li></ul>"
    for prose in (RUSSIAN, CHINESE):
        text = " ".join(prose.split())
        assert main_text(f"<div>{links}</div><div><p>{prose}</p><p>Да.</p><p>{prose}</p></div>") == f"{text} {'Да.'} {text}"
    text = " ".join(PROSE.split())
    assert main_text(f"<div><p>{PROSE}</p><pre>{TABLE}</pre><p>{PROSE}</p></div>") == f"{text} {TABLE} {text}"
    cited = "It was <a href='#'>said by the first author of the long report</a> and <a href='#'>shown by the second one in his later book</a> that the town grew."
    assert main_text(f"<article><p>{PROSE}</p><p>{cited}</p></article>") == f"{text} {' '.join(re.sub('<[^>]*>', '', cited).split())}"


def test_pages(spark):
    rows = [(k, "u", h, "own") for k, h in enumerate([*PAGES, None])]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [*PAGES.values(), ""] and all(r.n_chars == len(r.text) for r in got)
    assert len(main_text(f"<article>{'<p>' + PROSE + '</p>'}" * 3000)) > 500000


def test_matching_statistics():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 3, 12).tolist() for _ in range(4)]
    automaton = SuffixAutomaton()
    for k, s in enumerate(sequences):
        automaton.add(k, s)
    automaton.finish()
    runs = {tuple(s[i:j]): min(e for e in range(j - i, len(s) + 1) if s[e - (j - i) : e] == s[i:j]) for s in sequences for i in range(12) for j in range(i + 1, 13)}
    text = rng.integers(0, 4, 300).tolist()
    for k, (state, size) in enumerate(automaton.statistics(text)):
        want = max((n for n in range(1, 13) if tuple(text[max(0, k + 1 - n) : k + 1]) in runs and n <= k + 1), default=0)
        assert size == want
        run = text[k + 1 - size : k + 1]
        if size:
            found = {q: min(e for e in range(size, len(s) + 1) if s[e - size : e] == run) for q, s in enumerate(sequences) if any(s[e - size : e] == run for e in range(size, len(s) + 1))}
            assert automaton.ends[state] == found


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(k, label) for phrase, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_licences(spark):
    texts = [
        None, "", "Released under the MIT License.", "under the mit under the mit license, Apache License, Version 2.0!", "CC BY-NC 4.0 cc by\nnc",
        "xunder the mit license", "under the mit-license. UNDER THE MIT LICENSE", "word " * 20000 + "cc by nc", "É cc by nc",
        *[f"Intro. {t.upper()} End." for _, t in TEMPLATES],
    ]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, licences string")
    got = scan_licences(docs).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        n, base = brute_phrases(t)
        x = r.licences
        assert (x.n_words, x.n_base, x.base_labels) == (n, len(base), ",".join(sorted({b for _, b in base})))
        assert (x.first_word, x.last_word) == ((base[0][0], base[-1][0]) if base else (None, None)) and 0 <= x.score <= 1
    for r, (label, _) in zip(got[-len(TEMPLATES) :], TEMPLATES, strict=True):
        assert label in r.licences.labels.split(",")
    assert got[1].licences.labels == "" and got[7].licences.labels == "cc-by-nc"
    text = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    assert [s[0] for s in Scanner().scan("foo " + text + " bar")[2]] == ["mit"]


GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU{} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


def test_versions_decide_licences():
    cases = {
        GNU.format("", "2"): "gpl-2", GNU.format("", "3"): "gpl-3", GNU.format("", "1"): "", GNU.format(" Library", "2"): "lgpl-2",
        GNU.format(" Lesser", "2.1"): "lgpl-2.1", GNU.format(" Lesser", "3"): "lgpl-3", GNU.format(" Affero", "3"): "agpl-3",
        "Licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "Licensed under the GNU Affero General Public License version 1": "",
        "Licensed under the GNU General Public License version 3 and, elsewhere, licensed under the GNU General Public License version 2.": "gpl-2,gpl-3",
    }
    for text, labels in cases.items():
        assert ",".join(sorted({s[0] for s in Scanner().scan(f"Intro. {text} End.")[2]})) == labels, text


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
MEDIA = {"image/png": png(), "image/gif": GIF, "image/bmp": BMP, "audio/wav": media_sniff.wav(b"abc"), "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\n%%EOF",
         "application/gzip": zlib.compressobj(9, zlib.DEFLATED, 31).compress(b"") + b"", "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02xyz\xff\xd9"}
_pack = zlib.compressobj(9, zlib.DEFLATED, 31)
MEDIA["application/gzip"] = _pack.compress(b"hello") + _pack.flush()


def test_sniffing(spark):
    for kind, data in MEDIA.items():
        assert media_sniff.sniff(data)[0] == (kind, 0, len(data)), kind
        assert (kind, 5, len(data)) in media_sniff.sniff(b"junk:" + data + b"tail"), kind
        assert all(x[:2] != (kind, 0) for x in media_sniff.sniff(data[:-1])), kind
    rows = [(k, bytearray(d), "image/png") for k, d in enumerate(MEDIA.values())] + [(90, None, None), (91, bytearray(b""), "x")]
    got = media_sniff.sniff_media(spark.createDataFrame(rows, "id int, content binary, declared string")).orderBy("id").collect()
    assert [r.media_type for r in got] == [*MEDIA, media_sniff.UNKNOWN, media_sniff.UNKNOWN]
    assert [r.type_corrected for r in got][:2] == [False, True] and bytes(got[0].media[0].bytes) == MEDIA["image/png"]


def test_many_signatures_take_linear_time():
    """Signatures without an end, zip entries and marks: no hit searches the rest of the value."""
    import time

    entry = b"PK\x03\x04" + b"x" * 26
    central = b"c" * 46
    for data in (b"%PDF- 1 obj " * 60000, entry * 30000 + central + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 1, 1, 46, 30 * 30000, 0), b"\xff\xd8\xff\xda\0\x02" * 60000):
        start = time.perf_counter()
        found = media_sniff.sniff(data)
        assert time.perf_counter() - start < 5
        assert len(found) == (1 if data.startswith(b"PK") else 0)


TEXTS = [None, "", "x", "y" * 64, "é" * 33, "GIF89a RIFF WAVEfmt %PDF- BM", "x %PDF-1.4\n1 0 obj\nendobj\n%%EOF y", "long " * 50000, "x"]


def brute_digest(text):
    data = (text or "").encode()
    padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
    stored = b"RIFF" + struct.pack("<I", 36 + len(padded)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(padded)) + padded
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(padded[1:], padded, strict=False))
    feature = f"text/plain>audio/wav;samples={len(padded)};sum={sum(padded)};peak={max(padded)};crossings={crossings};embedded={data.count(b'%%EOF')}"
    if b"%%EOF" in data:
        feature += f";carved={hashlib.sha256(data[data.index(b'%PDF') : data.index(b'%%EOF') + 5]).hexdigest()}"
    return len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def test_digests_against_a_plain_reckoning(spark):
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(TEXTS)], "doc_id long, text string, N_BYTES string")
    got = media_sniff.media_digests(docs.select("doc_id", "text")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute_digest(t) for t in TEXTS]
    assert media_sniff.media_digests(docs.where("false")).count() == 0
    media = media_sniff.sniff_media(media_sniff.text_media(docs)).orderBy("doc_id").collect()
    assert all(r.type_corrected and r.media_type == "audio/wav" and media_sniff.wav_samples(bytes(r.content)) == media_sniff.payload(t) for r, t in zip(media, TEXTS, strict=True))
    assert all(bytes(m.bytes) == bytes(r.content[m.offset : m.offset + m.length]) for r in media for m in r.media) and [len(r.media) for r in media] == [1] * 6 + [2, 1, 1]


PERSONAL = [
    "Write to ann.lee@mail3.example.com or ANN.LEE@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713.",
    "Call +1 (017) 555 7713 or (017) 555-7714; token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\".",
    "Card 4539 1488 0343 6467, again 4539148803436467; ip 169.122.221.182 and 999.1.1.1; 123-45-6789; DE89 3704 0044 0532 0130 00",
    "Mr. John Smith met Mrs. Anna Smith, and Herr Müller; Господин Иван Петров. Mr. John Smith left.",
    "No data: 12 copies, version 1.2.3, year 1999, a@b",
    "",
    None,
    "dup@x.example.com",
    "dup@x.example.com",
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(PERSONAL)], "doc_id long, text string, n_entities int")
    got = [r for r in replace_entities(docs, "key").orderBy("doc_id").collect()]
    new = [r.text for r in got]
    assert [r.n_entities for r in got] == [3, 3, 5, 5, 0, 0, 0, 1, 1] and new[4:7] == PERSONAL[4:7] and new[7] == new[8] != PERSONAL[7]
    a, b = re.findall(r"\S+@[\w.]+\w", new[0])
    assert b == a.upper() and a.endswith(".example.org") and "ann.lee" not in a
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})\.", new[0]).groups()
    assert re.search(r"\+1 \((\d{3})\) (\d{3}) (\d{4})", new[1]).groups() == phone != ("017", "555", "7713")
    assert re.search(r'token = "[0-9a-f]{40}"', new[1]) and "2abc3ff2" not in new[1]
    spaced, plain = re.search(r"Card ([\d ]{19}), again (\d{16});", new[2]).groups()
    digits = [int(c) for c in plain[::-1]]
    assert spaced.replace(" ", "") == plain and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"ip \d+\.\d+\.\d+\.\d+ and 999\.1\.1\.1; 9\d\d-\d\d-\d{4}; DE\d\d( \d{4}){4} \d\d$", new[2]) and "169.122.221.182" not in new[2]
    names = re.findall(r"(Mr\. \w+ \w+|Mrs\. \w+ \w+|Herr \w+|Господин \w+ \w+)", new[3])
    assert len(names) == 5 and names[0] == names[4] and names[0].split()[2] != "Smith" and re.search("[а-я]", names[3])
    again = [r.text for r in replace_entities(docs.repartition(3), "key").orderBy("doc_id").collect()]
    assert again == new and [r.text for r in replace_entities(docs, "other").orderBy("doc_id").collect()] != new


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With surrogates drawn from few values, collisions are drawn again until none is left."""
    from rollcall.llm import surrogates

    few = lambda kind, value, attempt, key: F.concat(F.lit("s"), F.pmod(F.xxhash64(value, attempt), F.lit(60)).cast("string"))
    monkeypatch.setattr(surrogates, "surrogate", few)
    found = spark.createDataFrame([("email", f"v{k}") for k in range(25)] + [("email", "s3"), ("card", "v1")], "kind string, value string")
    attempts = {(r.kind, r.value): r.attempt for r in redraws(found, "k").collect()}
    assert attempts
    rows = found.collect()
    at = spark.createDataFrame([(r.kind, r.value, attempts.get((r.kind, r.value), 0)) for r in rows], "kind string, value string, attempt int")
    made = [(r.kind, r.new) for r in at.select("kind", few(F.col("kind"), F.col("value"), F.col("attempt"), "k").alias("new")).collect()]
    assert len(set(made)) == len(made) and ("email", "s3") not in made


def test_more_entities_than_short_surrogates(spark):
    """More names of one word and short phones than their shortest forms have values; ranks where no draw is left."""
    from rollcall.llm import surrogates

    found = spark.sql("select 'name' as kind, concat(element_at(array('m', 'f', 'n'), cast(id % 3 + 1 as int)), ':X', translate(cast(id as string), '0123456789', 'abcdefghij')) as value from range(70000)")
    found = found.unionAll(spark.sql("select 'phone' as kind, concat('+49 ', lpad(cast(id as string), 4, '0')) as value from range(10000)"))

    def made(rounds):
        attempts = redraws(found, "k", rounds)
        at = found.join(attempts, ["kind", "value"], "left").select("kind", "value", F.coalesce("attempt", F.lit(0)).alias("attempt"))
        return at.select("kind", "value", "attempt", surrogates.surrogate(F.col("kind"), F.col("value"), F.col("attempt"), "k").alias("new")).toPandas()

    for rounds in (50, 2):
        got = made(rounds)
        phones = got[got.kind == "phone"]
        assert not got[["kind", "new"]].duplicated().any() and not set(phones.new) & set(phones.value)
        assert (got.attempt >= surrogates.RANKED).any() == (rounds == 2)
    m = spark.createDataFrame([("+49 12-34", "+49 987654")], "m string, new string")
    assert m.select(surrogates.rendered(F.lit("phone"), F.col("m"), F.col("new"))).first()[0] == "+49 98-7654"


def test_secrets_keep_their_case(spark):
    docs = spark.createDataFrame([(1, "token = abCdefghijklmn1 token = abcDefghijklmn1 TOKEN = abCdefghijklmn1 token=2ABC3FF2CA8F")], "doc_id long, text string")
    a, b, c, d = re.findall(r"= ?(\w+)", replace_entities(docs, "key").first().text)
    assert a == c != b and a.lower() != b.lower() and re.fullmatch("[0-9A-F]{12}", d)
