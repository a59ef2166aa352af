"""Decontamination, language ID, secrets and main text against brute force, held-out accuracy and edge rows."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewsieve.llm import decontaminate, html, langid, secrets
from reviewsieve.llm.common import words
from reviewsieve.llm.queries import QUERIES

EDGE = [(1, None), (2, ""), (3, "…  \n"), (None, "the of and"), (5, "a " * 60_000), (6, "a b"), (6, "a b")]


def frame(spark, rows, extra="items string, spans string, lang_pred string, score string, contamination string"):
    names = extra.split(", ")
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"doc_id long, text string, {extra}")


def brute_hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        seq = words(body)
        n = min(window, len(seq))
        for i in range(len(seq) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j:j + n] == seq[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(str(k), draw(rng.choice([0, 1, 2, 4, 6, 9, 14]))) for k in range(12)]
    items[1] = ("1", "a b c a b c a b c")
    docs = [(k, draw(rng.randrange(40)) + rng.choice([" ", " zz ", "!"]) + draw(rng.randrange(30))) for k in range(60)]
    docs[3] = (3, items[5][1] + " É " + items[6][1].upper())
    for block in (50_000, 10):  # one automaton, and several
        got = decontaminate.find_items(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id string, text string"), window=5, block_words=block)
        for r in got.collect():
            c = r.contamination
            assert (c.n_words, c.n_hit, list(c["items"])) == brute_hits(r.text, items, 5), r.text
            assert all(words(r.text[s.start:s.end]) == words(r.text)[w.start:w.end] for s, w in zip(c.spans, c.word_spans))


def test_longest_match():
    automaton = decontaminate.SuffixAutomaton([("x", words("a b c d e")), ("y", words("c d f a b"))], 4)
    assert automaton.scan(words("q b c d f a z"))[0] == 4
    assert automaton.scan([])[0] == 0


def test_decontamination_decides(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"x y {item} z"), (2, "u " * 600 + item + " v"), (3, "clean text"), (4, None), (5, ""), (None, "…")]
    items = spark.createDataFrame([(1, item), (None, None), (3, "")], "item_id long, text string")
    docs = frame(spark, rows)
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert out == {2: "u " * 600 + " v", 3: "clean text", 4: None, 5: "", None: "…"}
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.find_items(docs.limit(0), items).count() == 0
    found = decontaminate.find_items(frame(spark, EDGE), items).select("doc_id", "contamination.*").collect()
    assert [r.n_words for r in sorted(found, key=lambda r: r.doc_id or 0)] == [3, 0, 0, 1, 60_000, 2, 2]


def test_short_items_are_cut(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    docs = frame(spark, [(1, "u " * 300 + "Alpha beta, gamma delta epsilon v")])
    assert decontaminate.decontaminate(docs, items).first().text == "u " * 300 + " v"


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_id"](spark, d).filter("held_out").join(
        spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def test_language_mixture_and_edges(spark):
    en = "the quick brown fox jumps over the lazy dog and then it sleeps under that old tree " * 4
    de = "der schnelle braune fuchs springt über den faulen hund und schläft dann unter dem alten baum " * 4
    labelled = spark.createDataFrame([(en, "en"), (de, "de"), ("zzz", None), (None, "en")], "text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["de", "en"]
    mix = {r.doc_id: r for r in langid.identify(frame(spark, [
        (10, en * 3), (11, en * 2 + de), (12, "1234 !!"), (13, "漢字かな"), *EDGE]), model).collect()}
    assert set(mix[10].lang_mix) == {"en"} and mix[10].score == 1.0
    assert mix[11].lang_pred == "en" and 0.5 < mix[11].score < 0.8 and 0.2 < mix[11].lang_mix["de"] < 0.5
    assert [mix[k].lang_pred for k in (12, 1, 2)] == ["und"] * 3 and mix[12].score == 0
    assert mix[13].lang_pred in ("de", "en") and mix[5].lang_pred in ("de", "en")
    none = langid.fit(labelled.limit(0))
    assert {r.lang_pred for r in langid.identify(frame(spark, EDGE), none).collect()} == {"und"}
    assert langid.identify(frame(spark, EDGE).limit(0), model).count() == 0


def brute_secrets(text):
    out = []
    key = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, pattern, keep in ((0, key, lambda m: len(m[2]) >= 6),
                                (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
                                (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if keep(m)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark, sf):
    random_part = "q7Zk2Wm9Xv4Rt8Yp3Ls6Nb1C"
    made = ["é password = 'hunter2secret' x", "token=abc token: abcdef", "AKIA" + "Q7" * 8, "AKIAQQ", "a" * 24 + "g",
            "PASSWORD='" + "ab12" * 10 + "'", "my secret is KELVIN TOKEN=123456", f"bearer {random_part}",
            "session my_session_identifier_name_1", *[t for _, t in EDGE]]
    rows = [*enumerate(made), *((r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]
    got = secrets.scan(frame(spark, rows)).collect()
    kinds = {k: n for n, k in enumerate(secrets.KINDS)}
    for r in got:
        spans = [(s.start, s.end, kinds[s.kind]) for s in r.spans]
        assert [s for s in spans if s[2] < 3] == brute_secrets(r.text or "")
        assert spans == sorted(spans, key=lambda x: (x[0], x[2]))
    novel = {r.doc_id: [r.text[s.start:s.end] for s in r.spans if s.kind == "novel"] for r in got if r.text}
    assert novel[7] == [random_part] and novel[8] == []
    clean = secrets.scan(frame(spark, rows)).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[0] == "é [SECRET]' x" and out[7] == "bearer [SECRET]" and out[9] is None and out[3] == "AKIAQQ"
    assert out[5] == "[SECRET]'"  # a hex span inside an assignment is one with it
    assert secrets.scan(frame(spark, rows).limit(0)).count() == 0


def test_secrets_among_secrets():
    """Ten random tokens side by side are found, for several alphabets."""
    rng, novelty = random.Random(8), secrets.Novelty()
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = [(letters + letters.upper() + "0123456789", 32), (letters + letters.upper() + "0123456789+/", 64),
                 ("0123456789abcdef", 20), ("0123456789ABCDEF", 32), (letters + "0123456789", 40)]
    found = total = 0
    for alphabet, size in alphabets:
        for _ in range(10):
            tokens = ["7f" + "".join(rng.choices(alphabet, k=size - 2)) for _ in range(10)]
            if alphabet.isupper():
                tokens = [t.upper() for t in tokens]
            text = "".join(f'session_key: "{t}"\n' for t in tokens)
            spans = secrets.novel_spans(text, [], novelty)
            found, total = found + len({text[s:e] for s, e, _ in spans} & set(tokens)), total + 10
    assert found > 0.97 * total


@pytest.mark.parametrize("form", [
    "aws_secret_access_key={}", "PRIVATE_KEY={}\n", "session={}; path", "GET /a?signature={}&x=1", "{} # session",
    "auth: {}", "session_{}", "x = {}-token", "my_application_settings_session_credential_{}", "private={}==",
    '"{}": "the private one"'])
def test_secret_beside_its_name(form):
    token = "9fQz7Zk2Wm9Xv4Rt8Yp3Ls6Nb1CtU5d"
    text = "The settings of the service are these: " + form.format(token) + " and they are read at the start."
    spans = secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty())
    assert any(token in text[s:e] for s, e, _ in spans) and len(spans) == 1
    plain = text.replace(token, "my_session_identifier_name_1")
    assert not secrets.novel_spans(plain, secrets.base_spans(plain), secrets.Novelty())


PAGE = ("<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
        "<div class='{box}'><h1>Head &amp; line</h1><p>One <b>bold</b>\n text &#233;.<br>More<p>Two<script>x('<p>')</script>"
        "<form><p>Your mail</p></form></div><div id='comments'><p>Great post, thank you all so much for this!</p></div>"
        "<aside><p>Side</p></aside><footer>&copy; me</footer></body></html>")


def test_main_text(spark):
    pages = [(k, f"https://h.example/{k}", PAGE.format(box=f"post-{k}")) for k in range(3)]
    other = ("<body><div class='post-9'><p>Short.</p></div><div class='list'>" + "<p>Teaser with many more words in it.</p>" * 3
             + "</div></body>")
    pages += [(3, "https://h.example/3", other), (4, None, None), (None, "x", ""), (6, "https://other.example/", other),
              (7, "https://i.example/7", "plain < text & more"), (8, "https://j.example/8", "<p>" + "long words " * 30_000)]
    docs = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, text string, path string")
    got = {r.page_id: r for r in html.extract(docs).collect()}
    assert got[0].text == "Head & line\nOne bold text é. More\nTwo"
    assert got[3].text == "Short." and "Teaser" in got[6].text  # the host's path decides, else the page's own
    assert got[4].text == "" and got[None].text == "" and got[7].text == "plain < text & more"
    assert len(got[8].text) == 330_000 - 1
    assert html.extract(docs.limit(0)).count() == 0


TEXT = "".join(f"<p>Paragraph {k} of an article that runs on for a while.</p>" for k in range(6))
PLAIN = "\n".join(f"Paragraph {k} of an article that runs on for a while." for k in range(6))
COMMENTS = "<div id='comments'><p>" + "Thank you for this. " * 40 + "</p></div>"


@pytest.mark.parametrize("page,expected", [
    (f"<body><div class='layout has-sidebar'>{TEXT}</div></body>", PLAIN),
    (f"<body class='x'><div class='no-comments'>{TEXT}</div></body>", PLAIN),
    (f"<div class='with-banner post'>{TEXT}<div class='site-footer'>Foot</div></div>", PLAIN),
    (f"<section class='related-work'>{TEXT}</section>", PLAIN),
    (f"<div class='post'><div class='entry-header'><h1>Title</h1></div>{TEXT}</div>", "Title\n" + PLAIN),
    (f"<body><form id='aspnetForm'><nav>Home</nav><div>{TEXT}</div><div class='footer'>Foot</div></form></body>", PLAIN),
    (f"<div class='sidebar'><main>{TEXT}</main></div>", PLAIN),
    (f"<html><head><title>t</title><meta charset=x><style>p {{}}</style><body><div>{TEXT}</div>", PLAIN),
    (f"<head><link rel=x href=y><p>First</p>{TEXT}", "First\n" + PLAIN),
    (f"<div><svg class=\"i\"/>{TEXT}<svg><path d='M0'/><text>no</text></svg></div>", PLAIN),
    (f"<div><svg class='i'><path d='M0'/>{TEXT}</div>", PLAIN),
    (f"<div class='post'>{TEXT}</div>{COMMENTS}", PLAIN),
    ("<nav><a href='/'>Home</a></nav><footer>Foot</footer>", "")])
def test_no_article_vanishes(page, expected):
    assert html.main_text(html.read_blocks(page), None)[0] == expected


LINKS = "<ul class='refs'>" + "".join(f"<li><a href='/{k}'>Reference number {k}</a></li>" for k in range(3)) + "</ul>"
REFS = "\n".join(f"Reference number {k}" for k in range(3))
LONG = TEXT * 10
BODY = "\n".join([PLAIN] * 10)


@pytest.mark.parametrize("page,expected", [
    (f"<article><h1>Headline</h1><p>Lead.</p><div class='body'>{LONG}</div></article>", "Headline\nLead.\n" + BODY),
    (f"<div class='post'><h1>Headline</h1><div class='a'><div class='b'><div class='c'>{LONG}</div></div></div></div>",
     "Headline\n" + BODY),
    (f"<article><div class='body'>{LONG}</div>{LINKS}</article>", BODY + "\n" + REFS),
    (f"<main><div class='body'>{LONG}</div>{LINKS}</main>", BODY + "\n" + REFS),
    (f"<body><nav>Home</nav><div class='post'><div class='body'>{LONG}</div>{LINKS}</div></body>", BODY + "\n" + REFS),
    (f"<div class='page'><nav>Home</nav><div class='top'><a href='/'>All the topics</a></div><div class='post'>{LONG}</div></div>",
     BODY)])
def test_whole_article(spark, page, expected):
    docs = spark.createDataFrame([(k, "https://h.example/", page) for k in range(2)], "page_id long, url string, html string")
    assert [r.text for r in html.extract(docs).collect()] == [expected] * 2


def test_articles_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"<[^>]*>", " " if "<br" in b else "", b) for b in re.split(r"</?(?:p|h1)>", article)]
        import html as entities
        plain = [re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks]
        assert r.text == "\n".join(b for b in plain if b) and r.n_chars == len(r.text)


def test_registered_rows(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_decontamination", "op8_secret_scan"):
        assert QUERIES[name](spark, sf).count() == n
    empty = hashlib.sha256(b"").hexdigest()
    assert QUERIES["op8_secret_scan"](spark, sf).filter("n_assign + n_access + n_hex = 0").first().base_sha256 == empty


@pytest.mark.parametrize("text,expected", [("ABC déf-x1", [b"abc", "déf".encode(), b"x1"]), (None, [])])
def test_words(text, expected):
    assert words(text) == expected


def test_many_secrets_and_limits(spark):
    """A text of 10,000 hashes is redacted in seconds; any coverage limit works on many hit words."""
    import hashlib
    import time

    from reviewsieve.llm import decontaminate, secrets

    hashes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(10_000)]
    docs = spark.createDataFrame([(1, "\n".join(hashes)), (2, "nothing"), (3, None)], "doc_id long, text string")
    start = time.time()
    got = {r.doc_id: r.text for r in secrets.scan(docs).withColumn("text", secrets.redact(F.col("text"), F.col("spans"))).collect()}
    assert time.time() - start < 40 and got == {1: "\n".join(["[SECRET]"] * 10_000), 2: "nothing", 3: None}
    words_ = " ".join(f"w{k}" for k in range(400))
    items = spark.createDataFrame([("a", words_)], "item_id string, text string")
    pages = spark.createDataFrame([(1, words_ + " x" * 3600), (2, words_ + " x" * 3601)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(pages, items, max_coverage=0.1).collect()] == [2]


def test_unclosed_tags_end():
    """Pages of unclosed tags are scanned without giving back characters of their names."""
    import time

    start = time.time()
    for page in ("<b" * 5000, "<" + "x" * 50_000, "<p>" + "a<b and c<d then e<f; " * 1000):
        assert not html.Tags(page).next(3)
    assert time.time() - start < 10


@pytest.mark.parametrize("page,expected", [
    ("<b" * 100_000, "<b" * 100_000),
    ("<p>" + "a<b and c<d then e<f; " * 9_000, ("a<b and c<d then e<f; " * 9_000).strip()),
    ("<a " * 66_000 + "' >", ("<a " * 66_000 + "' >")),
    ("<div><p>" * 25_000 + "deep", "deep"),
    ("".join(f"<div class={'abc'[k % 3]}><p>word {k}" for k in range(12_000)), "\n".join(f"word {k}" for k in range(12_000))),
    ("<p>x</p>" + "<nav><p>y" * 20_000, "x"),
    ("<b>" + "<div>x</b></div>" * 12_000, "\n".join(["x"] * 12_000)),
    ("&#" + "9" * 100_000 + "; &#" + "0" * 9_999 + "65;", "\ufffd A"),
    ("<p title='a>b'>one<p data-x=\"<i>\">two <!-- <p> -->three", "one\ntwo three"),
    ("<div class='a>b'><p>one</div>", "one")])
def test_long_and_deep_pages(page, expected):
    """Pages of 200 KB that took square or cubic time; the whole text comes back in about a second."""
    import time

    start = time.time()
    assert html.main_text(html.read_page(page), None)[0] == expected
    assert time.time() - start < 10
