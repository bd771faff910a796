"""Tokens, languages, toxicity, secrets, pages, archives and mixing on small inputs."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swayscan.llm import bpe, html_text, langid, mix, secret_scan, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MINE, THEIRS = bpe.Tokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
EXTRA = "id string, lang string, score string, spans string, _p string, factor string, tokens string, key string"
ODD = ["", None, " ", "…", "word " * 30_000, "a" * 200_000, "ümläut\x00\x1c", "<|endoftext|>"]


def documents(spark, texts, **more):
    rows = [(n, t, *([None] * 8)) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


# --- tokens -------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aaeinorstth' .,!12é’ßΣσ́ \x1c\n<|>")), max_size=60))
def test_ids_are_those_of_the_library(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert MINE.encode(text).tolist() == want
    assert MINE.decode(want) == THEIRS.decode(want, skip_special_tokens=False)


def test_words_of_the_vocabulary_and_special_tokens():
    words = random.Random(5).sample(sorted(MINE.ids), 3000)
    for text in [*(w.replace("</w>", "") + v.replace("</w>", "") for w, v in zip(words, words[1:])), "a<|endoftext|>B<|startoftext|>", "<|endoftext|"]:
        assert MINE.encode(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids, text


def test_encode_odd_rows(spark):
    rows = bpe.digests(bpe.encode(documents(spark, ODD), TOKENIZER)).collect()
    for row in rows:
        want = THEIRS.encode(ODD[row.id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(THEIRS.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert len(rows) == len(ODD) and bpe.encode(documents(spark, []), TOKENIZER).count() == 0


def test_memory_of_the_encoder_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    fresh = bpe.Tokenizer(TOKENIZER)
    text = " ".join(f"w{i} and{i}" for i in range(200))
    assert fresh.encode(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids
    assert len(fresh.seen) <= 11 and len(fresh.seen.older) <= 11


# --- languages ----------------------------------------------------------------


def test_code_lengths_by_their_definition():
    from collections import Counter

    texts = {"a": "abra cadabra abracadabra", "b": "be bop be bop a loo"}
    counts = {}
    for lang, text in texts.items():
        data = b"   " + text.encode()
        counts[lang] = Counter(data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1))
    model = langid.Model(counts)

    def cost(lang, context, byte):
        total = 0.0
        for n in (3, 2, 1, 0):
            seen = {g[-1]: c for g, c in counts[lang].items() if len(g) == n + 1 and g[:-1] == context[3 - n :]}
            if not seen:
                continue
            size = sum(seen.values()) + len(seen)
            if byte in seen:
                return total + np.log2(size / seen[byte])
            total += np.log2(size / len(seen))
        return total + 8

    for text in ("abra be", "zzz!", "éa"):
        data = text.encode()
        out = np.zeros((1, 2))
        model.fill([data], [0], out)
        padded = b"   " + data
        for k, lang in enumerate(model.languages):
            want = sum(cost(lang, padded[i : i + 3], padded[i + 3]) for i in range(len(data)))
            assert out[0, k] == pytest.approx(want, rel=1e-5)


def test_code_lengths_do_not_depend_on_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 5, "en"), (2, "der hund und die katze " * 5, "de")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    texts = [b"the dog and the cat", b"und", b"x" * 50, "größer".encode()]
    whole = np.zeros((4, 2))
    model.fill(list(texts), [0, 1, 2, 3], whole)
    monkeypatch.setattr(langid, "BLOCK", 7)
    parts = np.zeros((4, 2))
    model.fill(list(texts), [0, 1, 2, 3], parts)
    assert np.allclose(whole, parts)


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 5, "en"), (2, "der hund und die katze " * 5, "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    rows = {r.id: r for r in langid.identify(documents(spark, [*ODD, "der und die", "the cat the mat", "12 34"]), model).collect()}
    assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (0, 1, 2, 3, 10)] == ["und"] * 5
    assert (rows[8].lang_pred, rows[9].lang_pred) == ("de", "en")
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(documents(spark, ["the cat"]), empty).collect()} == {"und"}
    assert langid.accepted(documents(spark, ["the cat", None, "12"]), model).columns == documents(spark, []).columns
    assert langid.accepted(documents(spark, ["the cat", None, "12"]), model).count() == 1


# --- toxicity -----------------------------------------------------------------


def test_marginals_against_all_sequences():
    rng = np.random.default_rng(0)
    lengths, change = np.array([6, 3, 1, 0]), rng.normal(size=(2, 2))
    e = rng.normal(size=10)
    got = toxicity.marginals(e, lengths, change)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for states in np.ndindex(*[2] * n):
            weight = sum(e[at + i] * s for i, s in enumerate(states)) + sum(change[a, b] for a, b in zip(states, states[1:]))
            total += np.exp(weight)
            on += np.exp(weight) * np.array(states)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_toxic_words_are_found_in_texts_not_seen(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]

    def text(bad):
        words = rng.choices(plain, k=60)
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(60), rng.choice(["grobnik", "fleddered", "fleddering"]))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0), i) for i in range(400)]
    docs = spark.createDataFrame([r[:2] + r[3:] for r in rows], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(r[0], r[2], "x") for r in rows] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.learn(docs.filter("doc_id < 300"), labels)
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    held = [(r[2], got[r[0]].predicted) for r in rows[300:]]
    assert sum(a == b for a, b in held) >= 98
    hit = got[395]
    assert {rows[395][1][s.start : s.end] for s in hit.spans} <= {"grobnik", "fleddered", "fleddering"} and hit.spans
    odd = toxicity.score(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    none = toxicity.learn(docs.limit(0), labels)
    assert [r.predicted for r in toxicity.score(documents(spark, ["x", None]), none).collect()] == [0, 0]


# --- secrets ------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"pasword=:\"' tkenAKI0189abcdefé_-", "password", "api_key", "AKIA", "token", "0123456789abcdef"]), max_size=60).map("".join))
def test_base_spans_by_their_definition(text):
    patterns = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 0, 20),
        "hex": ("[0-9a-f]+", 0, 0, 24),
    }
    want = []
    for kind, (pattern, flags, group, least) in patterns.items():
        want += [(m.start(), list(patterns).index(kind), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    got = [(s.start, s.kind, s.end) for s in secret_scan.scan(text) if s.kind != "literal"]
    assert got == [(a, k, b) for a, _, k, b in sorted(want)]


@pytest.mark.parametrize(
    "text, secrets",
    [
        ('k = "Zq8Lm2xP9w"\ndb.password = k', ["Zq8Lm2xP9w"]),
        ('apiSecret := "ab12" + "cd34efgh"', ["ab12", "cd34efgh"]),
        ("env['AUTH_TOKEN'] => 's3cr3t-Value9'", ["s3cr3t-Value9"]),
        ("signing-key: Zm9vYmFyMTIz\nname: bob", ["Zm9vYmFyMTIz"]),
        ('private_key == "Zq8Lm2xP9w"', []),
        ('passphrase = "changeme"; pwd = "xxxxxxxx"; monkey = "Zq8Lm2xP9w"', []),
        ("the time: noon is near = far", []),
    ],
)
def test_assigned_literals(text, secrets):
    assert [text[s.start : s.end] for s in secret_scan.scan(text) if s.kind == "literal"] == secrets


@pytest.mark.parametrize(
    "text, secrets",
    [
        ('const apiKey: string = "Zq8Lm2xP9w";', ["Zq8Lm2xP9w"]),
        ('db_pwd: str = "Zq8Lm2xP9w"', ["Zq8Lm2xP9w"]),
        ('db_pwd: Optional[str] = "Zq8Lm2xP9w"', ["Zq8Lm2xP9w"]),
        ('let pwd: &str = "Zq8Lm2xP9w"; let pwd?: string | null = "Aq8Lm2xP9w"', ["Zq8Lm2xP9w", "Aq8Lm2xP9w"]),
        ('first: str = "Zq8Lm2xP9w"\npwd: str = other', []),
        ('passphrase = "correct horse battery staple"; title = "correct horse battery"', ["correct horse battery staple"]),
        ('pwd = "yourMom-Zq8L"; pwd = "your_api_key_here"; pwd = "your password"', ["yourMom-Zq8L"]),
        ('private_key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\n-----END RSA PRIVATE KEY-----"', ["-----BEGIN RSA PRIVATE KEY-----\nMIIEow\n-----END RSA PRIVATE KEY-----"]),
        (f'k = "old-Value1"\nk = "{"Zq8Lm2xP9w" * 500}"\npwd = k', ["Zq8Lm2xP9w" * 500]),
    ],
)
def test_real_forms_of_assignment(text, secrets):
    assert [text[s.start : s.end] for s in secret_scan.scan(text) if s.kind == "literal"] == secrets


def test_long_chains_are_linear():
    start = time.process_time()
    chain = 'pwd = "Zq8Lm2xP9w"\n' + 'pwd = pwd + "Zq8Lm2"\n' * 20_000
    assert len(secret_scan.scan(chain)) == 20_001
    assert len(secret_scan.scan('pwd = "Zq8Lm2xP9w"\n' + "pwd = pwd + pwd\n" * 20_000)) == 1
    for text in ("a:b[" * 20_000, "a::a" * 20_000, "pwd: a|" * 20_000, 'pwd="-----BEGIN KEY-----' * 5_000):
        secret_scan.scan(text)
    assert time.process_time() - start < 20


def test_secrets_of_odd_rows(spark):
    texts = [*ODD, "é token = 'abcdef123' x", "a=" * 50_000]
    rows = {r.id: r for r in secret_scan.digests(secret_scan.find(documents(spark, texts))).collect()}
    assert len(rows) == len(texts) and rows[8].n_assign == 1
    assert rows[0].base_sha256 == rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""
    assert rows[8].base_sha256 == hashlib.sha256(b"assign:2:20").hexdigest()
    shown = documents(spark, ["token: abcdef123, ok", None]).select(secret_scan.hidden("text")).collect()
    assert [r[0] for r in shown] == ["token: [secret], ok", None]


# --- pages --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id=wrap><article><h1>{0} &amp; co</h1><p>First {0}<br>line.<p>Second&nbsp; <b>bold</b>
<div class="share">Share this</div><ul><li>one {0}<li>two</ul><section class="comments"><p>bad comment</p></section></article></div>
<aside>Other</aside><form><p>Name</p></form><script>var x = "<p>no</p>";</script><footer>&copy; Site</footer></body></html>"""


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_pages(spark):
    rows = [(i, "https://a.example/x", PAGE.format(f"T{i}")) for i in range(8)]
    plain = "<html><body><div class='top-menu'><p>m</p></div><div class=c><p>Only <i>this</i> one</p><p>and more words here</p></div><div class=footer>f</div>"
    rows += [(20, "https://b.example/", plain), (21, None, None), (22, "::bad", ""), (23, "https://c.example", "just text"), (None, "https://a.example", PAGE.format("N")), (3, "https://a.example/x", rows[3][2])]
    got = html_text.main_text(page_rows(spark, rows)).collect()
    by = {r.id: r.text for r in got}
    assert len(got) == len(rows)
    for i in range(8):
        assert by[i] == f"T{i} & co\nFirst T{i} line.\nSecond bold\none T{i}\ntwo"
    assert by[None].startswith("N & co") and by[20] == "Only this one\nand more words here"
    assert by[21] == by[22] == "" and by[23] == "just text"
    assert html_text.main_text(page_rows(spark, [])).count() == 0


@pytest.mark.parametrize(
    "body",
    [
        '<div class="content no-sidebar">{}</div>', '<div class="layout has-sidebar"><div class="sidebar"><p>Side</p></div>{}</div>',
        '<div class="post-with-comments">{}<div class="comments"><p>bad</p></div></div>', '<div class="page header-fixed">{}</div>',
        '<form id="f"><div class="top-menu"><p>Menu</p></div>{}</form>', '<div class="widget">{}</div><div class="footer">foot</div>',
        '<div class="elementor-widget">{}</div>',
    ],
)
def test_names_do_not_hide_the_article(body):
    for inner in ("<h1>Title</h1><p>One two three.</p>", "<p>Title</p><p>One two three.</p>"):
        page = f"<html><body><nav>Home</nav>{body.format(inner)}</body></html>"
        assert html_text.extract(page) == "Title\nOne two three."
        assert html_text.extract(page, html_text.induce([page.replace("One", f"N{i}") for i in range(4)])).endswith("One two three.")


def test_templates_come_from_all_pages_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(html_text, "GROUP", 2, raising=False)  # several rounds of groups
    extra = ["".join(f"<div class=x{c}><p>part {i}{c}</p></div>" for c in "abcde"[: i % 6]) for i in range(60)]
    rows = [(i, "https://h.example/", f"<body><article><h1>T{i}</h1><p>Body {i}</p>{extra[i]}</article></body>") for i in range(60)]
    box = "<div class=seen>Seen on our site</div>"
    rows += [(100 + i, "https://h.example/", f"<body><article><h1>R{i}</h1><p>Rare {i}</p>{box}</article></body>") for i in range(3)]
    got = {r.id: r.text for r in html_text.main_text(page_rows(spark, rows + rows[:30])).collect()}
    assert [got[100 + i] for i in range(3)] == [f"R{i}\nRare {i}" for i in range(3)]
    assert all(got[i].splitlines() == [f"T{i}", f"Body {i}", *(f"part {i}{c}" for c in "abcde"[: i % 6])] for i in range(60))


def test_groups_of_layouts_align_as_pages_do():
    pages = [f"<body><div class=m><p>One {i}</p></div><div class=k>Same</div></body>" for i in range(9)]
    whole = html_text.merged([html_text.template_of(p) for p in pages])
    halves = html_text.merged([html_text.merged([html_text.template_of(p) for p in part]) for part in (pages[:4], pages[4:])])
    assert whole.full() == halves.full() == html_text.Wrapper.read(halves.full()).full()
    assert whole.pages == 9 and html_text.for_pages(whole) == html_text.induce(pages)


def test_comments_longer_than_the_article_stay_out():
    page = "<body><div class=story><h1>T</h1><p>Short text</p></div><div id=comments class=comments-area>{}</div>".format("<article><p>long comment text</p></article>" * 9)
    assert html_text.extract(page) == "T\nShort text"
    assert html_text.extract("<body><form><p>only this</p></form><p></p>") == "only this"


def test_parser_is_linear_and_never_fails():
    for text in ("<div>" * 20_000, "<p>a" * 20_000, '<a "' * 20_000, "<!--" * 20_000, "<" * 50_000, "</p>" * 20_000, "<li>" * 5000 + "x"):
        html_text.extract(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("<>/!-=\"'apdiv &;x ")), max_size=80))
def test_parser_takes_anything(text):
    assert "\n\n" not in html_text.extract(text)


def test_tree_matching_counts_the_most_nodes():
    class N:
        def __init__(self, label, *children):
            self.label, self.children = label, children

    a = N("r", N("a"), N("b", N("x"), N("y")), N("c"))
    b = N("r", N("b", N("y")), N("a"), N("c"))
    assert html_text.align(a, b) == (4, [(1, 0), (2, 2)])
    assert html_text.align(a, N("q")) == (0, [])


# --- archives -----------------------------------------------------------------


def test_archives_give_back_what_was_written(spark):
    rows = [(i, f"http://www.h{i % 3}.example/p?q={i}", "same" if i % 2 else f"page {i} é") for i in range(60)]
    rows += [(100, None, None), (101, "http://x.example/\r\nX: y", ""), (102, "http://[bad", "<p>" * 10_000), (1, "http://www.h1.example/p?q=1", "same"), (None, "http://n.example", "same")]
    pages = page_rows(spark, rows)
    archive = warc.write(pages)
    got = warc.read(archive, pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    want = []
    for i, _, text in rows:
        data = (text or "").encode()
        revisit = first[text or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[text or ""] if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    one = warc.read(archive, page_rows(spark, [(4, "http://www.h1.example/p?q=4", None), (999, "http://none.example", None)])).collect()
    assert [(r.page_id, r.payload.decode()) for r in one] == [(4, "page 4 é")]
    assert warc.read(warc.write(page_rows(spark, [])), pages).count() == 0


def test_keys_split_over_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    monkeypatch.setattr(warc, "ROWS", 10)
    pages = page_rows(spark, [(7, "http://a.example/", f"v{i}") for i in range(25)] + [(i, "http://a.example/", "z") for i in range(30)])
    got = warc.read(warc.write(pages), pages.filter("page_id = 7")).collect()
    assert sorted(r.payload_bytes for r in got) == sorted([*(len(f"v{i}") for i in range(25)), 1])


def test_sort_keys_put_a_site_together():
    assert warc.sort_key("https://www.a.b.example:80/x y?z#f", 3).startswith("example,b,a)/x%20y?z ")
    assert warc.sort_key("http://e.x/", -1) < warc.sort_key("http://e.x/", 0) < warc.sort_key("http://e.x/", 10)


# --- mixing -------------------------------------------------------------------


def test_raking_meets_its_targets(spark):
    rows = [(s, l, t, 1 + 37 * i % 91) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")]
    rows.append(("a", "z", "p", 0))
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {d: mix.tempered(cells, d, 0.5) for d in ("source", "lang", "topic")}
    fitted = mix.rake(cells, targets, 40).collect()
    for d, target in targets.items():
        for row in target.collect():
            share = sum(r.tokens * r.factor for r in fitted if r[d] == row[d]) / sum(r.tokens for r in fitted)
            assert share == pytest.approx(row.target, abs=1e-6)
    assert [r.factor for r in fitted if r.tokens == 0] == [1.0]


def test_mix_of_odd_rows(spark):
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "en", "e") for i, t in enumerate([*ODD[:4], *["some words here"] * 200])] + [(None, "x y", "s1", None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, factor string")
    got = mix.mixed(docs).collect()
    assert len(got) == len(rows) and mix.mixed(docs).columns == [*docs.columns, "_mix"]
    assert all(r._mix.kept for r in got if r._mix.tokens == 0)
    kept = [r for r in got if r._mix.tokens]
    assert all(0 < r._mix.probability <= 1 and r._mix.weight >= 1 - 1e-12 for r in kept)
    assert mix.mixed(docs.limit(0)).count() == 0
    assert {r.doc_id: r._mix.kept for r in got} == {r.doc_id: r._mix.kept for r in mix.mixed(docs.union(docs)).collect()}


def test_only_near_copies_are_left_out_of_training():
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{n}x{i}" for i in range(60)) for n in range(20)]
    long = " ".join(f"word{i}" for i in range(200))
    copies = [long, long, long.replace("word7", "other"), long + " more", "word1 word2"]
    assert toxicity._distinct(texts) == texts  # a passage in common makes no copy
    assert toxicity._distinct(copies + texts) == [long, "word1 word2", *texts]
    assert toxicity._distinct(["", "", "a"]) == ["", "a"]
