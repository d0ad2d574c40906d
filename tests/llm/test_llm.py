"""Brute-force, round-trip and held-out checks of the training-data operators."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from netledger.llm import (
    bpe, decontaminate, fingerprint, graph, html_text, jaccard, pii, quality, queries, storage, toxicity, warc, wordpiece,
)
from netledger.llm.shipping import ship_package
from netledger.llm.textops import Codes, passes

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "a", "!!! ???", "x" * 70_000, "word " * 9_000, "é ß 字\n\t\r\n  end ", "one two three four", "one two three four"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and a clashing extra column."""
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "a", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, fingerprint string")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


# -- quality ------------------------------------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op1_quality"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.9


def test_ordinal_thresholds_are_ordered_and_recover_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 400)
    rows = [(int(g), np.array([int(g), 9]), np.array([1.0, 1.0])) for g in grades]
    model = quality.fit_rows(rows, 4)
    assert (np.diff(model.thresholds) > 0).all()
    latent = model.weights[grades] + model.weights[9]
    tails = model.tails(latent)
    full = np.concatenate([np.ones((400, 1)), tails, np.zeros((400, 1))], axis=1)
    assert ((full[:, :-1] - full[:, 1:]).argmax(1) == grades).mean() > 0.95


def test_quality_edges(spark, odd, none):
    ratings = spark.createDataFrame([(0, 0), (5, 1), (6, 2)], "doc_id bigint, grade int")
    model = quality.fit(odd, ratings, 3)
    scored = odd.select(quality.graded(model, F.col("text")).alias("q")).collect()
    assert len(scored) == 12 and all(0 <= r["q"]["tail_prob"] <= 1 for r in scored)
    assert quality.fit_or_none(none, ratings, 3) is None
    with pytest.raises(ValueError):
        quality.fit(odd, ratings.limit(0), 3)


# -- PII ----------------------------------------------------------------------------------------------------------------------

#: The base patterns of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_match_plain_patterns(spark, docs, odd):
    hard = ["a@b.c_d@e.f x..a@b-c.de.f.g", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 10.0.0.256", "4111 1111-1111 1111, 4111111111111112",
            "+1 (415) 555-2671 x +44 20 7946 0958. +1-2", "a" * 20_000 + "@" + "b." * 2_000 + "c", "1" * 20_000,
            "é😀 joe.x@ex.org +33 1 23 45 67 89"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id bigint, text string")
    for source in (frame, docs, odd):
        want = sorted(hashlib.sha256(base_spans(r["text"]).encode()).hexdigest() for r in source.collect())
        assert sorted(r["base_sha256"] for r in pii.report(source).collect()) == want


def test_disclosing_terms_are_found_and_rewritten(spark):
    texts = [f"note {i}: Quillfeather quillson wrote from ann@corp.example.org about filler{i}" for i in range(6)]
    texts += [f"ordinary text number {i} wrote about nothing" for i in range(200)] + ["seen: QUILLFEATHER again", None, ""]
    frame = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars int, text_key string")
    found = {r["doc_id"]: r for r in pii.report(frame).collect()}
    assert found[206]["spans"] == "term:6:18" and found[0]["n_terms"] >= 1
    assert all(found[i]["n_terms"] == 0 for i in range(6, 206))
    clean = {r["doc_id"]: r for r in pii.sanitised(frame).collect()}
    assert "Quillfeather" not in clean[0]["text"] and "<email>" in clean[0]["text"] and "ann@" not in clean[0]["text"]
    assert "QUILLFEATHER" not in clean[206]["text"] and clean[50]["text"] == texts[50] and clean[207]["text"] is None
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values() if r["text"] is not None)


def test_disclosure_counts_whole_documents_like_brute_force(spark):
    import math
    from collections import defaultdict
    rng = np.random.default_rng(7)
    texts = []
    for i in range(400):
        words = [f"w{int(x)}" + "ab" for x in rng.zipf(1.4, 30) if x < 400]
        mails = [f"u{int(k)}@ex{int(k)}.org" for k in rng.integers(0, 30, rng.integers(0, 3))]
        texts.append(" ".join(words + [f"tail{len(k)}{k[1]}zz" for k in mails if rng.random() < 0.8] + ["pad"] * 60 + mails))
    texts += [texts[3]] * 5 + [texts[9]] * 40 + [f"Zorblatt {'filling ' * 40} far@away.org {i}xyz" for i in range(4)] + [None, ""]
    want_terms = {}
    entity_docs, term_docs, both, both_texts = (defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set))
    for text in (t or "" for t in texts):
        mails = {m[0] for m in re.finditer(BASE["email"], text)}
        words = {w for w in re.findall(r"[a-z0-9]+", re.sub(BASE["email"], " ", text.lower())) if len(w) > 2}
        for w in words:
            term_docs[w] += 1
        for e in mails:
            entity_docs[e] += 1
            for w in words:
                both[e, w] += 1
                both_texts[e, w].add(text)
    n = len(texts)
    for (e, w), n_te in both.items():
        if len(both_texts[e, w]) >= pii.MIN_TEXTS and entity_docs[e] < n:
            value = math.log(n * n_te / (term_docs[w] * entity_docs[e])) / math.log(n / entity_docs[e])
            if value >= pii.GENERALISE:
                want_terms[w] = max(value, want_terms.get(w, 0))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    terms, places = pii.disclosing_terms(pii.seen_entities(frame), frame)
    got = {r["term"]: r["disclosure"] for r in terms.collect()}
    assert "zorblatt" in got and len(got) > 3 and got.keys() == want_terms.keys()
    assert all(abs(got[w] - want_terms[w]) < 1e-9 for w in got)
    assert {r["term"] for r in places.collect()} == set(got)
    last = {r["doc_id"]: r for r in pii.report(frame).collect()}
    assert "term:0:8" in last[len(texts) - 3]["spans"]


def test_pii_plan_has_no_python(spark, docs):
    plan = pii.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pii_empty(none):
    assert pii.report(none).count() == 0


# -- decontamination -----------------------------------------------------------------------------------------------------------

def word_distance(item, text):
    """Smallest edit distance of the item to any run of words of the text."""
    best = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(best[j - 1] + (w != x), best[j] + 1, row[-1] + 1))
        best = row
    return min(best)


def test_contamination_matches_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[random.choice(vocabulary) for _ in range(random.randint(10, 40))] for _ in range(12)]
    texts = []
    for k in range(120):
        body = [random.choice(vocabulary) for _ in range(random.randint(0, 80))]
        if k % 2:
            part = list(random.choice(items))
            for _ in range(random.randint(0, int(0.25 * len(part)))):
                at = random.randrange(len(part))
                part[at:at + random.randint(0, 1)] = random.choice([[], ["zz"]])
            at = random.randint(0, len(body))
            body[at:at] = part
        texts.append(" ".join(body))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    want = {(d, i): n for d, t in enumerate(texts) for i, item in enumerate(items)
            if (n := word_distance(item, t.split())) <= int(0.2 * len(item))}
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    assert len(got) >= 0.97 * len(want)
    sharded = decontaminate.contaminated(frame, bench, shard_chars=600).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in sharded} >= {k for k, n in want.items() if n == 0}


def test_repetitions_suit_the_largest_need(caplog):
    rng = random.Random(4)
    item = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    short, long = [item(30) for _ in range(420)], [item(120) for _ in range(60)]
    many = lambda texts: decontaminate.ItemIndex(list(range(len(texts))), texts, 0.2, 0.99).repetitions
    assert many(short + long) == many(long + short) >= many(long) > 4
    index = decontaminate.ItemIndex(list(range(60)), long, 0.2, 0.99)
    hits = 0
    for i in range(60):
        w = long[i].split()
        for _ in range(24):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + (kind != 2)] = [] if kind == 0 else [f"v{rng.randrange(10**9)}"]
        hits += any(x[1] == i for x in index.search(decontaminate.Words(Codes([" ".join(w)]))))
    assert hits >= 58
    decontaminate.ItemIndex([1], [long[0]], 0.9, 0.99)
    assert "target" in caplog.text


def test_contaminated_rows_go_by_id_and_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(None, passage), (None, "clean one"), (7, f"so {passage} so"), (7, "clean two"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    kept = {(r["doc_id"], r["text"]) for r in decontaminate.without_contaminated(docs, items).collect()}
    assert kept == {(None, "clean one"), (7, "clean two"), (8, None)}


def test_contamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four"), (2, ""), (3, None), (1, "one two three four")], "item_id bigint, text string")
    assert sorted(tuple(r)[:2] for r in decontaminate.contaminated(odd, bench).collect()) == [(8, 1), (8, 1), (9, 1), (9, 1)]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_contaminated(odd, bench).columns == odd.columns


# -- token counts ----------------------------------------------------------------------------------------------------------------

def test_piece_counts_match_greedy_matching():
    random.seed(1)
    begin, go_on = {b"a", b"ab", b"abcd", b"x", b"un"}, {b"b", b"c", b"bc", b"bcde", b"f", b"aff", b"a", b"able"}
    counter = wordpiece.PieceCounter(begin, go_on)

    def greedy(word):
        n = at = 0
        while at < len(word):
            ends = [j for j in range(len(word), at, -1) if word[at:j] in (go_on if at else begin)]
            if not ends:
                return 0
            n, at = n + 1, ends[0]
        return n

    for _ in range(20_000):
        word = "".join(random.choice("abcdefunlx") for _ in range(random.randint(1, 9))).encode()
        assert counter(word) == greedy(word)


def test_token_counts(spark, docs, odd, none):
    path = public_tokenizers.path(queries.PIECE_RANKS)
    begin, go_on = map(set, wordpiece.pieces_of_ranks(path))
    longest = max(map(len, begin | go_on))

    def greedy(word):
        n = at = 0
        while at < len(word):
            for j in range(min(len(word), at + longest), at, -1):
                if word[at:j] in (go_on if at else begin):
                    break
            else:
                return 0
            n, at = n + 1, j
        return n

    for source in (docs.limit(40), odd):
        want = sorted(sum(max(greedy(w.encode()), 1) for w in re.findall(r"[^\W_]+|[^\w\s]|_", r["text"] or "")) for r in source.collect())
        assert sorted(r["n_pieces"] for r in wordpiece.count_pieces(source, path).collect()) == want
    assert wordpiece.count_pieces(none, path).count() == 0


# -- HTML ------------------------------------------------------------------------------------------------------------------------

def test_main_text():
    page = ('<body><header>H</header><nav>n</nav><div class="ad">x</div><article><h1>T &amp; t</h1><p><b>a<br>b</b> c<i>d</i><p>e'
            '<ul><li>1<li>2</ul><form>f</form><section class="comments"><article>r</article></section></article><footer>z</footer>')
    assert html_text.main_text(page, set()) == "T & t a b cd e 1 2"
    assert html_text.main_text("<div>hello<div id=cookie-notice>c</div> w&nbsp;o</div><script>if(a<b)</script>x<!-- un", set()) == "hello w o x"
    assert html_text.main_text("", set()) == "" and html_text.main_text("a < b", set()) == "a < b"
    assert html_text.main_text("<div>" * 5_000 + "deep", set()) == "deep"


def test_templates_are_learned_per_host(spark):
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<div><span>Share {i % 2}</span></div><div>Own {i}</div>") for i in range(40)]
    pages += [(90, None, None), (91, "broken", ""), (92, "http://h0.org/x", "<article><p>Share 0</p></article>")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(frame).collect()}
    assert got[3] == ("Own 3", 5) and got[90] == ("", 0) and got[91] == ("", 0) and got[92] == ("Share 0", 7) and len(got) == 43


def test_template_inside_articles(spark):
    note = "<div class='x1'>Read us every day, best wishes.</div>"
    shared = "<p>A passage of some articles.</p>"
    rows = [(k, "http://a.x/p", f"<article><p>Story {k}.</p>{shared if k < 4 else ''}{note}</article>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Story {k}." + (" A passage of some articles." if k < 4 else "") for k in range(12)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, "http://a.x/p", f"<div><p>The same {'story' if k < 6 else k}.</p><p>It goes on.</p></div>") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"The same {'story' if k < 6 else k}. It goes on." for k in range(8)}


def test_pages_table(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    body = {r["page_id"]: re.search("<article>(.*)</article>", r["html"], re.S)[1] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        plain = re.sub("<br>|</?p>|</?h1>", " ", re.sub("</?b>", "", body[r["page_id"]]))
        assert r["text"] == " ".join(html.unescape(plain).split())


# -- n-gram join -----------------------------------------------------------------------------------------------------------------

def brute_join(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (find(i), links[i]) for i in ids}

def test_html_names_declare_by_their_last_word():
    kept = ('<p class="share-price">a</p><p class="notice-of-intent">b</p><section id="signup-history">c</section>'
            '<div class="story-comment-count">d</div><article class="post">e</article>')
    gone = ('<div class="cookie-notice">x</div><div id="ad-slot-3">x</div><ul class="main related-articles"><li>x</ul>'
            '<article class="comment">x</article><article id="reply-12">x</article><div class="siteFooter">x</div>')
    assert html_text.main_text(f"<body><article>{kept}{gone}</article>{gone}</body>", set()) == "a b c d e"


def test_html_parsing_is_linear():
    import time
    n = 100_000
    pages = ["<div>" * n + "</p>" * n, "<a " * 3 * n, "<li><article>" + "<div>" * n + "</li>" * n, "<b>" * n + "<hr>" * n,
             """<a '"> """ * n, "<a " + "a" * 10 * n + ">", '<a "' * 2 * n]
    begin = time.time()
    for page in pages:
        html_text.parse(page)
    assert time.time() - begin < 60  # the former search took minutes for any one of the first four


def test_html_templates_match_brute_force_counts(spark):
    from collections import defaultdict
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        host = f"h{i % 3}.example"
        menu = f"<div class=top><a href=/>Home</a> shelf {i % 3}</div>"
        box = f"<div>offer {int(rng.integers(0, 4))}</div>"
        odd = "<nav>only here</nav>" if i == 7 else "<nav>Menu of all</nav>"
        rows.append((i, f"https://{host}/{i}", f"<body>{menu}{odd}<p>text {int(rng.integers(0, 25))} <i>of {i}</i></p>{box}</body>"))
    rows += [(200 + k, rows[5][1], rows[5][2]) for k in range(30)] + [(300, None, None), (301, "broken", "")]
    pages_of, bodies = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        host = (url or "").split("/")[2] if "://" in (url or "") else ""
        body = html_text.main_text(page or "", set())
        bodies[host].add(body)
        stack = list(html_text.parse(page or "").parts)
        while stack:
            part = stack.pop()
            if not isinstance(part, str) and part.chars:
                if part.tag != "body":
                    pages_of[host, part.hash].add(body)
                # Below a declared part nothing is counted.
                stack += [] if part.dropped else part.parts
    want = {(host, h) for (host, h), found in pages_of.items()
            if len(found) >= html_text.MIN_PAGES and len(found) >= html_text.SHARE * len(bodies[host])}
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {(r["host"], h % (1 << 64)) for r in html_text.templates(frame).collect() for h in r["template"]}
    assert got == want and want
    out = {r["page_id"]: r for r in html_text.extract(frame).collect()}
    assert len(out) == len(rows) and "only here" not in out[7]["text"] and out[7]["n_declared"] == len("only here")
    assert out[8]["n_declared"] == 0 and out[8]["n_template"] >= len("Menu of all") and "offer" not in out[8]["text"]


def test_html_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_text.extract(empty).count() == 0
    rows = [(1, "https://a.b/1", "<p>one</p>", "h", 5, "t"), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, salt int, template string")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(frame).collect()) == [("", 0), ("one", 3)]


def test_join_matches_brute_force(spark, monkeypatch):
    random.seed(2)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [[random.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    texts = []
    for k in range(160):
        part = list(base[k % 8 if k % 3 else 0])
        for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
            part[random.randrange(len(part))] = random.choice(vocabulary)
        texts.append(" ".join(part))
    rows = list(enumerate(texts)) + [(200, ""), (201, None), (202, "!!"), (203, "a b"), (204, "A, b!")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # several blocks per bucket
    got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in jaccard.ngram_join(frame).collect()}
    assert got == brute_join(rows)


def test_join_edges(spark, odd, none):
    rows = jaccard.ngram_join(odd).collect()
    assert len(rows) == 12 and sum(r["doc_id"] is None for r in rows) == 1
    assert jaccard.ngram_join(none).count() == 0
    kept = jaccard.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 9").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


# -- BPE -------------------------------------------------------------------------------------------------------------------------

def test_pretokens_and_merges():
    random.seed(3)
    ranks = bpe.read_ranks(public_tokenizers.path(queries.BPE_RANKS))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pattern = regex.compile(public_tokenizers.PATTERN)
    letters = list(" \n\t'  stremvdlx'ab1²é!?.,　\xa0Ωж字😀\r")
    for _ in range(1_000):
        texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(4)]
        starts, bounds = bpe.pretoken_starts(Codes(texts))
        joined = "".join(texts)
        tokens = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])]
        assert [tokens[a:b] for a, b in zip(bounds, bounds[1:])] == [pattern.findall(t) for t in texts]
    for size in (5, 60, 65, 3_000):
        word = "".join(random.choice("abcdefghijklmnopéèßжtheing") for _ in range(size))
        assert bpe.encode_word(word.encode(), ranks) == encoding.encode_ordinary(word)


def test_bpe_round_trip(spark, docs, odd, none):
    path = public_tokenizers.path(queries.BPE_RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for source in (docs, odd):
        want = sorted((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                      for t in (r["text"] or "" for r in source.collect()) for ids in [encoding.encode_ordinary(t)])
        assert sorted(tuple(r)[1:] for r in bpe.encode(source, path, bpe.digests, bpe.DIGEST_FIELDS).collect()) == want
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.encode(odd, path, bpe.token_ids, bpe.TOKEN_FIELDS).collect()}
    assert decoded[7] == ODD[7] and decoded[1] == ""
    assert bpe.encode(none, path, bpe.digests, bpe.DIGEST_FIELDS).count() == 0


# -- WARC ------------------------------------------------------------------------------------------------------------------------

def test_warc(spark, tmp_path):
    rows = [(1, "http://a/é \n", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "é" * 60), (6, "u", "é" * 60),
            (7, "u", "short"), (8, "u", "short"), (9, "u", "\r\n\r\n" * 5_000), (None, "u", "x" * 200)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = str(tmp_path / "archive")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.report(frame, path).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {2: 1, 6: 5, None: 1}
    for i, _, t in rows:
        assert got[i] == (len((t or "").encode()), sha(t), "revisit" if i in first else "response", first.get(i))
    some = warc.read(spark, path, "page_id bigint, record_type string").filter("record_type = 'revisit'")
    assert not re.search(r"\bFilter \(", some._jdf.queryExecution().executedPlan().toString()) and some.count() == 3
    # Addresses that do not fit into the first bytes read of a record, wherever the reads end.
    far = base64.b64encode(np.random.default_rng(1).bytes(12_000)).decode()
    long = spark.createDataFrame([(i, "http://a/" + far[:9_000 + 60 * i], "x" * 200) for i in range(75)],
                                 "page_id bigint, url string, html string")
    assert {r["payload_bytes"] for r in warc.report(long, str(tmp_path / "long")).collect()} == {200}
    # A foreign archive: plain gzip members, no manifest, no lengths.
    other = tmp_path / "foreign"
    other.mkdir()
    (other / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(i, "u", "response", None, sha(t), len(t), t.encode()))
                                               for i, t in ((1, "one" * 5_000), (2, ""))))
    assert [tuple(r) for r in warc.read(spark, str(other), "page_id bigint, payload binary").orderBy("page_id").collect()] == [
        (1, b"one" * 5_000), (2, b"")]


# -- toxicity --------------------------------------------------------------------------------------------------------------------

def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = labels.filter(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, learned)
    assert toxicity.restore("an 1d10t, a stuuupid cl0wn", model.letters) == "an idiot, a stupid clown"
    assert toxicity.restore("l-o-s-e-r and t r a s h", model.letters) == "loser and trash"
    assert toxicity.restore("plain words stay", model.letters) == "plain words stay"
    rows = docs.select("doc_id", toxicity.scores(model, spark, F.col("text")).alias("s")).join(labels, "doc_id").filter(
        quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["s"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.93


def test_toxicity_decodes_every_token_with_more_than_one_reading(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    counts = np.zeros(toxicity.GRAMS, np.int64)
    for _, group in passes(texts):
        batch = Codes(group)
        counts += np.bincount(toxicity.gram_codes(batch.codes, batch.offsets), minlength=toxicity.GRAMS)
    letters = toxicity.LetterModel(counts)
    for text, plain in (
        ("iidiot, stuupid mooron; Iidiot", "idiot, stupid moron; idiot"),
        ("!diot +rash |oser (lown", "idiot trash loser clown"),
        ("an id iot, a st upid; tra sh", "an idiot, a stupid; trash"),
        ("mo r on 1d iot", "moron idiot"),
    ):
        assert toxicity.restore(text, letters) == plain
    assert toxicity.disguised(Codes(["407 $+"]), ["407 $+"], letters)[0] == ["407", "$+"]
    words = letters.words(np.array([9, 4, 9, 15, 20]))
    table = letters.log
    assert np.isclose(words(np.array([0]), np.array([2]))[0], table[0, 0, 0, 9] + table[0, 0, 9, 4] + table[0, 9, 4, 0])
    assert np.isclose(words(np.array([1]), np.array([5]))[0], table[0, 0, 0, 4] + table[0, 0, 4, 9] + table[0, 4, 9, 15]
                      + table[4, 9, 15, 20] + table[9, 15, 20, 0], rtol=1e-4)


def test_toxicity_edges(spark, odd, none):
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id bigint, label int"))
    assert all(0 <= r[0] <= 1 for r in odd.select(toxicity.scores(model, spark, F.col("text"))).collect())


# -- fingerprints ------------------------------------------------------------------------------------------------------------------

def test_fingerprints(docs, odd, none):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.with_edits(docs).collect()}
    errors = []
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        a, b = shingle_set(text), shingle_set(edited)
        if len(a) > 30:
            errors.append(abs(got[i]["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.03
    assert len(fingerprint.with_edits(odd).collect()) == 12 and fingerprint.with_edits(none).count() == 0
    assert fingerprint.fingerprints(odd).columns == [*odd.columns, "fingerprint_"]


# -- the pipeline ------------------------------------------------------------------------------------------------------------------

def test_pipeline(spark, docs):
    import corpus_pipeline

    frame, columns = docs, docs.columns
    for name, function in corpus_pipeline.STAGES:
        after = storage.stage(function(spark, frame, SF), name)
        if name != "bpe":
            assert after.columns == columns
        assert 0 < after.count() <= frame.count()
        frame = after
    assert frame.columns == ["doc_id", "ids", "decoded"]
