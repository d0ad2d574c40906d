"""Checks of embedding whitening, licence scans and the conversation prefix trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from itertools import product

import duckdb
import numpy as np
import pytest

from netledger.llm import bpe, jaccard, licences, prefix_trie, queries, toxicity, whitening
from netledger.llm.shipping import ship_package
from netledger.llm.textops import Codes, passes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# -- whitening ----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_feast_finds_the_leading_pairs(d):
    rng = np.random.default_rng(d)
    low_rank = rng.standard_normal((d, 2))
    full = rng.standard_normal((d, d))
    for m in (full @ full.T, 3 * np.eye(d), low_rank @ low_rank.T, np.diag(np.repeat(np.arange(1.0, d + 1), 2)[:d]), 1e-9 * full @ full.T):
        k = min(4, d)
        value, vector = whitening.leading_pairs(m, k)
        truth = np.linalg.eigvalsh(m)[::-1]
        assert np.abs(value - truth[:k]).max() <= 1e-13 * truth[0]
        assert np.abs(m @ vector - vector * value).max() <= 1e-13 * truth[0]
        assert np.abs(vector.T @ vector - np.eye(k)).max() < 1e-12
        for shift in (0.1, 0.7, 1.3):
            assert whitening.inertia(m, shift * truth[0] + 1e-7) == (truth > shift * truth[0] + 1e-7).sum()


def test_whitening_matches_a_plain_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    copies = table.unionByName(table.limit(30))
    got = whitening.whitened(copies).toPandas()
    rows = copies.toPandas()
    x = np.floor(np.stack(rows.embedding).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    want = {}
    for key, v in zip(rows.vec_id, x):
        want[key] = int(((n * v - sums) ** 2).sum()), np.abs((v - sums / n) @ vector[:, ::-1][:, :4] / np.sqrt(value[::-1][:4]))
    assert len(got) == 4 * len(rows) and set(got.n) == {n}
    for r in got.itertuples():
        deviation, w = want[r.vec_id]
        assert r.deviation == deviation and abs(abs(r.whitened) - w[r.component - 1]) < 1e-9
    assert np.abs(got.explained - value[::-1][got.component - 1] / value.sum()).max() < 1e-12
    assert got.identity_error.max() < 1e-9


def test_whitening_edges(spark):
    inf = float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (2, None, "a"), (3, [None, 1.0], "b"), (4, [float("nan")], "b"), (5, [inf], "b"),
            (None, [0.5], "c"), (6, [], "c"), (7, [0.5, -0.25, 0.125], "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n string")
    got = whitening.whitened(df).toPandas()
    assert sorted(got.vec_id.fillna(-1)) == sorted([1, 1, -1, 6, 7] * 3) and set(got.n) == {4}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "vec_id bigint, embedding array<double>")
    assert whitening.whitened(huge).toPandas().deviation.isna().all()
    alone = whitening.whitened(df.filter("vec_id = 1")).toPandas()
    assert len(alone) == 4 and alone.whitened.isna().all() and alone.explained.isna().all() and set(alone.deviation) == {0}
    assert whitening.whitened(df.limit(0)).count() == 0


# -- toxicity -----------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def letters(spark):
    return toxicity.LetterModel(toxicity.gram_counts(spark.read.parquet(f"{SF}/documents.parquet")))


def test_words_set_apart_are_the_same_without_the_bound(spark, letters, monkeypatch):
    rng = random.Random(3)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]
    texts += ["".join(c + " " * (rng.random() < 0.3) for c in t[:3000]) for t in texts[:40]]
    texts += ["", "1 7 | 5 t", "( ( (", "a b c d", "st up id 1d 1ot |oser x", "123 456"]
    found = lambda: [toxicity.disguised(Codes(group), group, letters)[0] for _, group in passes(texts)]
    fast = found()
    monkeypatch.setattr(toxicity, "_may_join", lambda letters, a, b, gap, model: np.ones(len(gap), bool))
    assert fast == found() and sum(map(len, fast)) > 1000


def test_decoding_is_the_best_of_all_paths(letters):
    rng = random.Random(5)
    number = lambda x: ord(x) - 96 if "a" <= x <= "z" else 27

    def likelihood(way):
        state, total = (0, 0, 0), sum(cost for _, cost in way)
        for letter in "".join(word for word, _ in way) + "\0":
            k = 0 if letter == "\0" else number(letter)
            total += float(letters.log[*state, k])
            state = (*state[1:], k)
        return total

    for _ in range(60):
        token = "".join(rng.choice("aehs10$|tti") for _ in range(rng.randint(1, 7)))
        ways = list(product(*toxicity._options(token)))
        best = max(map(likelihood, ways))
        assert any("".join(w for w, _ in way) == toxicity.decode(token, letters) and likelihood(way) >= best - 1e-4 for way in ways)


# -- licences -----------------------------------------------------------------------------------------------------------------

def brute_places(text, templates, counts):
    """Every placement by walking over the words, template by template."""
    words = list(licences.words_of(text or ""))
    out = []
    for t in templates:
        ranked = sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))
        chosen = [w for w in ranked if w in words][: licences.LOOKUPS]
        if len(set(words) & set(ranked)) < t.share * len(ranked):
            continue
        at = sorted((i - k, w) for i, w in enumerate(words) if w in chosen for k, v in enumerate(t.words) if v == w)
        runs = []
        for place, word in at:
            if runs and place - runs[-1][-1][0] <= t.gap:
                runs[-1].append((place, word))
            else:
                runs.append([(place, word)])
        for run in runs:
            if len({w for _, w in run}) < t.share * len(chosen):
                continue
            begin = max(run[0][0] - t.gap, 0)
            stretch = words[begin:max(run[-1][0] + len(t.words) + t.gap, 0)]
            share = len(set(stretch) & set(ranked)) / len(ranked)
            if share >= t.share and all(f" {k} " in f" {' '.join(stretch)} " for k in t.keys):
                out.append((t.label, t.base, max(run[0][0], 0), min(run[-1][0] + len(t.words), len(words)), share))
    return len(words), sorted(out)


def test_licences_match_brute_force(spark):
    rng = random.Random(4)
    templates = licences.default_templates()
    texts = [None, "", "CC BY CC by cc-by", "all rights reserved all rights all rights reserved", "é all rights\nreserved字 cc by",
             "license " * 3000 + "mit license released under the", "x" * 70_000, "Licensed  under the Apache License, Version 2.0.)"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice(templates).words)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words) + 1)
                words[at:at + rng.randint(0, 1)] = [rng.choice(["the", "license", "foo", "by", "public", "Ünder"])] * rng.randint(0, 2)
            parts.append(rng.choice([" ", "\n", ", ", "--"]).join(w.upper() if rng.random() < 0.3 else w for w in words))
        texts.append(rng.choice(["", "so on ", "!"]) + " bar ".join(parts) + rng.choice(["", ".", " and"]))
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, "cc by", "q"), (2, texts[2], "q")],
                               "doc_id bigint, text string, words string")
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = licences.document_counts(df.select("text"), vocabulary)
    truth = defaultdict(int)
    for text in [*texts, "cc by", texts[2]]:
        for w in set(licences.words_of(text or "")) & set(vocabulary):
            truth[w] += 1
    assert counts == dict(truth)
    hit = 0
    for r in licences.find(df).collect():
        n, places = brute_places(r.row.text, templates, counts)
        assert r.n_words == n and sorted(map(tuple, r.places)) == places
        hit += len(places)
    assert hit > 150
    assert licences.report(df.limit(0)).count() == 0
    plan = licences.report(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_licence_base_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licences.report(docs).collect()}
    for r in docs.collect():
        words = licences.words_of(r.text or "")
        at = [(i, label) for label, p in licences.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == tuple(p.split())]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.base_labels) == (len(words), len(at), ",".join(sorted({x[1] for x in at})))
        assert (g.first_word, g.last_word) == (min((x[0] for x in at), default=None), max((x[0] for x in at), default=None))
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1


# -- prefix trie --------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children, leaves, saved = (defaultdict(kind) for kind in (list, int, int, int))
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == p).encode()).hexdigest(),
    ) for p, m in members.items()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(1)
    rows = [
        (c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]),
         rng.choice(["a", "bb", "ccc", None, "é字"]) if rng.random() < 0.9 else "x" * rng.randint(1, 30))
        for c in [*range(-3, 150), 1000, 1100, 10**12] for t in range(rng.choice([1, 2, 3, 5, 8, 12, 30]))
    ]
    return rows + [(None, 1, "user", "zzz")] + [(5, 1, "user", "a")] * 3


@pytest.mark.parametrize("segment, shard_ids", [(4096, 200_000), (4096, 30), (5, 40)])
def test_trie_matches_brute_force(spark, talks, segment, shard_ids):
    df = spark.createDataFrame([(*r, "k") for r in talks], "conv_id bigint, turn bigint, role string, text string, depth string").repartition(4)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so that shards of several partitions meet
    try:
        got = sorted(map(tuple, prefix_trie.prefix_trie(df, segment, shard_ids).collect()), key=str)
    finally:
        spark.conf.set(coalesce, "true")
    assert got == brute_trie(talks)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(df).collect() == []


def test_trie_sql_agrees(spark, talks):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks)
    assert sorted(con.sql(queries.ORACLES["op13_prefix_trie"]).fetchall(), key=str) == brute_trie(talks)


# -- mended operators ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.6, 0.67, 0.8, 0.95, 1.0])
def test_bands_reach_their_recall(threshold):
    bands, rows = jaccard.choose_bands(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= jaccard.RECALL and (rows == 1 or bands * rows <= 96)
    # Measured: sets of 200 members with at least that similarity, minima of random hashes.
    rng = np.random.default_rng(7)
    shared = int(np.ceil(400 * threshold / (1 + threshold)))
    found = 0
    for _ in range(200):
        h = rng.random((bands * rows, 400 - shared))
        a, b = h[:, :200].min(1), h[:, 200 - shared:].min(1)
        found += (a == b).reshape(bands, rows).all(1).any()
    assert found >= 197


def test_bands_refuse_what_makes_no_sense():
    for threshold in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError):
            jaccard.choose_bands(threshold)


def test_a_second_text_with_the_id_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (1, "something else entirely that is long enough", "c"), (2, text + " end", "d"), (None, text, "e")]
    kept = jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string, text_digest string")).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == sorted(
        [(False, text), (False, "something else entirely that is long enough"), (True, text)])


def test_other_hashes_where_two_pretokens_meet(monkeypatch):
    texts = ["one two three one", "two four"]
    plain = bpe.Chunk(texts, 8)
    spans, calls = bpe.SpanHash, []

    class Colliding(spans):
        def __call__(self, start, end):
            calls.append(1)
            out = super().__call__(start, end)
            return out * 0 if len(calls) == 1 else out

    monkeypatch.setattr(bpe, "SpanHash", Colliding)
    again = type(plain)(texts, 8)
    read = lambda chunk: [chunk.words[k] for k in chunk.number]
    assert len(calls) == 2 and read(again) == read(plain)
