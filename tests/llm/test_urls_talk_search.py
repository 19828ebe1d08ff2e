"""URL filter, conversation repair and ranked search against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from reelgauge.llm import conversations as C
from reelgauge.llm import lexical_search as L
from reelgauge.llm import queries as Q
from reelgauge.llm import url_filter as U
from reelgauge.llm.shipping import ship

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_url_filter", "op13_ranked_search"])
def test_queries_match_their_sql(spark, name):
    assert oracle.difference(spark, DATA, Q.QUERIES[name], Q.ORACLES[name]) is None


# URL filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/de/", "allow"), ("a.b.net", "", "allow"), ("net", "/lo", "block")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.ORG/es/1", "https://example.org", "https://example.org?x=/es/", "ftp://x.example.org/es/a#b",
    "https://notexample.org/es/", "http://site.com/de/9", "http://com/de/", "http://x.com/fr/1", "http://bad.net/page.html", "https://www.bad.net/page/?q=1",
    "https://m.bad.net/page/index.html#x", "http://worse.bad.net/page", "http://a.b.net/local", "http://b.net/local", "http://user://x/y", "http://org/\n/z",
    "http://x.com:80/de/1", "http://long.net/" + "p" * 50_000, "http://" + "s." * 500 + "org/a",
]
LISTED = ["bad.net/page", "bad.net/page", "gone.net/never"]


def plain_verdict(url):
    host, path = re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*).*", url).groups() if url and "://" in url else ("", "")
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    canonical = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/index)?(\.html?)?/*$", "", path)
    _, _, verdict, rule = max(fits, default=(0, 0, "block" if canonical in LISTED else "allow", None))
    return host, path, rule, verdict


@pytest.mark.parametrize("size", [1, 16 << 20])
def test_urls_match_a_plain_filter_with_a_small_or_full_one(spark, monkeypatch, size):
    monkeypatch.setattr(U, "FILTER_BYTES", max(size, 32))
    ship(spark)
    pages = spark.createDataFrame([(i % 20 or None, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit(f"own {c}") for c in ("keys", "key", "rule", "labels", "_row", "verdict")})
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in [*LISTED, None]], "canonical string")
    found = U.filter_urls(pages, rules, listed).collect()
    assert Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in found) == Counter((u, *plain_verdict(u)) for u in URLS + URLS)
    assert all(r["keys"] == "own keys" and r["_row"] == "own _row" for r in found)
    assert U.filter_urls(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in U.filter_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


def test_the_filter_holds_all_keys_and_few_others(spark):
    ship(spark)
    numbers = spark.range(20_000).select(F.concat(F.lit("="), "id").alias("key"))
    words = U.build_filter(numbers.filter("id < 10000"), 10_000)
    tested = U.passed_keys(numbers.select("key", F.array("key").alias("keys")), "keys", words)
    held = {int(r.key[1:]) for r in tested.filter(F.size("keys") == 1).collect()}
    assert held >= set(range(10_000)) and len(held) < 10_000 + 200


# Conversation repair

TALK = [
    ("user", "Hi there."), ("assistant", "Yes!"), ("system", "Be kind."), ("user", "cut off"), ("assistant", " "), ("tool", "x?"), ("user", "Hi there."),
    ("assistant", "open ended"), ("", "..."), (None, None), ("user", ""),
]


def plain_repair(rows):
    """Every sequence of edits with at most two inserts in a place."""
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    choices = []
    for (role, text), fault in zip(rows, faults):
        more = 5 * (fault == "truncated")
        edits = [("D", 2, None)]
        if fault in ("", "truncated"):
            edits += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(edits)
    gaps = [("", 0, ()), ("I", 5, (("user", ""),)), ("I", 5, (("assistant", ""),)), ("II", 10, (("user", ""), ("assistant", "")))]
    best = None
    for edits in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = filled[0][1], filled[0][0], list(filled[0][2])
            for (name, price, row), (more, extra, put) in zip(edits, filled[1:]):
                cost, audit, out = cost + price + extra, audit + name + more, out + ([row] if row else []) + list(put)
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")] + [illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()]


@pytest.mark.parametrize("segment", [1, 2, C.SEGMENT])
def test_repairs_match_all_edits_tried(spark, segment):
    ship(spark)
    rng = random.Random(5)
    talks = [[rng.choice(TALK) for _ in range(rng.randrange(1, 5))] for _ in range(60)]
    rows = [(None if i == 7 else i, None if i % 9 == 0 and k == 0 else k * 2 + 3, *row, 1) for i, talk in enumerate(talks) for k, row in enumerate(talk)]
    rows.append((1000, 1, "user", "dropped", 0))
    spaced = [(i, k, " " if r is None else r, " " if t is None else t, n) for i, k, r, t, n in rows]
    rng.shuffle(spaced)
    df = spark.createDataFrame(spaced, "conv_id long, turn long, role string, text string, copies int")
    found = {r.conv_id: r for r in C.repair(df.withColumn("symbols", F.lit("own")), segment).collect()}
    assert len(found) == 61
    for i, talk in enumerate(talks):
        row = found[None if i == 7 else i]
        expected = plain_repair([(" " if r is None else r, " " if t is None else t) for r, t in talk])
        assert list(row)[2:] == expected, talk
        turns = [k * 2 + 3 for k in range(len(talk)) if not (i % 9 == 0 and k == 0)]
        assert row.gaps == (turns[-1] - turns[0] + 1 - len(turns) if turns else 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(found[1000]) == (1000, 0, 0, 0, 0, 0, 0, "", empty)


def test_damage_follows_its_draw(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (0, 1, 12, None) for t in [*range(60), None]]
    found = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in found:
        name = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        draw = zlib.crc32(name.encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(draw, 1)
        assert r.role == ("user" if draw == 4 else "assistant")
        assert draw == 0 or r.text == {1: "", 2: "A b c"}.get(draw, "A. b! c?")


def test_a_large_conversation_spans_segments_and_repeated_rows(spark):
    """Of 30,000 rows most are one repeated row; the rest alternates."""
    ship(spark)
    rows = [(1, 0, "user", "again.", 1)] * 20_000 + [(1, t, ("assistant", "user")[t % 2], f"line {t}.", 1) for t in range(1, 10_001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    row = C.repair(df).first()
    # The one kept first row is answered by the user's next one, so one of the two goes.
    assert (row.blank, row.duplicate, row.truncated, row.gaps) == (0, 19_999, 0, 0)
    assert len(row.audit) == 30_000 and Counter(row.audit) == {"K": 10_000, "D": 20_000}
    assert row.cost == 40_000 and row.illegal == 20_000


def test_empty_conversations_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damage(df)).count() == 0


def test_rules_cost_what_their_symbols_cost():
    letters = [chr(65 + i) for i in range(16)]
    rng = random.Random(2)
    rules, symbols = [], list(letters)
    for i in range(40):
        pair = rng.choice(symbols) + rng.choice(symbols)
        rules.append((pair, chr(0x100 + i)))
        symbols.append(chr(0x100 + i))
    grammar, plain = C.Grammar(rules), C.Grammar([])
    for _ in range(200):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        one, other = C.Repair(grammar, {}), C.Repair(plain, {})
        one.feed(text), other.feed(text[:5]), other.feed(text[5:])
        assert one.result() == other.result()


# Ranked search

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return RUN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, top):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(counts, sizes):
            m = 75 + (25 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        rows += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return Counter(rows)


WORDS = ["the", "of", "and", "Über", "straße", "x1", "naïve", "zebra", "quilt", "ÉCLAIR", "a", "b-c", "q_w", "z\x00y"]


def made_docs(rng, count):
    texts = [" ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randrange(0, 40))) for _ in range(count)]
    return texts + texts[:20] + [None, "", "...", "the " * 30_000]


def test_ranking_matches_brute_force(spark):
    ship(spark)
    rng = random.Random(3)
    docs = [(None if i % 50 == 9 else i // 2, t) for i, t in enumerate(made_docs(rng, 400))]
    items = [(1, "The zebra the quilt"), (2, None), (3, "unseen words"), (4, "a of and The"), (4, "über Über éclair"), (None, "x1 X1 b c"), (5, " ".join(WORDS * 300))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("own"), "terms": F.lit(1)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = Counter(tuple(r) for r in L.rank_documents(df, asked).select("item_id", "rank", "doc_id", "score").collect())
    assert found == plain_ranking(docs, items, 20)
    assert L.rank_documents(df.limit(0), asked).count() == 0 and L.rank_documents(df, asked.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_trees_leave_out_no_document(monkeypatch, leaf):
    monkeypatch.setattr(L, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    for _ in range(30):
        rows = [np.unique(rng.zipf(1.5, rng.integers(0, 12)) % 25) for _ in range(rng.integers(1, 150))]
        tfs = [rng.integers(1, 5, len(r)) for r in rows]
        m = rng.integers(75, 300, len(rows))
        ids = rng.permutation(len(rows))
        tree = L.TermTree(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).astype(np.int64), np.concatenate(tfs).astype(np.int64), m, ids)
        weights = rng.integers(0, 3, 25) * rng.integers(0, 9_000, 25)
        best = L.Best(7)
        tree.search(weights, best)
        plain = []
        for r, t, k, i in zip(rows, tfs, m, ids):
            score = sum(int(weights[a]) * (10**9 * int(b) // (1000 * int(b) + 12 * int(k))) for a, b in zip(r, t))
            if score > 0:
                plain.append((-score, int(i)))
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == sorted(plain)[:7]
