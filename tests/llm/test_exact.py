"""The operators against plain Python, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelgauge.llm import (
    fingerprints, jaccard_join, line_dedup, mixing, ngram_lm, packing, sharding, token_counts, vectors,
)
from reelgauge.llm.components import components
from reelgauge.llm.elias_fano import decode_at, encode_monotone
from reelgauge.llm.queries import QUERIES
from reelgauge.llm.shipping import ship

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def shingles(text):
    words = text.encode().lower().split()
    if len(words) < 5:
        return collections.Counter([tuple(words)]) if words else collections.Counter()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_tokens_equal_the_library():
    library = Tokenizer.from_file(TOKENIZER)
    draw = random.Random(3)
    pool = "aAbBzZ09'.!,<|> \t\n\x0b\x1c\x85\xa0éÉßİıſǅΣσς漢字\xad½²٣́̈‍😀"
    rows = ["", "Hello WORLD <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a\x00b", "don't WE'LL 's"]
    rows += ["".join(draw.choice(pool) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    wanted = [e.ids for e in library.encode_batch_fast(rows, add_special_tokens=False)]
    assert [x.tolist() for x in packing._chunk_ids(TOKENIZER).of(rows)] == wanted
    assert token_counts._chunk_counts(TOKENIZER).of(rows).tolist() == [len(w) for w in wanted]


def test_packing_keeps_every_token_in_few_sequences(spark, texts):
    found = QUERIES["op1_best_fit_packing"](spark, DATA).toPandas()
    library = Tokenizer.from_file(TOKENIZER)
    for doc, text in list(texts.items())[:50]:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = found[found.doc_id == doc].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[i : i + 4096].tobytes()) for i in range(0, len(ids), 4096)]
    placed = found.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    fill = found.groupby("sequence_id").length.sum()
    assert fill.max() <= 4096 and len(fill) <= math.ceil(fill.sum() / 4096) + 1


def test_crossover_keeps_every_piece_once():
    lengths = np.sort(np.random.default_rng(1).integers(1, 3000, 300))[::-1]
    island = packing.Island(lengths, 4096, 5)
    child = island.cross(island.start(0.3), island.start(0.3))
    loads = np.bincount(child, lengths)
    assert len(child) == 300 and loads.max() <= 4096 and loads.min() > 0


def test_shards_are_near_equal_and_whole(docs, texts):
    found = sharding.shard_documents(docs, 4).toPandas()
    assert found.groupby(found.doc_id.map(texts)).shard.nunique().max() == 1
    load = found.groupby("shard")["size"].sum()
    assert load.max() - load.min() < 0.01 * load.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in found.groupby("shard").slot)


LINES = [
    (1, "a b c d e f\nfoo bar\na b c d e f"), (2, "a b c d e g\nx"), (3, "a b c d e\n\n"), (6, "a b c d e fg"), (7, "b c d e f q"),
    (8, " a b c d e f"), (9, "ab c d e ff " * 300), (10, "ab c d e ff " * 299 + "ab c d e fx "),
    (11, ("ab c d e ff " * 300)[:700] + ("ab c d e ff " * 300)[701:]), (12, "ab c d e ff " * 300 + "z"),
    (13, "é b c d e f"), (14, "ab c d e ff " * 300 + "zz"),
]


def test_lines_within_one_edit_of_an_earlier_one_go(spark):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    first = {}
    for doc, text in LINES:
        for at, line in enumerate(text.split("\n")):
            if len(line.split()) >= 5:
                first.setdefault(line, (doc, at))
    expected = {}
    for doc, text in LINES:
        gone = {at for at, line in enumerate(text.split("\n")) if line in first
                and (first[line] != (doc, at) or any(near(line, o) and p < first[line] for o, p in first.items()))}
        expected[doc] = "\n".join(x for at, x in enumerate(text.split("\n")) if at not in gone)
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == expected


def test_classes_equal_brute_force(spark, docs):
    base = [f"w{i}" for i in range(60)]
    draw = random.Random(5)
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = f"v{draw.randrange(9)}"
        rows.append((1000 + i, " ".join(words[: draw.choice((60, 60, 55, 30))])))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {r.doc_id: set(shingles(r.text or "")) for r in df.collect()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.ngram_classes(df).collect()}
    assert found == {d: (len(s), find(d)) for d, s in sets.items()}


def test_tiles_of_mixed_sizes_lose_no_pair():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(pool[draw.integers(0, 400, k)]) for k in draw.integers(1, 900, 300)]
    order = sorted(range(300), key=lambda i: len(sets[i]))
    n, bits = np.array([len(sets[i]) for i in order]), [jaccard_join.bitmap(sets[i]) for i in order]
    tiles = jaccard_join._bands([len(b) for b in bits])
    found = set()
    for at, own in enumerate(tiles):
        for other in tiles[at:]:
            a, b = jaccard_join._tile(n, np.arange(300), bits, own, other, own is other, 80)
            found |= set(zip(a.tolist(), b.tolist()))
    for i in range(300):
        for j in range(i + 1, 300):
            both = len(np.intersect1d(sets[order[i]], sets[order[j]]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (i, j) in found


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (60, 61), (61, 60)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {60: 60, 61: 60}


def test_vector_links_reach_the_recall(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 32))
    x = np.concatenate([c + draw.normal(size=(15, 32)) * 0.3 for c in centres] + [draw.normal(size=(300, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = vectors.near_vectors(df).toPandas().sort_values("vec_id")
    assert (found.n_links.to_numpy() <= true).all()
    assert found.n_links.sum() >= 0.9 * true.sum() > 0


def test_elias_fano_round_trip():
    for values in ([0], [0, 0, 5, 5, 9000], np.cumsum(np.random.default_rng(0).integers(0, 900, 5000))):
        values = np.asarray(values)
        assert (decode_at(encode_monotone(values), np.arange(len(values))) == values).all()


def test_language_model_equals_exact_discounting(spark, texts):
    found = QUERIES["op6_ngram_lm"](spark, DATA).collect()
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    counts, total, kinds = (collections.Counter() for _ in range(3))
    for doc, own in tokens.items():
        if zlib.crc32(str(doc).encode()) % 10:
            for k in (1, 2, 3):
                counts.update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    for gram, n in counts.items():
        if len(gram) > 1:
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
    size = sum(n for g, n in counts.items() if len(g) == 1)
    kept = sum(len(g) == 1 for g in counts)
    for row in found:
        own, base, score = tokens[row.doc_id], 0.0, 0.0
        for i, word in enumerate(own):
            p = (counts[(word,)] + 0.1) / (size + 0.1 * (kept + 1))
            base += math.log10(p)
            for k in (1, 2):
                context = tuple(own[i - k : i])
                if i >= k and total[context]:
                    p = (max(counts[(*context, word)] - 0.75, 0) + 0.75 * kinds[context] * p) / total[context]
            score += math.log10(p)
        assert row.train_tokens == size and row.n_tokens == len(own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert abs(row.score - score) <= 0.015 * len(own)  # quantised to 7 / 255 in log10


def test_quality_is_learnt(spark):
    scored = QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = scored.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held >= 0.95


def test_fingerprints_estimate_generalised_jaccard(docs, texts):
    found = fingerprints.fingerprint_documents(docs).toPandas().set_index("doc_id")
    order = sorted(texts, reverse=True)
    errors = []
    for doc, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = texts[doc], texts[after]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert found.edited_sha256[doc] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(found.near_edited[doc] - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_mixing_meets_targets(spark):
    draw = random.Random(6)
    rows = [(i, s, int(draw.lognormvariate(5, 1))) for i, s in enumerate(draw.choices(["a", "b", "c", "d", None], [9, 3, 3, 1, 1], k=3000))]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    totals = found.fillna({"source": "~"}).groupby("source").agg(own=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weights = dict(zip(sorted(totals.index), (5, 2, 1, 5, 2)))
    targets, left = {}, 1.5 * totals.own.sum()
    while True:
        open_ = {s: w for s, w in weights.items() if s not in targets}
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * totals.own[s]]
        if not over:
            targets |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            targets[s] = 2.0 * totals.own[s]
            left -= targets[s]
    for s, target in targets.items():
        assert totals.target[s] == pytest.approx(target)
        assert abs(totals.taken[s] - target) <= found["size"].max()
    assert (found.taken <= 2 * found["size"]).all()
