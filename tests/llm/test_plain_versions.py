"""Sharding with many groups a parcel, classifier scores and fingerprints against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelgauge.llm import fingerprints, quality, sharding
from reelgauge.llm.shipping import ship

DATA = "/root/testdata/sf0.001"


def test_parcels_of_several_groups_stay_whole_and_even(spark, monkeypatch):
    """2,000 small groups in 40 parcels, one group that is larger than a shard's share."""
    ship(spark)
    monkeypatch.setattr(sharding, "GRAINS", 8)
    rng = np.random.default_rng(3)
    rows = [(i, f"text {i % 2000} " + "x" * int(rng.zipf(2.0) % 40)) for i in range(3_000)]
    rows += [(10_000 + i, "hot group " * 8) for i in range(900)] + [(None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.shard_documents(docs, shards=5).collect()
    assert len(found) == len(rows)
    of_text, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in found:
        of_text[(r.text_crc32, r.size)].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(shards) == 1 for shards in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, hot = sum(load.values()), 900 * (80 + 16)
    others = sorted(load.values())[:-1]
    assert max(load.values()) >= hot > total / 5  # it cannot be split
    grain = total / (5 * 8)
    assert max(others) - min(others) <= 2 * grain


def test_scores_match_a_plain_discriminant(spark):
    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    measured = quality.document_statistics(docs)
    known = quality.labelled_statistics(measured, labels, lambda doc: ~quality.held_out(doc))
    model = quality.fit_discriminant(known)
    scores = {r.doc_id: r.score for r in quality.score_statistics(measured, model).collect()}

    x = {r.doc_id: np.array(r.x) for r in measured.collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    taught = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in x and not held[r.doc_id] and r.quality in (0, 1)]
    means, covs, counts = [], [], []
    for c in (0, 1):
        own = np.array([x[d] for d, label in taught if label == c])
        means.append(own.mean(axis=0))
        covs.append(np.cov(own.T, bias=True))
        counts.append(len(own))
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    ridge = np.diag(np.diag(pooled) + 1e-6)
    logs = []
    for c in (0, 1):
        s = (1 - quality.SHRINK_POOLED) * covs[c] + quality.SHRINK_POOLED * pooled
        s = (1 - quality.SHRINK_RIDGE) * s + quality.SHRINK_RIDGE * ridge
        inverse, (_, log_det) = np.linalg.inv(s), np.linalg.slogdet(s)
        logs.append({d: -0.5 * (v - means[c]) @ inverse @ (v - means[c]) - 0.5 * log_det for d, v in x.items()})
    prior = np.log(counts[1] / counts[0])
    for doc, score in scores.items():
        plain = 1 / (1 + np.exp(-np.clip(logs[1][doc] - logs[0][doc] + prior, -700, 700)))
        assert score == pytest.approx(plain, abs=1e-6)
    none = spark.createDataFrame([(None,)], "doc_id long").select(quality.held_out(F.col("doc_id"))).first()
    assert none[0] is False


def test_fingerprints_have_a_slot_each_and_likeness_is_their_agreement(spark):
    """What is printed tells the likenesses; the edited text's print is that of the text itself."""
    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)

    def cut(print_):
        assert len(print_) == 8 * fingerprints.SLOTS
        return [print_[i : i + 8] for i in range(0, len(print_), 8)]

    def agreement(a, b):
        pairs = [(x, y) for x, y in zip(cut(a), cut(b)) if (x, y) != ("........", "........")]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    edited = []
    for place, doc in enumerate(order):
        after = order[(place + 1) % len(order)]
        third = len(texts[doc]) // 3
        made = texts[doc][: len(texts[doc]) - third] + texts[after][:third]
        row = found[doc]
        assert row.edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
        assert row.near_next == pytest.approx(agreement(row.fingerprint, found[after].fingerprint))
        assert row.near_edited == pytest.approx(agreement(row.fingerprint, row.edited_fingerprint))
        edited.append((doc, made))
    own = fingerprints.fingerprint_documents(spark.createDataFrame(edited, "doc_id long, text string")).collect()
    assert all(r.fingerprint == found[r.doc_id].edited_fingerprint for r in own)
