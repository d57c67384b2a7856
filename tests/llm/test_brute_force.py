"""Operators that SQL can't express against plain Python, written from their definitions."""

import collections
import hashlib
import math
import random
import re

import pytest

from docloom.llm import classifier, licenses
from docloom.llm.queries import op2_license_scan, op10_quality_classifier

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    """Runs of one class: ASCII signs, or letters, digits and all that isn't ASCII; spaces part them."""
    out, kind = [], None
    for c in (text or "").translate(LOWER):
        now = 0 if c in " \t\n\x0b\x0c\r" else 2 if ord(c) < 128 and not c.isalnum() else 1
        if now and now == kind:
            out[-1] += c
        elif now:
            out.append(c)
        kind = now
    return out


def features(text):
    words = tokens(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def buckets_by_the_operator(grams):
    """Only the hashes of uni- and bigrams are taken from the operator; which grams there are is worked out here."""
    import pyarrow as pa

    grams = list(grams)
    code, row = classifier.features(pa.array(grams, pa.string()))
    return {grams[r]: int(c) for c, r in zip(code.tolist(), row.tolist(), strict=True)}  # a bigram comes after its words


def keys_by_hand(docs, labels, recall=0.999, seed=17, sample=classifier.SAMPLE):
    """(log ratio, key) of each document, and the least key that stays."""
    good = sorted({r["doc_id"] for r in labels if r["quality"] == 1 and not r["toxic"] and r["doc_id"] is not None})
    order = classifier_order(good)[:sample]
    held, fitted = set(order[::4]), set(order) - set(order[::4])
    raw, target = collections.Counter(), collections.Counter()
    grams = [features(d["text"]) for d in docs]
    bucket = buckets_by_the_operator(set().union(*grams))
    grams = [[bucket[x] for x in g] for g in grams]
    for d, g in zip(docs, grams, strict=True):
        raw.update(g)
        if d["doc_id"] in fitted:
            target.update(g)
    n_raw, n_target = (sum(c.values()) + classifier.BUCKETS for c in (raw, target))
    weight = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in raw}

    def noise(i):
        u = (int.from_bytes(hashlib.blake2b(f"{seed}|{'null' if i is None else i}".encode(), digest_size=8).digest(), "little") + 0.5) / 2.0**64
        return -math.log(-math.log(u))

    logs = [math.fsum(weight[b] for b in g) for g in grams]
    found = [(log, log + noise(d["doc_id"])) for d, log in zip(docs, logs, strict=True)]
    least_of = {}
    for d, (_, key) in zip(docs, found, strict=True):
        if d["doc_id"] in held:
            least_of[d["doc_id"]] = min(key, least_of.get(d["doc_id"], key))
    reached = sorted(least_of.values())
    return found, reached[int((1 - recall) * len(reached))]


def classifier_order(ids):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    rows = SparkSession.active().createDataFrame([(i,) for i in ids], "i long")
    return [r[0] for r in rows.orderBy(F.xxhash64("i"), "i").collect()]


def test_op10_against_plain_python(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("documents", "labels"))
    expected, least = keys_by_hand(docs, labels)
    got = {r["doc_id"]: r for r in op10_quality_classifier(spark, data).collect()}
    assert got.keys() == {d["doc_id"] for d in docs}
    for d, (log, key) in zip(docs, expected, strict=True):
        r = got[d["doc_id"]]
        assert r["log_weight"] == pytest.approx(log, abs=1e-6) and r["sample_key"] == pytest.approx(key, abs=1e-6)
        assert r["kept"] == (key >= least) or abs(key - least) < 1e-6


def test_op10_with_a_given_k_keeps_ties(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad", "ugly"]) for _ in range(9))) for i in range(60)] + [(i, "the very same") for i in (70, 70, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 30)], "doc_id long, quality int, toxic int")
    scored = classifier.classify(docs, labels).collect()
    keys = sorted((r["sample_key"] for r in scored), reverse=True)
    tied = keys.index(next(r["sample_key"] for r in scored if r["doc_id"] == 70)) + 1
    for k in (1, 5, 30, tied, tied + 1, 63, 64, 1000):
        kept = [r for r in classifier.classify(docs, labels, k=k).collect() if r["kept"]]
        assert sorted(r["sample_key"] for r in kept) == sorted(x for x in keys if k > len(keys) or x >= keys[k - 1])
    assert classifier.keep_sampled(docs, labels, k=7).count() >= 7


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(k) for k in range(1000)], [1e-300, 1.0, 1.0, 1.0000000000000002, 5e300, -5e300]])
def test_kth_largest(spark, values):
    keys = spark.createDataFrame([(v,) for v in values], "v double")
    for k in {1, 2, len(values) // 2 or 1, len(values)}:
        if k <= len(values):
            assert classifier.kth_largest(keys, "v", k) == sorted(values, reverse=True)[k - 1]
    assert classifier.kth_largest(keys, "v", len(values) + 1) == float("-inf")


def spans_by_hand(text, scanner):
    """Matching statistics by trying every length, pieces by searching every template, chains as they are defined."""
    words = licenses.words_of(text)
    sequences = [licenses.words_of(t) for t in [*licenses.PHRASES, *licenses.TEMPLATES.values()]]
    own = list(enumerate(sequences))[scanner.n_phrases :]
    at = lambda part, seq: [s for s in range(len(seq) - len(part) + 1) if seq[s : s + len(part)] == part]
    size = []
    for end in range(len(words)):
        longest = 0
        while longest <= end and longest <= (size[-1] if size else 0) and any(at(words[end - longest : end + 1], s) for s in sequences):
            longest += 1
        size.append(longest)
    maximal = [(k, n) for k, n in enumerate(size) if n >= scanner.least and (k + 1 == len(size) or size[k + 1] <= n)]
    out = []
    for k, seq in own:
        pieces = sorted((e - n + 1, s, n) for e, n in maximal for s in at(words[e - n + 1 : e + 1], seq))
        chains = []
        for p in pieces:
            for chain in reversed(chains):
                skipped = p[0] - chain[-1][0] - chain[-1][2]
                if 0 <= skipped <= scanner.gap and p[1] >= chain[-1][1] + chain[-1][2]:
                    chain.append(p)
                    break
                if skipped > scanner.gap:
                    chains.append([p])
                    break
            else:
                chains.append([p])
        for chain in chains:
            share = sum(p[2] for p in chain) / len(seq)
            if share >= scanner.cover:
                out.append((scanner.labels[k], chain[0][0], chain[-1][0] + chain[-1][2] - 1, min(1.0, share)))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def test_op2_spans_against_plain_python():
    """Templates whole, cut, with words dropped, put in and repeated, beside one another."""
    rng, scanner = random.Random(8), licenses.Scanner()
    templates = [t.split() for t in licenses.TEMPLATES.values()]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = list(rng.choice(templates))
            t = t[rng.randrange(4) : len(t) - rng.randrange(4)]
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(2)] = [rng.choice(["word", "license", "the", "see"])] * rng.randrange(3)
            words += t + ["filler"] * rng.choice([0, 3, 20])
        text = " ".join(words)
        found = scanner.scan(text)
        assert found["spans"] == spans_by_hand(text, scanner)
        base = {label for p, label in licenses.PHRASES.items() if f" {p} " in f" {' '.join(licenses.words_of(text))} "}
        assert found["labels"] == ",".join(sorted(base | {s[0] for s in found["spans"]}))
        assert found["score"] == max([1.0 if base else 0.0, *(s[3] for s in found["spans"])])


def test_op2_query_labels_against_plain_python(spark, data):
    scanner = licenses.Scanner()
    hint = re.compile("permission|licen[cs]e|redistribution|software", re.I)
    got = {r["doc_id"]: r for r in op2_license_scan(spark, data).collect()}
    docs = [d for d in spark.read.parquet(f"{data}/documents.parquet").collect() if hint.search(d["text"] or "")]
    for d in docs:
        if len(d["text"]) < 4000:
            spans = spans_by_hand(d["text"], scanner)
            assert set(got[d["doc_id"]]["labels"].split(",")) - {""} == {s[0] for s in spans} | (set(got[d["doc_id"]]["base_labels"].split(",")) - {""})
