import collections
import re

from docloom.llm import classifier, mixing, quality_rules, unigram
from docloom.llm.queries import op6_quality_rules, op7_mixing, op8_token_counts, op10_quality_classifier, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op6_against_brute_force(spark, data):
    got = {r["doc_id"]: r for r in op6_quality_rules(spark, data).collect()}
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        t = d["text"] or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d["doc_id"]]
        expected = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_hosts_are_judged(spark):
    good = " ".join(f"plain{k}" for k in range(40))
    junk = " ".join(f"{w}***" for w in good.split())
    rows = [(k, good, "clean") for k in range(50)] + [(100 + k, junk, "junk") for k in range(50)] + [(200, good, "junk"), (201, junk, "clean")]
    out = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[k] for k in range(50)) and not any(kept[100 + k] for k in range(50))
    assert not kept[200] and kept[201]


def test_prior_strength():
    assert quality_rules.prior_strength(None, None) == 1.0
    assert quality_rules.prior_strength(0.5, 0.0) == 1.0
    assert abs(quality_rules.prior_strength(0.5, 0.05) - 4.0) < 1e-9
    assert quality_rules.prior_strength(0.2, 1e-9) == 1000.0


def test_targets_fill_to_their_caps(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 0), ("d", 500)]
    out = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    assert abs(sum(out.values()) - 1.5 * 1610) < 1e-6
    assert out["a"] == 200 and out["c"] == 20 and out[None] == 0
    assert out["b"] <= 2000 and out["d"] <= 1000
    assert abs(out["d"] - 1000) < 1e-9 or abs(out["d"] / 3 - out["b"]) < 1e-6


def test_op7_takes_near_its_targets(spark, data):
    got = op7_mixing(spark, data).collect()
    again = op7_mixing(spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken, target, size = collections.Counter(), {}, {}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert abs(sum(taken.values()) - sum(target.values())) < 0.05 * sum(target.values())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


def test_op8_equals_the_tokenizer(spark, data):
    """The library's own unigram model, with the same pieces and scores, counts the same."""
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    plain = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *plain], 0, True))
    got = {r["doc_id"]: r["n_tokens"] for r in op8_token_counts(spark, data).collect()}
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert got[d["doc_id"]] == len(model.encode("▁" + d["text"].replace(" ", "▁")).ids)


def test_viterbi_against_all_segmentations():
    pieces = [("a", -3.0), ("b", -3.0), ("ab", -5.0), ("ba", -6.0), ("aba", -8.0), ("▁", -1.0), ("▁a", -4.0)]
    model = unigram.Unigram(pieces)

    def best(word):
        """(score, tokens) with the tokenizer's rule: of equal scores the longest last piece."""
        table = {0: (0.0, 0)}
        for end in range(1, len(word) + 1):
            found = None
            for begin in range(end):
                part = word[begin:end]
                cost = model.scores.get(part)
                tokens = 1
                if cost is None and len(part) == 1:
                    cost, tokens = model.unknown, len(part.encode())
                if cost is not None and (found is None or table[begin][0] + cost > found[0]):
                    found = (table[begin][0] + cost, table[begin][1] + tokens)
            table[end] = found
        return table[len(word)]

    import itertools

    for n in range(1, 6):
        for word in map("".join, itertools.product("ab▁é", repeat=n)):
            assert model.word(word) == best(word)
    assert model.count("ab a  é") == (best("▁ab")[1] + best("▁a")[1] + best("▁▁é")[1], best("▁ab")[0] + best("▁a")[0] + best("▁▁é")[0])
    assert model.count("") == (0, 0.0) and model.count(None) == (0, 0.0)


def test_op10_on_held_out_labels(spark, data):
    got = {r["doc_id"]: r["kept"] for r in op10_quality_classifier(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    good, bad = ([got[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_gumbel_top_k_follows_importance():
    """Keys with Gumbel noise are drawn in proportion to their weights."""
    wins = collections.Counter()
    for seed in range(4000):
        keys = {k: w + classifier.gumbel(k, seed) for k, w in enumerate((0.0, 1.0))}
        wins[max(keys, key=keys.get)] += 1
    assert abs(wins[1] / 4000 - 2.718281828 / 3.718281828) < 0.03


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"text number {k} of this source", "s") for k in range(600)] + [(7, f"the same id {k}", "t") for k in range(600)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.5)
    for source in "st":
        own = [r for r in out.collect() if r["_c2"] == source]
        assert abs(sum(r["_copies"] * r["_size"] for r in own) - own[0]["_target"]) < 0.1 * own[0]["_target"]
        assert len({r["_copies"] for r in own}) == (1 if own[0]["_target"] == 2 * own[0]["_source_size"] else 2)


def test_long_words_are_counted_but_not_kept():
    model = unigram.Unigram([("a", -3.0), ("ab", -5.0), ("b", -3.5), ("▁", -1.0)])
    word = "▁" + "ab" * 2000 + "c"
    plain = unigram.Unigram([("a", -3.0), ("ab", -5.0), ("b", -3.5), ("▁", -1.0)])
    plain._matches = lambda w: [[m for e, m in plain.automaton.iter(w) if e == end] for end in range(len(w))] if len(w) < 300 else None
    assert model.word("▁" + "ab" * 60) == plain.word("▁" + "ab" * 60)
    assert model.count(word.replace("▁", "")) == (model.word(word)[1], model.word(word)[0])
    assert word not in model._young and word not in model._old
