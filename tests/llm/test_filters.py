import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, cluttered, nothing
from tillmark.llm import licences, perplexity, toxicity
from tillmark.llm.mixing import mix, one_period, source_shares

LABELS = "doc_id long, quality int, toxic int"
WORDS = ["river", "mountain", "quiet", "garden", "walks", "under", "light", "morning", "the", "and", "over", "stone"]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose, junk, and abuse; the first 400 ids are labelled."""
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        kind = i % 10
        text = prose(rng, rng.randint(20, 60))
        if kind == 0:
            text = " | ".join("".join(rng.choices("qxzjk#%&", k=6)) for _ in range(40))
        elif kind == 1:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "wretched", "vermintail"]))
            text = " ".join(words)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i < 400:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, LABELS), docs)


# ---- quality ------------------------------------------------------------------------


def test_junk_goes_and_prose_stays(spark, corpus):
    docs, labels, rows = corpus
    kept = {r["doc_id"] for r in perplexity.quality(docs, labels).where("lm_keep").collect()}
    junk = {i for i, *_ in rows if i % 10 == 0}
    prose_ids = {i for i, *_ in rows if i % 10 > 1}
    assert not kept & junk
    assert len(kept & prose_ids) >= 0.97 * len(prose_ids)


def test_shards_do_not_change_costs(spark, corpus):
    docs, _, _ = corpus
    table = perplexity.model(perplexity.counted(docs.where("doc_id < 50"))).persist()
    one = perplexity.with_costs(docs.select("doc_id", "text"), perplexity.sent(table, 10**9))
    many = perplexity.sent(table, 500)
    assert len(many) > 3
    both = one.join(perplexity.with_costs(docs.select("doc_id", "text"), many).select("doc_id", F.col("lm_cost").alias("other")), "doc_id")
    assert both.where("abs(lm_cost - other) > 1e-6").count() == 0


def test_large_models_are_joined_not_broadcast(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    docs = docs.unionByName(awkward(spark))
    want = sorted(map(str, perplexity.quality(docs, labels).select("doc_id", F.round("lm_perplexity", 6), "lm_keep").collect()))
    monkeypatch.setattr(perplexity, "sent", None)  # nothing may pass through the driver
    out = perplexity.quality(cluttered(docs), labels, shard_rows=500)
    assert out.columns == [*cluttered(docs).columns, "lm_perplexity", "lm_limit", "lm_keep"]
    assert sorted(map(str, out.select("doc_id", F.round("lm_perplexity", 6), "lm_keep").collect())) == want


def test_probabilities_equal_brute_force_and_add_up(spark):
    text = "abracadabra abra cadabra"
    docs = spark.createDataFrame([(text,)], "text string")
    (shard,) = perplexity.sharded(perplexity.model(perplexity.counted(docs)), 10**9)
    order = perplexity.ORDER
    padded = "\0" * (order - 1) + text
    tables = {order: {}}
    for i in range(len(text)):
        gram = padded[i : i + order]
        tables[order][gram] = tables[order].get(gram, 0) + 1
    for n in range(order - 1, 0, -1):
        tables[n] = {}
        for gram in tables[n + 1]:
            tables[n][gram[1:]] = tables[n].get(gram[1:], 0) + 1

    def discount(n, count):
        ones = [sum(c == k for c in tables[n].values()) for k in range(1, 5)]
        y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.5
        raw = [1 - 2 * y * ones[1] / ones[0] if ones[0] else 0.5, 2 - 3 * y * ones[2] / ones[1] if ones[1] else 1.0,
               3 - 4 * y * ones[3] / ones[2] if ones[2] else 1.5]
        k = min(count, 3) - 1
        return min(max(raw[k], 0.05), k + 0.95)

    def p(gram):
        if not gram:
            return 1 / (len(tables[1]) + 1)
        own = {g: c for g, c in tables[len(gram)].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        rest = sum(discount(len(gram), c) for c in own.values()) / sum(own.values())
        c = own.get(gram, 0)
        return ((c - discount(len(gram), c)) / sum(own.values()) if c else 0) + rest * p(gram[1:])

    for probe in (text, "cab", "zebra abra"):
        want = -sum(math.log(p(("\0" * (order - 1) + probe)[i : i + order])) for i in range(len(probe)))
        assert math.isclose(shard.costs([probe])[0][0], want, rel_tol=1e-9)
    symbols = [*{g for g in tables[1]}, "?"]
    assert math.isclose(sum(p("abra"[:order - 1] + s) for s in symbols), 1.0, rel_tol=1e-9)


def test_quality_of_awkward_rows(spark, corpus):
    _, labels, _ = corpus
    docs = cluttered(awkward(spark))
    out = perplexity.quality(docs, spark.createDataFrame([], LABELS))
    assert out.where("lm_keep").count() == docs.count()
    few = perplexity.quality(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, 1, None)], LABELS))
    assert few.count() == docs.count() and few.where("lm_keep IS NULL").count() == 0
    assert perplexity.quality(nothing(spark), labels).count() == 0


# ---- toxicity -----------------------------------------------------------------------


def within(term, word, edits):
    row = list(range(len(term) + 1))
    for i, c in enumerate(word, 1):
        new = [i]
        for j, d in enumerate(term, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1] <= edits and row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = ["scum\0", "idiot\0", "worthless\0", "lowei", "trash\0"]
    automaton = toxicity.Automaton(terms)
    words = ["scum", "scun", "idiot", "idot", "idiott", "1diot", "worthles", "wortless", "wrthles", "loweischaft", "lowe", "lovei", "trash", "thrash", "rash", "x"]
    for _ in range(300):
        word = list(rng.choice(terms).rstrip("\0"))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choices("abcdeilost", k=rng.randint(0, 1))
        words.append("".join(word) or "a")
    for word in words:
        low = toxicity.folded(word)
        points, begin, end = toxicity.spans(low)
        _, _, edits = automaton.match(points, begin, end)
        best = None
        for term in terms:
            letters = term.rstrip("\0")
            limit = toxicity.allowed_edits(len(letters))
            ends = [low] if term.endswith("\0") else [low[:n] for n in range(len(low) + 1)]
            for part in ends:
                d = within(letters, part, limit)
                if d is not False and (best is None or d < best):
                    best = d
        assert (int(edits[0]) if len(edits) else None) == best, word


def test_toxic_texts_are_found_misspelled_ones_too(spark, corpus):
    docs, labels, rows = corpus
    model = toxicity.learn(docs, labels)
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    toxic = [i for i, *_ in rows if i % 10 == 1 and i >= 400]
    assert sum(scores[i] >= 0.7 for i in toxic) >= 0.9 * len(toxic)
    assert not any(scores[i] >= 0.7 for i, *_ in rows if i % 10 > 1)
    plain, twisted, said, none = model.scores(
        ["the idiot walks", "the 1diiot walks, wretchd stone", "the garden. “idiot” he wrote", "the garden walks"])
    assert plain >= 0.7 and twisted >= 0.7 and said < plain and none < 0.3


def invented_words(n):
    rng = random.Random(5)
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_several_automata_equal_one():
    rng = random.Random(6)
    terms = sorted({w + rng.choice(["", "\0"]) for w in invented_words(12)})
    words = [*invented_words(12), *(w[1:] + "s" for w in invented_words(12)), *invented_words(60), "x" * 200]
    text = " ".join(words)
    one, many = toxicity.Automaton(terms), toxicity.Automata(terms, group=3)
    assert len(many.parts) > 2
    for a, b in zip(one.match(*toxicity.spans(text)), many.match(*toxicity.spans(text)), strict=True):
        assert a.tolist() == b.tolist()


def test_no_significant_term_is_cut_off():
    words = sorted(set(invented_words(400)))
    counts = {w + "\0": 20 + i % 7 for i, w in enumerate(words)}
    assert len(toxicity.chosen_terms(counts, {}, 8000, 12_000, 5000, 0.8)) == len(words) > 300


def test_rich_toxic_vocabulary_is_learned_whole(spark):
    rng = random.Random(7)
    abuse = sorted(set(invented_words(260)))
    docs, labels = [], []
    for i in range(24_000):
        words = prose(rng, 8).split(" ")
        if i % 4 == 1:
            words.insert(4, abuse[i // 4 % len(abuse)])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 1)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = toxicity.learn(table, spark.createDataFrame(labels, LABELS))
    assert len(model.automaton.terms) > 150
    scores = model.scores([f"the garden {word} walks" for word in abuse])
    assert (scores >= 0.7).mean() >= 0.95
    assert model.scores(["the garden walks"])[0] < 0.5


def test_toxicity_of_awkward_rows(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.learn(docs, labels)
    odd = cluttered(awkward(spark))
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    assert toxicity.score(nothing(spark), model).count() == 0
    bare = toxicity.learn(docs, spark.createDataFrame([], LABELS))
    assert toxicity.score(docs, bare).where("toxicity >= 0.7").count() == 0


# ---- mixing -------------------------------------------------------------------------


def test_schedule_is_earliest_deadline_first(spark):
    sizes = spark.createDataFrame([("sa", 500), ("sb", 300), ("sc", 7), ("null", 120)], "mix_key string, rows long")
    shares = source_shares(sizes, 50, 0.85, None)
    e = {r["mix_key"]: r["e"] for r in shares.collect()}
    assert sum(e.values()) == 50 and min(e.values()) >= 1
    got = {r["slot"]: r["mix_key"] for r in one_period(shares, 50).collect()}
    used, order = dict.fromkeys(e, 0), sorted(e)
    for t in range(50):
        released = [k for k in order if used[k] * 50 // e[k] <= t]
        pick = min(released, key=lambda k: (-(-(used[k] + 1) * 50 // e[k]), order.index(k)))
        assert got[t] == pick
        used[pick] += 1
        for k in e:
            assert abs(used[k] - (t + 1) * e[k] / 50) < 1


def test_every_row_is_mixed_in_at_its_weight(spark):
    rows = [(i, "hot" if i < 900 else "b" if i < 1200 else None if i < 1230 else "") for i in range(1250)]
    docs = cluttered(spark.createDataFrame(rows, "doc_id long, source string"))
    out = mix(docs, block_rows=8, resolution=100, bucket_rows=100)
    assert out.columns == [*docs.columns, "mix_slot", "mix_epoch", "mix_position"]
    got = out.collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert len({r["mix_position"] for r in got}) == len(got)
    owner = {}
    for r in got:
        assert owner.setdefault(r["mix_slot"], r["source"]) == r["source"]
    slots = max(owner) + 1
    assert len(owner) == slots  # no slot stays empty
    shares = {}
    for source in owner.values():
        shares[source] = shares.get(source, 0) + 1
    seen = dict.fromkeys(shares, 0)
    for t in range(slots):
        seen[owner[t]] += 1
        assert all(abs(seen[s] - (t + 1) * shares[s] / slots) < 2 for s in shares)
    epochs = {}
    for r in got:
        epochs[r["source"]] = max(r["mix_epoch"], epochs.get(r["source"], 0))
    assert min(epochs.values()) == 0  # the source that lasts longest ends the mix


@pytest.mark.parametrize("large, small", [((10, 1_000_000), (150, 1000)), ((10, 1_000_000), (300, 1000)),
                                          ((30, 200_000), (400, 100))])
def test_excess_slots_are_taken_in_proportion(spark, large, small):
    sizes = spark.createDataFrame([("shot", 3_000_000)] + [(f"s{n}-{i}", n) for k, n in (large, small) for i in range(k)],
                                  "mix_key string, rows long")
    shares = {r["mix_key"]: r for r in source_shares(sizes, 1000, 0.85, None).collect()}
    assert sum(r["e"] for r in shares.values()) == 1000
    assert {r["e"] for r in shares.values() if r["rows"] == small[1]} == {1}
    e = [r["e"] for r in shares.values() if r["rows"] == large[1]]
    assert max(e) - min(e) <= 1 and min(e) >= 1
    wanted = (3_000_000 / large[1]) ** 0.85
    assert abs(shares["shot"]["e"] - 1 - wanted * (sum(e) / len(e) - 1)) <= wanted + 1


def test_long_tail_of_sources_keeps_every_row(spark):
    rows = [(i, f"big{i % 10}") for i in range(3000)] + [(3000 + i, f"small{i // 2}") for i in range(600)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, resolution=100).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    slots = [r["mix_slot"] for r in out]
    assert len(set(slots)) == len(slots) == max(slots) + 1
    period = 10 * 310
    first = [r["source"] for r in out if r["mix_slot"] < period]
    assert {first.count(f"small{i}") for i in range(300)} <= set(range(1, period // 310))
    assert min(first.count(f"big{i}") for i in range(10)) > 100


def test_mixing_of_awkward_rows(spark):
    docs = awkward(spark)
    assert mix(docs).where("mix_epoch = 0").count() == docs.count()
    assert mix(nothing(spark)).count() == 0
    weighted = mix(docs, weights={"a": 0.9, "b": 0.1})
    assert weighted.where("mix_epoch = 0").count() == docs.count()
    with pytest.raises(ValueError):
        mix(docs.withColumn("mix_slot", F.lit(1)))


# ---- licences -----------------------------------------------------------------------


def test_notices_are_found_and_unknown_ones_told_apart(spark, corpus):
    docs, _, _ = corpus
    model = licences.train(docs.select("doc_id", "text"), sample_docs=200)
    rows = [(1, "Some prose.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "river stone garden"),
            (4, "Licensed under the Eclipse Public License.\nLicensed under the Apache License, Version 2.0."), (5, None), (6, ""),
            (7, "All rights reserved.\nAll rights reserved."), (7, "All rights reserved.\nAll rights reserved."),
            (8, "This work is licensed under the GNU General Public License, version 3.")]
    out = licences.scan(cluttered(spark.createDataFrame(rows, "doc_id long, text string")), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 8
    assert got[1]["families"] == ["MIT"] and got[2]["families"] == ["CC-BY-NC"] and got[8]["families"] == ["GPL"]
    assert got[4]["families"] == ["Apache-2.0"] and got[4]["n_unknown"] == 1 and got[4]["n_notices"] == 2
    assert got[7]["families"] == ["proprietary"]
    for i in (3, 5, 6):
        assert got[i]["families"] == [] and got[i]["n_notices"] == 0 and got[i]["best_probability"] is None
    assert licences.scan(nothing(spark), model).count() == 0
