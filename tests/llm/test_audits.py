"""Collocations, toxicity and the filter audit against brute force, and on odd rows."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from llm_texts import ODD_TEXTS, prose
from orderloom.llm import collocations, filter_audit, toxicity
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def phrases_by_hand(rows, least, top):
    """The contract's phrases, word by word."""
    counts, totals = {}, Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)} | {c: "\n" for c in ".,;:!?\n\x0b\x0c\r"})
    for lang, text in rows:
        own = counts.setdefault(lang, Counter())
        for piece in (text or "").translate(lower).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in counts.items():
        found = {g: n for g, n in own.items() if len(g) > 1 and n >= least}
        ranked = []
        for g, a in found.items():
            if len(g) == 2 and any(len(h) == 3 and g in (h[:2], h[1:]) and 100 * n >= 50 * a for h, n in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def chatter():
    draw = random.Random(4)
    words = ["a", "b", "cé", "D", "eE", "漢", "x\xa0y", "q"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "! "]
    rows = []
    for i in range(60):
        text = "".join(draw.choice(words[: 3 + i % 6]) + draw.choice(marks) for _ in range(draw.randrange(80)))
        rows.append((i % 50, text, None if i % 7 == 0 else "en" if i % 2 else "fr"))
    return [*rows, (None, None, "en"), (3, "", None), (5, "a b cé " * 3000, "en"), (6, " \t ., ", "xx")]


@pytest.mark.parametrize("bits", [64, 1 << 12, collocations.BITS])
def test_collocations_by_hand(spark, chatter, bits):
    docs = spark.createDataFrame(chatter, "doc_id long, text string, lang string").withColumn("w1", F.lit("clash"))
    counts = {(r.lang, r.w1, r.w2, r.w3): r.n for r in collocations.phrase_counts(docs, 4, bits).collect()}
    found = {tuple(r) for r in collocations.collocations(docs, 4, top=40).collect()}
    by_hand = phrases_by_hand([(lang or "und", text) for _, text, lang in chatter], 4, 40)
    assert found == by_hand
    assert all(counts[(lang, *(phrase.split(" ") + [None])[:3])] == a for lang, _, phrase, a, *_ in by_hand)


def test_collocation_scores_are_exact(spark):
    rows = [(10**15 - 1, 10**15, 10**15 + 7), (999_999_999_999, 10**12, 10**12 + 1), (10, 10, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    found = [r[0] for r in df.select(collocations.exact_score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert found == [1_000_000 * a * a // (left * right) for a, left, right in rows]


def test_bit_table_is_bounded_and_cuts(spark, chatter):
    docs = spark.createDataFrame(chatter, "doc_id long, text string, lang string")
    rows = collocations.windows(docs)
    assert collocations.frequent_pairs(rows, 2, 640).count() <= 10
    cut = collocations.cut_windows(rows, 50)
    assert cut.count() == rows.count()
    assert cut.where("w3 is not null").count() < rows.where("w3 is not null").count()


def test_rare_triples_of_frequent_pairs_are_cut(spark):
    """Such windows were most of what was shuffled; they still count towards their pair."""
    docs = spark.createDataFrame([(1, "a b x. y b c. " * 10 + "a b c.", "en")], "doc_id long, text string, lang string")
    cut = collocations.cut_windows(collocations.windows(docs), 10)
    whole = {(r.w1, r.w2, r.w3): r["count"] for r in cut.where("w3 is not null").groupBy("w1", "w2", "w3").count().collect()}
    assert whole == {("a", "b", "x"): 10, ("y", "b", "c"): 10}
    counts = {(r.w1, r.w2): r.n for r in collocations.phrase_counts(docs, 10).where("size = 2").collect()}
    assert counts[("a", "b")] == 11 and counts[("b", "c")] == 11


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = text.translate(str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        docs.append((lang or "", i, {f for f, failed in fails.items() if failed}))
    out, shapley = {}, Counter()
    for part in {lang for lang, _, _ in docs}:
        own = [(i, fails) for lang, i, fails in docs if lang == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                failing = [fails for _, fails in own if f in fails]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(fails == {f} for fails in failing),
                    sum(i in good for i in gone), sum(i in bad for i in gone),
                )
    return {(*key, *values, shapley[key[0], key[1][key[2] - 1]]) for key, values in out.items()}


def test_filter_audit_by_hand(spark):
    draw = random.Random(9)
    texts = [*ODD_TEXTS[:7], prose(2, 130), prose(2, 130), "SHOUT " * 120, " ".join(f"w{i}" for i in range(150)), "x | y", "Ä" * 9 + "A"]
    rows = [(draw.choice([None, 1, 2, 3, *range(4, 40)]), draw.choice(texts), draw.choice([None, "en", "de", ""])) for _ in range(150)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [*range(30), 3, 3, 7]] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as n", "'x' as digest")
    found = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))
    assert {tuple(r) for r in found.collect()} == audit_by_hand(rows, labels)
    assert found.count() == 3 * 600
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def test_paths_through_the_lattice():
    forward, backward = filter_audit.path_counts(5)
    assert forward[31] == backward[0] == 120
    edges = filter_audit.lattice_edges()
    assert len(edges) == 80 and all(weight == len(orders) for _, _, weight, orders in edges)
    assert sum(len(orders) for *_, orders in edges) == 600


def planted(n, seed, doc_id=0):
    """Prose; a quarter of it with insults, or in another tongue with words of a marked beginning."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(seed * n + i, draw.randrange(20, 200)).split(), i % 4 == 0
        if toxic:
            for _ in range(draw.randrange(2, 6)):
                bad = draw.choice(["idiot", "worthless", "trash"]) if i % 8 else "zorq" + draw.choice(["a", "en", "ito", "ul"])
                words[draw.randrange(len(words))] = bad
        rows.append((doc_id + i, " ".join(words), "s"))
        labels.append((doc_id + i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    rows, labels = planted(900, 3)
    marks = spark.createDataFrame(labels, LABELS)
    docs = make_docs(rows)
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    aside = [(i, toxic) for i, _, toxic in labels if found[i].held_out]
    assert len(found) == 900 and len(aside) > 50
    assert sum(found[i].predicted == toxic for i, toxic in aside) >= 0.97 * len(aside)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    # Held-out labels are not read.
    turned = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, turned).collect()} == {i: r.score for i, r in found.items()}


def test_terms_that_no_clean_text_has_are_sure(spark):
    """A beginning in a seventh of the toxic texts and in no clean one; its words stand behind it."""
    texts = [(f"{prose(i, 30)} zorq{'abcdef'[i % 6]}x", 1) for i in range(36)]
    texts += [(prose(i, 30) + " idiot", 1) for i in range(36, 250)] + [(prose(i, 30), 0) for i in range(250, 500)]
    found = dict(toxicity.telling_terms(spark.createDataFrame(texts, "text string, toxic int")))
    assert found["zorq-"] > 3 and not any(term.startswith("zorq") and term != "zorq-" for term in found)


def test_learnt_lists_have_no_common_words():
    """Words that are sure but only a little likelier would make a list fire on half of the clean texts."""
    lists = toxicity._learnt_lists([("zorq-", 6.2), ("as", 0.34), ("the", -0.5), ("trash", 7.0)])
    assert set().union(*lists.values()) == {"zorq-", "trash"}


def test_toxicity_of_a_marked_minority(spark, make_docs):
    """One toxic text in eight is of another tongue and holds a beginning that no fixed list knows."""
    rows, labels = planted(600, 8)
    for i in range(600, 700):
        words = prose(i, 60).split()
        if i % 5 == 0:
            words[7:7] = [f"vequ{'abcdefgh'[i // 5 % 8]}o", f"vequ{'stuvwxyz'[i // 5 % 8]}a"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(i % 5 == 0)))
    found = {r.doc_id: r for r in toxicity.toxicity_scores(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    clean = sorted(found[i].score for i, _, toxic in labels if not toxic)
    missed = [i for i, _, toxic in labels if toxic and i >= 600 and found[i].score <= clean[len(clean) * 95 // 100]]
    assert missed == []


def test_label_model_finds_rates_and_dependent_voters():
    draw = np.random.default_rng(5)
    n, prior = 200_000, 0.15
    y = draw.random(n) < prior
    toxic, clean = np.array([0.6, 0.5, 0.4, 0.55, 0.3, 0.1]), np.array([0.02, 0.01, 0.05, 0.03, 0.02, 0.1])
    fired = draw.random((n, 6)) < np.where(y[:, None], toxic, clean)
    copied = draw.random(n) < 0.8
    fired = np.column_stack([fired, np.where(copied, fired[:, 0], draw.random(n) < 0.05)]).astype(np.int64)
    model = toxicity.fit_label_model(n, (fired.T @ fired).astype(float), prior, np.full(7, 0.3))
    assert np.abs(model.toxic[1:6] - toxic[1:]).max() < 0.06 and np.abs(model.clean[1:6] - clean[1:]).max() < 0.02
    assert model.parent[6] == 0 or model.parent[0] == 6
    assert model.correlation[0, 6] > 0.3 and np.abs(model.correlation[1:5, 1:5]).max() == 0


def test_toxicity_of_odd_rows(spark, odd_docs, make_docs):
    none = spark.createDataFrame([], LABELS)
    found = toxicity.toxicity_scores(odd_docs, none).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    one_kind = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1)], LABELS)
    assert toxicity.toxicity_scores(odd_docs, one_kind).count() == len(found)
    assert toxicity.toxicity_scores(make_docs([]), none).collect() == []
    insulted = make_docs([(1, "you are an idiot and worthless trash", "s"), (2, prose(1, 40), "s")])
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(insulted, none).collect()}
    assert scores[1] > scores[2]


def test_sample_takes_one_text_of_an_id(spark, make_docs):
    docs = make_docs([(1, prose(i, 30), "s") for i in range(300)] + [(2, "b", "s")])
    sample = toxicity.labelled_sample(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 0), (1, 1, 1)], LABELS), 10)
    assert sorted((r.doc_id, r.toxic) for r in sample.collect()) == [(1, 1), (2, 0)]
