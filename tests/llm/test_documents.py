"""Near duplicates, lines, quality, personal data and the pipeline on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_texts import prose
from orderloom.llm import group_join, pii, quality, shingles, site_lines
from pyspark.sql import functions as F

# ---- shingles and near duplicates


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_groups(rows):
    """doc_id to (set size, smallest reachable doc_id) by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, n, seed):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def test_shingle_sets_equal_plain_ones():
    draw = random.Random(3)
    texts = ["".join(draw.choice("abAB É\n\t\xa0\x1c漢 ") for _ in range(draw.randrange(60))) for _ in range(400)]
    texts += [None, "", "x" * 2_500_000 + " y z", "a b c d e " * 1000]
    own = list(shingles.shingle_sets(texts))
    plain = [plain_set(t) for t in texts]
    assert [len(s) for s in own] == [len(s) for s in plain]
    for i in range(0, 400, 3):
        for j in range(0, i, 7):
            shared = len(plain[i] & plain[j])
            assert shared == len(np.intersect1d(own[i], own[j]))
            assert shingles.linked(own[i], own[j]) == (
                bool(plain[i] and plain[j]) and 100 * shared >= 80 * (len(plain[i]) + len(plain[j]) - shared)
            )


def duplicate_rows():
    rows, number = [], 0
    for base in range(12):
        text = prose(100 + base, 40 + 25 * base)
        for copy in range(9):
            rows.append((number, text if copy < 2 else edited(text, copy, 50 * base + copy), "s"))
            number += 1
    passage = prose(7, 60)
    rows += [(number + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 30)}", "s") for i in range(40)]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", " \n", "one", "one", "a b c d", "a b c d e", "A B c D", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9"])]
    return rows


@pytest.mark.parametrize("part, bands", [(64, None), (4, None), (4, 1)])
def test_near_duplicates_equal_all_pairs(make_docs, monkeypatch, part, bands):
    monkeypatch.setattr(group_join, "PART", part)
    monkeypatch.setattr(group_join, "SALTED", 5)
    if bands:  # hardly any likeness is seen, so that the matrix has to find the links
        monkeypatch.setattr(group_join, "ALIKE", 23)
    rows = duplicate_rows()
    found = group_join.near_duplicate_groups(make_docs(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_groups([(i, t) for i, t, _ in rows])
    assert len(found) == len(rows)


def test_near_duplicates_with_odd_rows(odd_docs, make_docs):
    found = group_join.near_duplicate_groups(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[9].component_id == 9 and by_id[10].component_id == 9
    assert by_id[0].n_shingles == 0 and by_id[0].component_id == 0
    assert {(r.n_shingles, r.component_id) for r in found if r.doc_id is None} == {(46, None), (0, None)}
    assert group_join.near_duplicate_groups(make_docs([])).count() == 0


def test_frequent_tokens_only_change_the_order():
    tokens = np.sort(np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64))
    bitmap = np.zeros(group_join.BITS // 8, dtype=np.uint8)
    assert group_join.prefix(tokens, bitmap).tolist() == tokens[:21].tolist()
    late = (tokens[:50] >> np.uint64(37)).astype(np.int64)
    np.bitwise_or.at(bitmap, late >> 3, np.left_shift(1, late & 7).astype(np.uint8))
    assert group_join.prefix(tokens, bitmap).tolist() == tokens[50:71].tolist()


# ---- lines


def line_rows():
    rows = []
    for i in range(60):
        lines = [prose(500 + i, 5), "  Share this page ", "", prose(600 + i // 4, 4)]
        if i % 3 == 0:
            lines.append("Share this page\r")
        rows.append((i, "\n".join(lines), "a" if i < 50 else None if i < 55 else ""))
    return [*rows, (60, None, "a"), (61, "", "a"), (62, "Share this page", "a"), (62, "Share this page", "a"), (None, "x\n\ny", "b")]


def test_lines_equal_sql_and_meaning(make_docs):
    docs = make_docs(line_rows())
    found = site_lines.cleaned_documents(docs)
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text", "source").toPandas())
    wanted = connection.execute(f"select doc_id, n_lines, n_dropped, text from ({site_lines.SQL})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[0].text == "\n".join([prose(500, 5), "", prose(600, 4)]) and by_id[0].n_dropped == 2
    assert by_id[61].text == "" and by_id[60].text is None and by_id[62].text == ""
    assert by_id[None].text == "x\n\ny"
    assert site_lines.cleaned_documents(make_docs([])).count() == 0


def test_small_sites_lose_their_boilerplate(make_docs):
    rows = [(i, f"own {i}\nFollow us" if i < 4 else f"own {i}", "small") for i in range(10)]
    rows += [(20 + i, "a copy\nof a page" if i < 2 else f"page {i}", "copies") for i in range(10)]
    found = {r.doc_id: r for r in site_lines.cleaned_documents(make_docs(rows)).collect()}
    assert all(r.n_dropped == (i < 4) for i, r in found.items()) and found[20].text == "a copy\nof a page"


def test_lines_keep_all_columns(odd_docs):
    kept = site_lines.drop_boilerplate(odd_docs)
    assert kept.select("row.*").columns == odd_docs.columns
    assert kept.count() == odd_docs.count()


def test_no_python_for_lines(make_docs):
    plan = site_lines.cleaned_documents(make_docs(line_rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- quality


def graded(n):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 60)
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in text.split()), "spam " * 60][i % 3]
        rows.append((i, text, "s"))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rows, labels = graded(600)
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    scored = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(scored) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    aside = {i: r for i, r in scored.items() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.held_out == (i in aside) for i, r in scored.items())
    right = [r.predicted == (i % 4 != 0) for i, r in aside.items()]
    assert sum(right) / len(right) >= 0.95


def test_held_out_labels_change_nothing(labelled, spark):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality_scores(docs, labels).collect()) == sorted(quality.quality_scores(docs, turned).collect())


def test_quality_of_odd_rows(odd_docs, make_docs, labelled, spark):
    labels = labelled[1]
    scored = quality.quality_scores(odd_docs, labels).collect()
    assert len(scored) == odd_docs.count() and all(r.score is not None for r in scored)
    assert len({r.score for r in scored if r.doc_id in (0, 1, 2)}) == 1
    assert quality.quality_scores(make_docs([]), labels).count() == 0
    assert quality.quality_scores(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.quality_scores(odd_docs, labels.where("quality = 1")).count() == odd_docs.count()


def test_shapes():
    assert [quality.shape(w) for w in ("EDTH!!", "Thre***", "abc", "12", "|")] == ["X!!", "Xx**", "x", "9", "|"]


def test_all_of_an_unspaced_text_counts(labelled):
    """A long start without white space does not decide what the rest says."""
    docs, labels = labelled
    model = quality.fit_on_labels(docs, labels)
    start = "qqqqqqq1" * 5
    ends = [model.pooled(start + tail) for tail in ("abcdefg1" * 400, "ABCDE1!!" * 400)]
    assert np.abs(ends[0] - ends[1]).max() > 0.1
    assert quality.words_of(f"ab {'x' * 33} c") == ["ab", *["x" * 8] * 4, "x", "c"]
    assert quality.words_of("") == []


def test_a_repeated_labelled_document_is_fitted_once(labelled, spark, make_docs):
    docs, labels = labelled
    many = docs.unionByName(spark.range(10_000).join(docs.where("doc_id = 1")).drop("id").select(docs.columns))
    plain, repeated = (quality.fit_on_labels(d, labels) for d in (docs, many))
    assert np.array_equal(plain.vectors, repeated.vectors) and plain.temperature == repeated.temperature


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])

    def check(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and check(digits(m))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_plain_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice("12345678900..  @@-+()ab%\n") for _ in range(draw.randrange(60)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain_spans(text)


PRIVATE = [
    "write to anna.b@mail.example.com or +1 (988) 555-2485 today",
    "server 10.2.30.4 failed, not 10.2.30.400 or 1.2.3",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112",
    "order 12345 of 2024 with 17 parts",
] * 10


def test_field_adds_repeats_and_leaves_plain_numbers():
    field = pii.SkipChainField.fit(PRIVATE)
    text = "call +1 (988) 555-2485 now. later 555-2485 again; order 12345 of 2024"
    added = field.added(text, pii.base_spans(text))
    assert [text[s.start : s.end] for s in added] == ["555-2485"] and added[0].kind == 3
    assert field.added("order 12345 of 2024", []) == []
    assert pii.redact(text, field) == "call <PHONE> now. later <PHONE> again; order 12345 of 2024"


def test_marginals_are_exact_on_a_chain():
    """On a tree, message passing gives the marginals that summing over all labellings gives."""
    draw = np.random.default_rng(5)
    field = pii.SkipChainField(draw.normal(size=(pii.N_FEATURES, pii.LABELS)), draw.normal(size=(2, pii.LABELS, pii.LABELS)))
    field.potentials = field.potentials + field.potentials.transpose(0, 2, 1)
    rows = draw.normal(size=(3, pii.N_FEATURES))
    unary = rows @ field.weights
    total = unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :]
    total = total + field.potentials[0][:, :, None] + field.potentials[1][None]
    chance = np.exp(total - total.max())
    chance /= chance.sum()
    wanted = [chance.sum(axis=(1, 2)), chance.sum(axis=(0, 2)), chance.sum(axis=(0, 1))]
    got = field.marginals(rows, np.array([[0, 1, 0], [1, 2, 1]]))
    assert np.allclose(got, wanted, atol=1e-3)


def test_personal_data_query(make_docs, odd_docs):
    docs = make_docs([(i, t, "s") for i, t in enumerate(PRIVATE)]).unionByName(odd_docs)
    found = pii.span_report(pii.find_spans(docs)).collect()
    assert len(found) == docs.count()
    texts = defaultdict(list)
    for row in docs.collect():
        texts[row.doc_id].append(row.text or "")
    wanted = Counter()
    for doc_id, own in texts.items():
        for text in own:
            base = sorted(plain_spans(text))
            counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
            wanted[(doc_id, *counts, pii.digest([pii.Span(*s) for s in base]))] += 1
    assert Counter(tuple(r)[:6] for r in found) == wanted
    assert all(f"phone:{PRIVATE[0].index('+')}" in r.spans for r in found if r.n_phone)
    assert pii.span_report(pii.find_spans(make_docs([]))).count() == 0


def test_long_texts_take_linear_time():
    field = pii.SkipChainField.fit(PRIVATE)
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+(" * 100_000, "a@b.c " * 20_000, "1." * 100_000):
        field.added(text, pii.base_spans(text))


# ---- pipeline


def test_pipeline_stages(spark, make_docs, labelled, tmp_path):
    import corpus_pipeline
    from test_tokens import check_packing

    rows, labels = graded(120)
    rows = [(i, f"Share this page\n{t}\nmail me@x{i}.example.com", "a") for i, t, _ in rows]
    rows += [(1000 + i, t, "a") for i, (_, t, _) in enumerate(rows[1:120:3])]
    rows += [(2000, None, None), (2001, rows[1][1], "a"), (2001, rows[1][1], "a"), (None, rows[2][1], "a")]
    documents = make_docs(rows)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "personal_data", "packing"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), documents.schema)
        assert docs.columns == documents.columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[name].values())
        assert all(r.spans == "spans" for r in kept[name].values())
    good = {i for i in range(120) if i % 4}
    assert set(kept["quality"]) & set(range(120)) == good
    assert not any("Share this" in (r.text or "") for r in kept["lines"].values())
    stayed = set(kept["near_duplicates"])
    assert good <= stayed and not any(i is not None and 1000 <= i < 2000 for i in stayed) and 2001 not in stayed
    assert all(r.text is None or "<EMAIL>" in r.text for i, r in kept["personal_data"].items() if i in good)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == stayed
    check_packing(pieces)


def test_pipeline_of_an_empty_table(spark, make_docs, labelled):
    import corpus_pipeline

    docs = make_docs([])
    assert corpus_pipeline.keep_one_of_group(spark, docs, "").count() == 0
    assert corpus_pipeline.drop_lines(spark, docs, "").count() == 0
    assert corpus_pipeline.hide_personal_data(spark, docs, "").count() == 0
    assert corpus_pipeline.pack(spark, docs, "").count() == 0
