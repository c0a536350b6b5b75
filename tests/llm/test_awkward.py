"""One table of awkward rows through every operator and the pipeline: nulls, repeats, empties, a long text, ties, clashing columns."""
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import byte_bpe, common, alignment, decontamination, language_model, lexical_search, line_dedup, near_dedup, quality_classifier, quality_rules, secret_scan, sharding, substring_dedup, suffix_dedup

PROSE = " ".join(f"word{k} of a long passage" for k in range(40)) + "."
LONG = " ".join(f"t{k % 5000}" for k in range(400_000))
ROWS = [
    (1, PROSE, "a"), (1, PROSE, "a"), (1, "another text with the same number", "a"), (None, PROSE, None), (None, PROSE, None), (None, None, ""), (2, None, ""), (3, "", ""), (4, " \n\t\n ", None),
    (5, LONG, "b"), (6, PROSE + " tail", "b"), (7, "same line\nother", None), (8, "same line\nthing", ""), (9, "x" * 3000, "c"), (10, "é漢 " * 200, "c"),
]
EXTRA = ("x", "lines", "cut", "spans", "hit", "dot", "row", "other", "yes")
COLUMNS = (
    "doc_id long, text string, source string, lang string, n_chars long, _w string, _rid string, label string, kept string, n_words string, rid long, node long, "
    "_x string, n_lines string, cut_text string, spans string, N_Hit string, `a.b` string, _row string, other1 string, contaminated string"
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "en", 0, "w", "r", "l", "k", "n", 7, 8, *EXTRA) for r in ROWS]
    return spark.createDataFrame(rows, COLUMNS).repartition(5).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (9, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[:20])), (1, "t1 t2 t3"), (None, "same line"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, l, i: substring_dedup.drop_repeats(d), "op2": lambda d, l, i: language_model.score(d), "op3": lambda d, l, i: byte_bpe.encode(d, digests=True), "op4": lambda d, l, i: suffix_dedup.dedup(d),
    "op5": lambda d, l, i: quality_classifier.classify(d, l), "op6": lambda d, l, i: quality_rules.judged(d, l), "op7": lambda d, l, i: decontamination.find(d, i, cut=True), "op8": lambda d, l, i: sharding.shard(d, 3),
    "op9": lambda d, l, i: near_dedup.near_duplicates(d), "op10": lambda d, l, i: line_dedup.drop_boilerplate(d), "op11": lambda d, l, i: secret_scan.scan(d), "op13": lambda d, l, i: alignment.align(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_are_kept(docs, labels, items, name):
    out = OPERATORS[name](docs, labels, items)
    assert sorted(map(str, [r.doc_id for r in out.select("doc_id").collect()])) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0


def test_private_names_stay(docs):
    out = quality_rules.text_features(docs)
    assert out.where("_w = 'w' AND _rid = 'r' AND rid = 7").count() == len(ROWS) and dict(out.dtypes)["n_words"] == "bigint"


def test_language_model_of_stretches_without_words(spark):
    """One empty text in a partition of its own beside texts, and one to ten tokens in a partition."""
    rows = [(k, " ".join(f"w{j}" for j in range(k))) for k in range(10)] + [(None, ""), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    one = {(r.doc_id, r.n_tokens): r.score for r in language_model.score(df).collect()}
    two = {(r.doc_id, r.n_tokens): r.score for r in language_model.score(df.coalesce(1)).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert all(r.score == 0 and r.train_tokens == 0 for r in language_model.score(df, "true").collect())


def test_hosts_null_and_empty_are_apart(spark):
    docs = spark.createDataFrame([(k, f"once {k}\n{'menu' if h is None else 'other'}", h) for k, h in enumerate([None, None, "", "", ""])], "doc_id long, text string, source string")
    found = {tuple(r) for r in line_dedup.boilerplate(docs).select("host", "pages", "host_pages").collect()}
    assert found == {("none", 2, 2), ("h", 3, 3)}


def test_cut_over_blocks(docs, items):
    whole = {(r.text, r.cut_text, r.n_hit) for r in decontamination.find(docs, items, cut=True).collect()}
    parts = {(r.text, r.cut_text, r.n_hit) for r in decontamination.find(docs, items, cut=True, block_words=4).collect()}
    assert whole == parts and any(c is not None for _, c, _ in whole)


def test_near_dedup_border_and_dense_groups(spark):
    """Pairs at 75 % exactly and just under; a chain of texts that only neighbours link; a group of which no two link."""
    words = lambda at, n: [f"v{k}" for k in range(at, at + n)]
    # Runs of n + 4 words have n shingles; a shift by s leaves n - s common of n + s.
    docs = [(1, words(0, 704)), (2, words(100, 704)), (3, words(5000, 703)), (4, words(5101, 703))]
    docs += [(10 + k, words(10_000 + 90 * k, 704)) for k in range(12)]
    docs += [(100 + k, words(20_000, 600) + [f"u{k}_{j}" for j in range(150)]) for k in range(40)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in docs}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    assert out == label and out[2] == 1 and out[21] == 10


def test_near_dedup_tries_few_pairs_of_a_dense_group(spark, monkeypatch):
    # Copies of one text with three or four words changed: most pairs are a little under the threshold.
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(150):
        words = list(base)
        for place in rng.sample(range(150), 3 + k % 2):
            words[place] = f"x{k}y{place}"
        texts.append(" ".join(words))
    tried, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, sets: tried.append((pairs.count(), found := linked(pairs, sets), found.count())) or found)
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for t in texts]
    label = list(range(len(texts)))
    links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert out == dict(enumerate(label))
    n, _, found = tried[-1]
    assert n <= 2 * found + 50, (n, found)


KEEPING = {"quality_rules": lambda d, l, i: quality_rules.keep_good(d, l), "line_dedup": lambda d, l, i: line_dedup.drop_lines(d), "near_dedup": lambda d, l, i: near_dedup.keep_first(d), "decontamination": lambda d, l, i: decontamination.decontaminate(d, i)}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay(docs, labels, items, name):
    out = KEEPING[name](docs, labels, items)
    assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    assert rows and all(tuple(r)[3:] == ("en", 0, "w", "r", "l", "k", "n", 7, 8, *EXTRA) for r in rows)


def test_pages_of_other_line_ends(spark):
    pages = [(k, f"title{end}{end}body {k}{end} \t{end}end{end}", "h") for k, end in enumerate(["\r\n", "\n", "\r\n", "\x0b\n", " \n"])]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string")
    for r in line_dedup.drop_boilerplate(df).collect():
        end = pages[r.doc_id][1].split("title")[1].split("\n")[0] + "\n"
        assert (r.n_lines, r.n_dropped, r.text) == (6, 2, f"{end}body {r.doc_id}{end} \t{end}")


def test_odd_labels(spark):
    """Labels that are null or out of range say nothing of a site; the row's other label still does."""
    docs = spark.createDataFrame([(k, f"text number {k} of a site", "s", "en") for k in range(12)], "doc_id long, text string, source string, lang string")
    marks = [(0, 5, 0), (1, None, 0), (2, -1, None), (3, 1, 7), (4, 1, 0), (5, 0, 0), (None, 1, 1)]
    out = quality_classifier.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    # Of quality 1, 1 and 0 are left, of toxic four times 0; one host with one path, so both levels shrink towards (k + 1/2) / (n + 1).
    for r in out:
        for t, base in (("quality", 2.5 / 4), ("toxic", 0.5 / 5)):
            k, n = {"quality": (2, 3), "toxic": (0, 4)}[t]
            host = (k + 100 * base) / (n + 100)
            rate = (k + 100 * host) / (n + 100)
            assert r[t] == pytest.approx(1 / (1 + math.exp(-(r[f"{t}_odds"] + math.log(rate / (1 - rate))))), abs=1e-6)


def test_discounts_grow():
    for counts in ([100, 40, 22, 14, 10, 7], [1000, 500, 10, 500, 3, 200], [5, 0, 0, 0, 0, 0], [0] * 6, [10, 10, 10, 10, 10, 10], [268870, 49000, 17000, 9000, 5200, 4500]):
        kept = [r * d for r, d in enumerate(language_model.discounts(counts), 1)]
        assert all(0 < x < r for r, x in enumerate(kept, 1)) and all(x < y for x, y in zip(kept, kept[1:]))
    exact = [1_000_000 / r**2.5 for r in range(1, 7)]
    cut = 6 * exact[5] / exact[0]
    assert language_model.discounts(exact) == pytest.approx([((r + 1) * exact[r] / (r * exact[r - 1]) - cut) / (1 - cut) for r in range(1, 6)])


def test_pipeline_on_awkward_rows(spark, docs, labels, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() <= len(ROWS)
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, str(tmp_path), name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
