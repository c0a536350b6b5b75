"""Cases that the corpus operators once passed over."""
from collections import Counter

import numpy as np
import pytest

from pathloom.llm import line_dedup, near_dedup, quality_rules, substring_dedup


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("mark", ["", "。"])
def test_passages_pasted_inside_sentences(spark, mark):
    """51 words inside unmarked prose, at every offset: each copy but the first loses most of it, and nothing else."""
    rng = np.random.default_rng(11)
    fresh = iter(f"u{k}" for k in rng.permutation(9000))
    passage = [f"p{k}{mark if k % 7 == 3 else ''}" for k in rng.permutation(51)]
    rows = [(k, " ".join([*(next(fresh) for _ in range(30 + k)), *passage, *(next(fresh) for _ in range(45 - k))])) for k in range(24)]
    docs = spark.createDataFrame([*rows, (99, " ".join(next(fresh) for _ in range(200)))], "doc_id long, text string")
    out = by_id(substring_dedup.drop_repeats(docs))
    assert out[0].n_removed == 0 and out[99].n_removed == 0
    for k, text in rows[1:]:
        left = out[k].text.split()
        assert [w for w in left if w[0] == "u"] == [w for w in text.split() if w[0] == "u"]
        assert sum(w[0] == "p" for w in left) <= 51 - substring_dedup.MIN_WORDS


def test_wide_marks_end_sentences():
    raw = "un。 deux 三！ quatre… cinq six é".encode()
    heads, _, starts, _ = substring_dedup._sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[starts[h] :].decode().split()[0] for h in heads[:-1]] == ["un。", "deux", "quatre…", "cinq"]


def test_small_hosts_follow_the_ratio(spark):
    """A menu on each page of hosts of 1 to 9 pages goes where two pages have it; what one page has stays."""
    rows = [(10 * n + k, f"host{n}", f"menu\nonly {n} {k}") for n in range(1, 10) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = by_id(line_dedup.drop_boilerplate(docs))
    assert {k: r.text for k, r in out.items()} == {k: t if h == "host1" else t.split("\n")[1] for k, h, t in rows}


def test_near_dedup_with_null_and_repeated_ids(spark):
    """doc_id 1 stands over two texts; a null doc_id is the least copy of one class and the only one of others."""
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join(f"{x}{k}" for k in rng.permutation(80)) for x in "abcd")
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " tail", "x"), (3, b + " tail", "x"), (None, c, "x"), (5, c, "x"), (6, c + " tail", "x"), (None, d, "x"), (None, d + " tail", "x"), (8, a, "x"), (1, a, "y"), (None, "", "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)
    out = near_dedup.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    classes = Counter((r.component_id, r.kept) for r in out.where("n_shingles > 0").collect())
    assert classes == {(1, True): 2, (1, False): 4, (5, True): 1, (5, False): 2, (None, True): 1, (None, False): 1}
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    one = [k for k in texts if k[0] is None and k[1].startswith("d")]
    assert len(one) == 1 and texts == Counter([(1, a), (1, b), (5, c), (None, ""), (9, ""), *one])


def test_good_rows_with_null_and_repeated_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text), (1, text), (1, "too short"), (None, "short too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Counter(map(tuple, quality_rules.keep_good(docs, labels).collect())) == Counter(rows[:2])
