"""Sentence runs and site rates against plain loops."""
import math
from collections import defaultdict

import numpy as np
import pytest

from pathloom.llm import npbytes as nb
from pathloom.llm import quality_classifier, substring_dedup
from test_llm import LOWER, TEXTS, WORD, prose

MARKS = tuple(".!?。！？｡．…؟۔।॥‼⁇⁈⁉")


def sentences(text):
    """Lists of lower-case words: cut after marks, at line ends, and inside at the least of any PIECE neighbouring places."""
    found = list(WORD.finditer(text))
    words = [m.group().translate(LOWER) for m in found]
    if not words:
        return []
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    h = nb.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    v = [0, *nb.mix(h[:-1] * np.uint64(substring_dedup._MULT) + h[1:]).tolist()]
    new = {k for k in range(len(words)) if k == 0 or words[k - 1].endswith(MARKS) or "\n" in text[found[k - 1].end() : found[k].start()]}
    cuts, size = set(), substring_dedup.PIECE
    for k in range(len(words) - size + 1):
        places = range(k, k + size)
        if len(words) > size and not new & set(places):
            cuts.add(min(places, key=lambda p: (v[p], p)))
    heads = [*sorted(new | cuts), len(words)]
    return [tuple(words[a:b]) for a, b in zip(heads, heads[1:])]


def test_sentence_runs(spark):
    shared = prose(90)
    texts = [*TEXTS, prose(20) + "\n" + shared + "\n" + prose(10), shared, "start of it " + shared.replace("\n", " ") + " and its end", shared + "\n" + shared]
    parts = [sentences(t or "") for t in texts]
    runs = defaultdict(list)
    for doc, s in enumerate(parts):
        for i in range(len(s)):
            j = i + substring_dedup.MIN_SENTENCES
            while j <= len(s) and sum(map(len, s[i:j])) < substring_dedup.MIN_WORDS:
                j += 1
            if j <= len(s):
                runs[tuple(s[i:j])].append((doc, i))
    gone = defaultdict(set)
    for run, places in runs.items():
        for doc, i in sorted(places)[1:]:
            gone[doc] |= set(range(i, i + len(run)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in substring_dedup.drop_repeats(df).collect()}
    assert {k: (r.n_sentences, r.n_removed) for k, r in out.items()} == {k: (len(s), len(gone[k])) for k, s in enumerate(parts)}
    for k, s in enumerate(parts):
        assert WORD.findall(out[k].text.translate(LOWER)) == [w for i, x in enumerate(s) if i not in gone[k] for w in x]
    assert len(gone[len(texts) - 3]) > 10 and len(gone[len(texts) - 1]) > 20


def strength(groups):
    """How many labels the prior counts as, from (n, k, prior rate) of each group."""
    groups = [g for g in groups if g[0] > 0]
    total = sum(n for n, _, _ in groups)
    within = sum(n * p * (1 - p) for n, _, p in groups)
    if len(groups) < 2 or not total or not within:
        return 100.0
    between, squares = sum(n * (k / n - p) ** 2 for n, k, p in groups), sum(n * n for n, _, _ in groups)
    inner = within / total
    variance = max((between - (len(groups) - 1) * inner) / max(total - squares / total, 1e-9), inner * 1e-3)
    return min(1000.0, max(1.0, inner / variance - 1))


def test_site_rates_and_posteriors(spark):
    rng = np.random.default_rng(5)
    table = [(f"h{h}", f"p{p}", n, int(rng.binomial(n, (h + 1) / 8))) for h in range(6) for p in range(4) for n in [int(rng.integers(0, 40))]]
    df = spark.createDataFrame(table, "host string, path string, n_quality long, k_quality long")
    base = (sum(r[3] for r in table) + 0.5) / (sum(r[2] for r in table) + 1.0)
    hosts = {h: (sum(r[2] for r in table if r[0] == h), sum(r[3] for r in table if r[0] == h)) for h in {r[0] for r in table}}
    m = strength([(n, k, base) for n, k in hosts.values()])
    above = {h: (k + m * base) / (n + m) for h, (n, k) in hosts.items()}
    m = strength([(n, k, above[h]) for h, _, n, k in table])
    expected = {(h, p): (k + m * above[h]) / (n + m) for h, p, n, k in table}
    out = {(r.host, r.path): r.quality_rate for r in quality_classifier.site_rates(df, "quality").collect()}
    assert out.keys() == expected.keys() and all(out[k] == pytest.approx(expected[k], abs=1e-9) for k in out)
    # Posteriors join a text's own odds with the rate of its path, each row by itself.
    docs = spark.createDataFrame([(k, f"word{k % 7} and more", f"h{k % 3}", f"p{k % 2}") for k in range(60)] + [(None, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    counts = defaultdict(lambda: [0, 0, 0])
    for k in range(60):
        counts[f"h{k % 3}", f"p{k % 2}"][0] += k % 2 == 0
        counts[f"h{k % 3}", f"p{k % 2}"][1] += (k % 2 == 0) * int(k % 3 > 0)
    sites = spark.createDataFrame([(h, p, n, k) for (h, p), (n, k, _) in [*counts.items(), (("", ""), (0, 0, 0))]], df.schema)
    rates = {(r.host, r.path): r.quality_rate for r in quality_classifier.site_rates(sites, "quality").collect()}
    for r in quality_classifier.classify(docs, labels).collect():
        rate = rates["", ""] if r.doc_id is None else rates[f"h{r.doc_id % 3}", f"p{r.doc_id % 2}"]
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(r.quality_odds + math.log(rate / (1 - rate))))), abs=1e-6)
        assert r.kept == (r.quality >= 0.5 and r.toxic < 0.5)


def test_long_lists_are_decoded_in_parts(monkeypatch):
    import public_tokenizers

    from pathloom.llm import byte_bpe

    bpe = byte_bpe.Engine(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["naïve  words, 12345 and 日本語 " * 9, "", "a", "x" * 1000, "\x00\n\n"]
    ids = [np.frombuffer(x, np.int32) for x in bpe.encode(texts)]
    for part in (3, 17, 10_000):
        monkeypatch.setattr(byte_bpe, "PART", part)
        assert bpe.decode(ids) == [t.encode() for t in texts]
    assert bpe.decode([]) == []
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.decode([np.array([5, 65_000], np.int32)])
