"""Every corpus operator against a brute-force version, on a small table of awkward rows."""
import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import byte_bpe, decontamination, language_model, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup

LOWER = {k: k + 32 for k in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RNG = np.random.default_rng(7)
VOCAB = [f"w{k}é" if k % 9 == 0 else f"Word{k}" for k in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n)) + ".\n" + " ".join(RNG.choice(VOCAB, n)) + "!"


ITEM = " ".join(VOCAB[:20])
BASE = prose(70)
TEXTS = [
    None, "", " \n\t ", "one two", "Tiny doc", BASE, BASE, BASE.replace("Word", "word", 1), BASE + " tail of other words", prose(40) + "\n" + BASE,
    prose(60) + " " + ITEM + " " + prose(5), ITEM, "only one short item", "In. " * 300, "x" * 1500, "ab" * 900, "Ünï 漢字 'll 42    tabs\t\t end\r\n" * 30, "a | b | c | d " * 40, "spam### ham%%% " * 30, prose(300),
    *[prose(30 + k) for k in range(12)], "shared line\n" + prose(20), "shared line\n" + prose(20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 2}", -1, "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string").repartition(3).persist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(spark, docs):
    for rows, n in ((docs, 5), (docs.limit(0), 5), (docs.unionByName(docs), 3)):
        out = sharding.shard(rows, n).collect()
        assert len(out) == rows.count()
        groups = defaultdict(set)
        sizes = Counter()
        for r in out:
            sizes[r.shard] += r["size"]
            groups[r.text_crc32, r["size"]].add(r.shard)
        assert all(len(g) == 1 for g in groups.values())
        for shard in sizes:
            slots = sorted(r.slot for r in out if r.shard == shard)
            assert slots == list(range(len(slots)))
    # The capacity is the least: compare with a search over the same order.
    narrow = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size"))
    sizes = [r[1] for r in sorted(narrow.groupBy("h").agg(F.sum("size")).collect())]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(sizes, c, 4))
    assert sharding.boundaries(narrow, 4)[1] == best


def fits(sizes, capacity, n):
    used, shards = 0, 1
    for s in sizes:
        if used + s > capacity:
            used, shards = 0, shards + 1
        used += s
    return shards <= n


def test_line_dedup(spark, docs):
    out = by_id(line_dedup.drop_boilerplate(docs, max_ratio=0.05, min_pages=2))
    pages, count = Counter(f"s{k % 2}" for k in range(len(TEXTS))), Counter()
    for k, t in enumerate(TEXTS):
        count.update((f"s{k % 2}", x) for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
    for k, t in enumerate(TEXTS):
        bad = {x for (s, x), n in count.items() if s == f"s{k % 2}" and n >= 2 and n > 0.05 * pages[s]}
        expected = None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)
        assert out[k].text == expected
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    out = by_id(quality_rules.text_features(docs.drop("n_words")).withColumn("base_failed", quality_rules.base_failed()))
    for k, t in enumerate(TEXTS):
        words = WORD.findall(t or "")
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeat = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat))
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(words) < 20 or 100 * len(repeat) > 30 * len(words))


def test_quality_rules_learn(spark):
    rows = [(float(k % 10) / 10, 0.0, 0.0, 5.0, int(k % 10 < 6), k % 3) for k in range(600)]
    labelled = spark.createDataFrame(rows, "symbol_share double, repeat_share double, dup_line_share double, word_length double, label int, part int")
    rules = quality_rules.learn(labelled)
    wrong = labelled.where(rules.rejects() != (F.col("label") == 0)).count()
    assert rules.rules and wrong == 0
    assert not quality_rules.learn(labelled.where("label = 1")).rules
    assert not quality_rules.learn(labelled.limit(0)).rules


def test_quality_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = by_id(quality_rules.judged(docs, labels))
    seen = labels.where("doc_id % 3 > 0")
    classified = by_id(quality_classifier.classify(docs, seen))
    marks = labels.collect()
    good = [r for r in marks if r.quality == 1 and not kept[r.doc_id].base_failed]
    assert sum(kept[r.doc_id].kept for r in good) >= 0.97 * len(good)
    bad = [r for r in marks if r.quality == 0]
    assert sum(not kept[r.doc_id].kept for r in bad) >= 0.9 * len(bad)
    held_out = [r for r in marks if r.doc_id % 3 == 0]
    right = sum(classified[r.doc_id].kept == (r.quality == 1 and r.toxic == 0) for r in held_out)
    assert right >= 0.85 * len(held_out)


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, labels)
    assert out.count() == len(TEXTS) and out.where("kept").count() in (0, len(TEXTS))
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


def test_decontamination(spark, docs):
    items = [(1, ITEM), (2, "only one short"), (3, None), (4, ""), (5, ITEM), (6, " ".join(VOCAB[5:30]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name))
    for block in (50_000, 20):
        out = by_id(decontamination.find(docs, frame, block_words=block))
        for k, t in enumerate(TEXTS):
            w, hit, found = words(t), set(), set()
            for window, names in windows.items():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        found |= names
            r = out[k]
            assert (r.n_words, r.n_hit, sorted(r.item_ids)) == (len(w), len(hit), sorted(found))
            assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert by_id(decontamination.find(docs, frame, cut=True))[11].cut_text == ""
    assert decontamination.find(docs, frame.limit(0)).where("n_hit > 0").count() == 0


def test_byte_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(docs)
    digests, ids = by_id(byte_bpe.encode(docs, digests=True)), by_id(coded)
    decoded = by_id(byte_bpe.decode(coded))
    for k, t in enumerate(TEXTS):
        expected = library.encode_ordinary(t or "")
        assert ids[k].ids == expected
        assert digests[k].ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert bytes(decoded[k].bytes) == (t or "").encode()
        assert digests[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_suffix_dedup(spark, docs):
    raw = [(t or "").encode() for t in TEXTS]
    count = Counter(b[p : p + 400] for b in raw for p in range(len(b) - 399))
    out = by_id(suffix_dedup.dedup(docs, texts=True))
    for k, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        assert (out[k].n_bytes, out[k].n_removed, out[k].n_spans, bytes(out[k].kept)) == (len(b), sum(gone), runs, kept)


def test_substring_dedup(spark, docs):
    out = by_id(substring_dedup.drop_repeats(docs))
    assert out[5].n_removed == 0 and out[5].text == BASE
    assert out[6].n_removed == out[6].n_sentences and out[6].text.strip() == ""
    assert out[9].n_removed > 0 and len(out[9].text) < len(TEXTS[9]) - len(BASE) // 2
    assert all(out[k].n_removed == 0 for k in range(20, 32))
    assert out[0].text == "" and out[4].text == "Tiny doc"


def test_near_dedup(spark, docs):
    sets = []
    for t in TEXTS:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    out = by_id(near_dedup.near_duplicates(docs))
    for k, s in enumerate(sets):
        assert (out[k].n_shingles, out[k].component_id, out[k].kept) == (len(s), label[k], label[k] == k)


def test_sketch_fills_and_estimates():
    x = RNG.integers(1, 2**63, 400).astype(np.uint64)
    a, b = near_dedup.sketches([np.unique(x[:300]), np.unique(x[100:])])
    assert (a != near_dedup._NONE).all() and abs((a == b).mean() - 0.5) < 0.15
    assert (near_dedup.sketches([x[:1]]) != near_dedup._NONE).all()


def test_language_model(spark, docs):
    out = by_id(language_model.score(docs))
    tokens = {k: WORD.findall((t or "").translate(LOWER)) + ["</s>\n"] for k, t in enumerate(TEXTS)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    c, pairs = Counter(), Counter()
    for k, t in tokens.items():
        if not held[k]:
            c.update(t)
            pairs.update(zip(["<s>\n", *t], t))
    n, slots = sum(c.values()), sum(c.values()) + len(c) + 1
    of = Counter(pairs.values())
    d = dict(enumerate(language_model.discounts([of[r] for r in range(1, language_model.K + 2)]), 1))
    history = defaultdict(list)
    for (v, w), r in pairs.items():
        history[v].append((w, r))
    whole, alpha = {}, {}
    for v, ws in history.items():
        whole[v] = sum(r for _, r in ws) + all(r > language_model.K for _, r in ws)
        alpha[v] = (1 - sum(d.get(r, 1) * r for _, r in ws) / whole[v]) / (1 - sum(c[w] + 1 for w, _ in ws) / slots)
        total = sum(d.get(r, 1) * r / whole[v] for _, r in ws) + alpha[v] * (1 - sum(c[w] + 1 for w, _ in ws) / slots)
        assert abs(total - 1) < 1e-9
    for k, t in tokens.items():
        score = 0.0
        for v, w in zip(["<s>\n", *t], t):
            r = pairs.get((v, w), 0)
            score += math.log10(d.get(r, 1) * r / whole[v] if r else alpha.get(v, 1) * (c[w] + 1) / slots)
        r = out[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / slots) for w in t)) < 1e-6 and abs(r.score - score) < 1e-6


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_pipeline(spark):
    """Each stage against a brute-force version on what the stage before it kept; the first takes its learned rules as given."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    verdict = by_id(quality_rules.judged(frame, labels))
    docs = {k: r for k, r in by_id(frame).items() if verdict[k].kept}
    assert 0.3 * len(verdict) < len(docs) < len(verdict)

    pages, lines = Counter(r.source for r in docs.values()), Counter()
    for r in docs.values():
        lines.update((r.source, x) for x in {x.strip(" ") for x in (r.text or "").split("\n")} if x)
    boilerplate = {k for k, n in lines.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[k[0]]}
    texts = {k: "\n".join(x for x in (r.text or "").split("\n") if (r.source, x.strip(" ")) not in boilerplate) for k, r in docs.items()}

    names = sorted(texts)
    sets = shingle_sets([texts[k] for k in names])
    label, changed = list(range(len(names))), True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b in range(a + 1, len(sets)):
                if label[a] != label[b] and x and sets[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    texts = {k: texts[k] for at, k in enumerate(names) if label[at] == at}

    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {tuple(w[i : i + 13]) for w in (words(r.text) for r in items.collect()) for i in range(max(1, len(w) - 12) if w else 0)}
    sizes = {len(x) for x in windows}
    for k in list(texts):
        w = words(texts[k])
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            del texts[k]

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = by_id(corpus_pipeline.run(spark, folder))
    assert set(out) == set(texts)
    for k, t in texts.items():
        assert out[k].ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
