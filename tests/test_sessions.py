"""Keyed session state: late, repeated and out-of-order messages, batches cut anywhere, and a restart."""
import random
from collections import defaultdict

from pathloom.streaming import sessions

COLUMNS = "key string, request long, iteration long, score double, signature string, ord long"


def shown(messages):
    """What each key shows in the end, from all its messages at once."""
    by = defaultdict(list)
    for m in messages:
        by[m[0]].append(m)
    out = {}
    for key, rows in by.items():
        request = max(m[1] for m in rows)
        scores = [(m[3], -m[2]) for m in rows if m[1] == request and m[3] is not None]
        out[key] = (request, -max(scores)[1] if scores else None, max(scores)[0] if scores else None)
    return out


def history(batches):
    """The last signatures of all messages."""
    out = {}
    for key in {m[0] for b in batches for m in b}:
        last = defaultdict(int)
        for m in (m for b in batches for m in b if m[0] == key and m[4] is not None):
            last[m[4]] = max(last[m[4]], m[5])
        out[key] = sorted(last, key=last.get, reverse=True)[: sessions.RECENT]
    return out


def run(spark, folder, batches, name):
    """Each batch is a file, read by a query of its own that goes on from the state of the one before."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/{name}/in/{k}")
        stream = spark.readStream.schema(COLUMNS).parquet(f"{folder}/{name}/in/*")
        found = {r.key: r for r in sessions.drained(stream, f"{folder}/{name}/state").collect()}
    return found


def test_order_and_restart(spark, tmp_path):
    rng = random.Random(3)
    # One request: nothing is stale, so the history is that of all messages.
    rows = [(f"k{rng.randrange(3)}", 5, i, rng.choice([None, *map(float, range(9))]), rng.choice([None, *(f"s{j}" for j in range(30))]), i) for i in range(240)]
    rows += rows[:20]
    rng.shuffle(rows)
    batches = [rows[:90], rows[90:91], rows[91:]]
    one, many = run(spark, tmp_path, [rows], "one"), run(spark, tmp_path, batches, "many")
    want, last = shown(rows), history([rows])
    for found in (one, many):
        assert {k: (r.request, r.iteration, r.best) for k, r in found.items()} == want
        assert {k: r.signatures for k, r in found.items()} == last and all(r.stale == 0 for r in found.values())
    assert all(many[k].told >= one[k].told == 1 for k in one)


def test_stale_results(spark, tmp_path):
    batches = [[("a", 1, 1, 5.0, "x", 1), ("b", 1, 1, 2.0, None, 1)], [("a", 2, 1, 1.0, "y", 2)], [("a", 1, 2, 9.0, "z", 3), ("b", 1, 2, 2.0, None, 2)]]
    found = run(spark, tmp_path, batches, "stale")
    a, b = found["a"], found["b"]
    assert (a.request, a.best, a.signatures, a.told) == (2, 1.0, ["y", "x"], 2)  # what came late changed nothing, so nothing was told
    assert (b.request, b.iteration, b.best, b.told, b.signatures) == (1, 1, 2.0, 1, [])
