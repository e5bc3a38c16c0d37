import hashlib
from collections import Counter

import numpy as np
import xxhash

from postloom.llm import simhash, substring_dedup
from postloom.operators.graph import components

from .helpers import awkward, frame, words


def removed_by_brute_force(rows, window=substring_dedup.WINDOW):
    split = [[w.encode() for w in words(t)] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_windows_are_removed_as_by_brute_force(spark):
    for seed, vocabulary in ((1, ("der", "la", "tion", "Ethe", "of,", "és", "x")), (2, ("a", "a", "a", "b"))):
        rows = awkward(seed, vocabulary)
        docs = frame(spark, rows)
        for batches in (None, substring_dedup.batches_by_id(docs, 3)):
            got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_repeats(docs, batches).collect()]
            assert sorted(got, key=str) == removed_by_brute_force(rows)


def test_an_index_opens_again_and_goes_on(spark, tmp_path):
    rows = awkward(4)
    docs = frame(spark, rows)
    parts = substring_dedup.batches_by_id(docs, 5)
    path = f"file://{tmp_path}/log"
    for k, condition in enumerate(parts):
        # A session that knows nothing of the tables of the one before.
        other = spark.newSession()
        log = substring_dedup.FingerprintLog(other, path, buckets=3)
        assert log.turn == k
        for name in list(log._state["levels"].values()):
            other.sql(f"drop table if exists {log._table(name)}")
        log.append(substring_dedup.keyed(docs).where(condition))
        assert len(log._state["levels"]) == (k + 1).bit_count()
    log = substring_dedup.FingerprintLog(spark, path)
    found = substring_dedup.repeats(docs, log)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.without(docs, found).collect()]
    assert sorted(got, key=str) == removed_by_brute_force(rows)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "log").iterdir()).count("run") == len(parts).bit_count()
    plan = log.repeated()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    log.drop()
    assert substring_dedup.FingerprintLog(spark, path).repeated().count() == 0


def test_an_empty_table_gives_an_empty_result(spark):
    docs = frame(spark, [])
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert simhash.groups(docs).count() == 0


def brute_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_groups_are_the_components_of_near_fingerprints(spark):
    rows = awkward(3)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(frame(spark, rows)).collect()), key=str)
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    assert got == sorted(((d, p, least.get(g)) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def test_large_keys_are_linked_by_midpoints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 62))
    prints = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    df = spark.createDataFrame([(x,) for x in sorted(prints)], "fp long")

    def classes():
        return sorted(tuple(r) for r in components(simhash.near_links(df)).collect())

    whole = classes()
    rest = df.select("fp")
    assert sorted(tuple(r) for r in components(simhash._midpoint_links(rest)).collect()) == whole
    monkeypatch.setattr(simhash, "BUCKET", 1)
    key, fp = np.array([1, 1, 1, 2, 3, 3], np.int64), np.array([4, 5, 6, 7, 8, 9], np.uint64)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(fp[a:b].view(np.int64))], ["key", "fp"]) for a, b in ((0, 1), (1, 3), (3, 6))]
    out = [r for b in simhash._link_batches(iter(batches)) for r in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(r[0] for r in out if r[1] is None) == [4, 5, 6, 8, 9]


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(frame(spark, [(3, "one two three four five"), (2, "one two three four five"), (9, "quite another text about nothing at all"), (None, "one two three four five")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9, None]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "id"]
