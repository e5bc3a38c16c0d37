import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.operators import charts, fuzzy, galaxy, graph, lexicon, repair, scores, setops, spam, threads, verify
from postloom.plans import archive, search
from postloom.plans.search import Flags
from postloom.sources import mail
from postloom.streaming import ingest

MESSAGES = "idx long, msgid string, refs array<string>, epoch long, author string, subject string, newsgroups string, body string"


def messages(spark, bodies, refs=None, epochs=None, subject="s"):
    rows = [(i, f"{i}@h", (refs or {}).get(i, []), (epochs or {}).get(i, i), "me", subject, "g", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, MESSAGES)


def ids(df):
    return sorted(r.msgid for r in df.collect())


def archive_of(spark, names, start=0):
    return spark.createDataFrame([(start + i, n, "x") for i, n in enumerate(names)], "idx long, msgid string, body string")


def test_set_operations(spark):
    one, two = archive_of(spark, ["a@h", "b@h"]), archive_of(spark, ["b@h", "c@h", "c@h"], 10)
    assert ids(setops.merge(one, two)) == ["a@h", "b@h", "c@h", "c@h"]
    assert ids(setops.complement(two, one)) == ["c@h", "c@h"]
    new = archive_of(spark, ["b@h", "d@h"], 20)
    assert [(r.part, r.msgid, r.idx) for r in setops.update(one, new).orderBy("part", "idx").collect()] == [(0, "d@h", 21), (1, "a@h", 0), (1, "b@h", 1)]
    assert [(r.part, r.msgid, r.idx) for r in setops.update(one, new, overwrite=True).orderBy("part", "idx").collect()] == [(0, "a@h", 0), (1, "b@h", 20), (1, "d@h", 21)]
    assert ids(setops.kill_duplicates(archive_of(spark, ["a@h", "a@h", "bad", "bad"]))) == ["a@h", "bad", "bad"]
    three = archive_of(spark, ["e@h", "c@h"], 30)
    assert ids(setops.merge(one, two, three)) == ["a@h", "b@h", "c@h", "c@h", "e@h"]
    assert ids(setops.merge(one, two, three, compat=True)) == ["a@h", "b@h", "c@h", "c@h", "c@h", "e@h"]


def links(spark, parents, epochs=None):
    return spark.createDataFrame([(i, p, (epochs or {}).get(i, i)) for i, p in parents.items()], "idx long, parent long, epoch long")


def test_thread_order_and_totals(spark):
    df = links(spark, {0: None, 1: 0, 2: 0, 3: 1, 4: None}, {0: 1, 1: 5, 2: 2, 3: 9, 4: 0})
    assert [r.idx for r in threads.thread_order(df).orderBy("new_idx").collect()] == [4, 0, 2, 1, 3]
    assert {r.idx: r.child_total for r in threads.connectivity(df).collect()} == {0: 4, 1: 2, 2: 1, 3: 1, 4: 1}


def loops_by_walking(parents):
    parents = dict(parents)
    for i in sorted(parents):
        seen, n = set(), i
        while parents[n] is not None:
            if parents[n] in seen:
                parents[n] = None
                break
            seen.add(parents[n])
            n = parents[n]
    return parents


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1, 8), min_size=1, max_size=9))
def test_loops_are_cut_as_by_walking(spark, targets):
    parents = {i: (t if 0 <= t < len(targets) else None) for i, t in enumerate(targets)}
    got = {r.idx: r.parent for r in graph.break_loops(links(spark, parents)).collect()}
    assert got == loops_by_walking(parents)


def test_parents_by_reference(spark):
    m = messages(spark, ["", "", "", ""], {1: ["0@h"], 2: ["0@h", "1@h"], 3: ["gone@h"]})
    assert {r.idx: (r.parent, r.ref_status) for r in threads.parents(m).collect()} == {0: (None, "none"), 1: (0, "ok"), 2: (1, "ok"), 3: (None, "broken")}


def test_running_sum_is_the_sum_before(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: r.s for r in graph.running_sum(df, ["k"], "v", "s").collect()}
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(100)}


def test_search_ranks(spark):
    m = messages(spark, ["alpha beta", "alpha foo bar baz beta", "alpha"], subject="")
    index = lexicon.postings(m)
    run = lambda q, **f: {r.idx: round(r.rank, 6) for r in search.search(index, q, Flags(**f)).collect()}
    assert run("alpha beta", adjacent=True) == {0: 502.13602, 1: 124.194843, 2: 1.983943}
    assert run("alpha")[2] == 251.960784 == run("alpha alpha", adjacent=True)[2]
    assert run("-beta", set_logic=True) == {} == run("foo") == run("")
    assert set(run("+beta alpha", set_logic=True)) == {0, 1} == set(run("alpha beta", require_all=True))
    assert run("alpha nothing", require_all=True) == {}
    near = fuzzy.similar_words(spark.createDataFrame([("alpha", 3), ("alphb", 2), ("zzzzz", 2)], "word string, df long"))
    assert [tuple(r) for r in near.orderBy("word").collect()] == [("alpha", "alphb", 1), ("alphb", "alpha", 1)]


def test_a_prefix_stands_for_all_of_its_words(spark):
    names = [f"pre{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(1500)]
    bodies = [b for k in range(0, 1500, 100) for b in [" ".join(names[k : k + 100])] * 2]
    index = lexicon.postings(messages(spark, [*bodies, "other prefer", "prefer other"], subject=""))
    run = lambda q: {r.idx: r.rank for r in search.search(index, q, Flags(set_logic=True)).collect()}
    got = run("pre*")
    assert set(got) == set(range(32))
    # A message's rank is the sum over its own words, whichever place they have among those of the prefix.
    assert got[0] == pytest.approx(got[28]) and got[30] == pytest.approx(run("prefer")[30])
    # A word counts once, for the first term that names it; a literal beside a prefix still counts.
    assert run("prefer pre*") == pytest.approx(got) and run("pre* prefer") == pytest.approx(got)
    assert set(run("+other pre*")) == {30, 31} and set(run("-other pre*")) == set(range(30))


def test_similar_words_are_those_within_the_bound(spark):
    import random

    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 13))) for _ in range(120)})
    df = {w: r.randint(2, 40) for w in words}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    want = set()
    for a in words:
        most = 1 if len(a) <= 5 else 2 if len(a) <= 10 else 3
        near = [(b, distance(a, b)) for b in words if a != b and df[b] >= df[a] // 10]
        near = [(b, k) for b, k in near if k <= most]
        top = max((df[b] for b, _ in near), default=0)
        want |= {(a, b, k) for b, k in near if df[b] >= top // 5}
    got = {tuple(x) for x in fuzzy.similar_words(spark.createDataFrame(list(df.items()), "word string, df long")).collect()}
    assert got == want


def test_similar_words_walk_by_frequency(spark):
    """Only each word itself is read beside the shared vocabulary: no variants, no join; words beyond ASCII count by letters."""
    df = {"żółwiątko": 40, "żółwiątka": 20, "żółwiątek": 7, "alpha": 9, "alphb": 9}
    near = fuzzy.similar_words(spark.createDataFrame(list(df.items()), "word string, df long"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    turtles = {("żółwiątko", "żółwiątka", 1), ("żółwiątka", "żółwiątko", 1), ("żółwiątek", "żółwiątko", 2), ("żółwiątek", "żółwiątka", 2)}
    # The third has less than a fifth of the second's best partner, not of the first's.
    assert {tuple(r) for r in near.collect()} == turtles | {("alpha", "alphb", 1), ("alphb", "alpha", 1)} | {("żółwiątko", "żółwiątek", 2)}
    assert fuzzy.average_similar(near).first().n_words == 5
    assert fuzzy.similar_words(spark.createDataFrame([], "word string, df long")).count() == 0
    assert {r.word for r in fuzzy.similar_words(spark.createDataFrame(list(df.items()), "word string, df long"), ["alpha"]).collect()} == {"alpha"}


def test_similar_words_leave_the_driver_alone(spark, monkeypatch):
    """The vocabulary goes past the tasks in blocks of falling frequency; the driver neither collects nor shares it."""
    import random

    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*a, **k):
        raise AssertionError("the vocabulary came to the driver")

    r = random.Random(3)
    df = {"".join(r.choice("abc") for _ in range(r.randint(3, 12))): r.choice([2, 2, 3, 30, 400]) for _ in range(150)}
    monkeypatch.setattr(fuzzy, "_BLOCK", 7)
    for name in ("toArrow", "toPandas", "collect", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, refused)
    monkeypatch.setattr(SparkContext, "broadcast", refused)
    near = fuzzy.similar_words(spark.createDataFrame(list(df.items()), "word string, df long"))
    monkeypatch.undo()

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for w in df:
        close = {x: d for x in df if x != w and df[x] >= df[w] // 10 and (d := apart(w, x)) <= fuzzy.most_edits(len(w))}
        best = max((df[x] for x in close), default=0)
        want |= {(w, x, d) for x, d in close.items() if df[x] >= best // 5}
    assert {tuple(x) for x in near.collect()} == want and len(want) > 100


def test_galaxy_states(spark):
    rows = [("one", "A", None, []), ("same", "A", "p", ["c"]), ("same", "B", "p", ["c"]), ("kids", "A", "p", ["c"]), ("kids", "B", "p", ["c", "d"]), ("up", "A", "p", []), ("up", "B", None, []), ("both", "A", "p", ["c"]), ("both", "B", "q", [])]
    df = spark.createDataFrame(rows, "msgid string, archive string, parent_id string, child_ids array<string>")
    assert {r.msgid: r.state for r in galaxy.states(df).collect()} == {"one": "Nothing", "same": "Crosspost", "kids": "ChildrenDifferent", "up": "ParentDifferent", "both": "BothDifferent"}
    linked = spark.createDataFrame([("x", 1, None, ["y", "z"]), ("y", 2, None, []), ("w", 1, "y", ["y"]), ("w", 2, None, ["y"])], "msgid string, archive int, parent_id string, refs array<string>")
    assert [tuple(r) for r in galaxy.indirect_links(linked).select("child", "parent").collect()] == [("x", "y")]


def test_scores(spark):
    m = spark.createDataFrame([(0, "HELLO", "bob@x")], "idx long, subject string, author string")
    assert tuple(scores.score(m, scores.parse_rules("10 subject ~hello\n-3 from !bob")).first()) == (0, 7, "Positive")
    assert scores.rules(m.sparkSession, "1 subject =a\nbad line").count() == 1


def test_spam_learns(spark):
    rows = [(i, ("buy cheap pills now " if i % 2 else "meeting notes about trains ") + str(i), bool(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "idx long, body string, spam boolean")
    got = {r.idx: r.score for r in spam.predict(df, *spam.train(df)[:1], 15, 15).collect()}
    assert min(got[i] for i in range(1, 30, 2)) > max(got[i] for i in range(0, 30, 2))
    conn = links(spark, {0: None, 1: None, 2: None, 3: 2}).withColumn("child_total", F.when(F.col("idx") == 2, 2).otherwise(1))
    given = spark.createDataFrame([(0, 0.2), (1, 0.9), (2, 0.7), (3, 0.8)], "idx long, score double")
    assert sorted(r.idx for r in spam.spam_messages(None, conn, given, thread=0.6).collect()) == [1, 2, 3]


def test_lost_threads_are_found(spark):
    m = messages(spark, ["green trains depart early tomorrow", "> green trains depart early\nI agree", "other words entirely here", "more other words"], {2: ["lost@h"], 3: ["lost@h"]}, {0: 0, 1: 100, 2: 200, 3: 300})
    conn = threads.connect(m)
    index = lexicon.postings(m, conn)
    got, changed = repair.repair(m, conn, index)
    assert changed and {r.idx: r.parent for r in got.collect()} == {0: None, 1: 0, 2: None, 3: 2}


def test_repair_goes_on_until_nothing_is_found(spark):
    bodies = ["green trains depart early tomorrow morning"]
    for k in range(1, 12):
        bodies.append(f"> {bodies[-1].splitlines()[-1]}\nsubject{k} matter{k} comes{k} along{k} here{k}")
    m = messages(spark, bodies, {}, {k: 100 * k for k in range(12)})
    conn = threads.connect(m)
    got, changed = repair.repair(m, conn, lexicon.postings(m, conn))
    assert changed and {r.idx: r.parent for r in got.collect()} == {0: None, **{k: k - 1 for k in range(1, 12)}}


def test_links_to_threads_with_a_later_root_stay(spark):
    # 0 quotes 1, whose date is later; 2, 3 and 4 quote each other in a circle; 5 and 6 quote the same line, which 6 also says itself.
    bodies = [
        "> green trains depart early\nI agree wholly", "green trains depart early tomorrow",
        "> three yellow birds\none purple horse gallops", "> one purple horse\ntwo orange fishes dive", "> two orange fishes\nthree yellow birds sing",
        "> winter apples taste sweet\nindeed", "> winter apples taste sweet\nwinter apples taste sweet anyway", "someone said winter apples taste sweet today",
    ]
    m = messages(spark, bodies, {}, {0: 100, 1: 200, 2: 300, 3: 400, 4: 500, 5: 600, 6: 700, 7: 650})
    conn = threads.connect(m)
    got, changed = repair.repair(m, conn, lexicon.postings(m, conn))
    parent = {r.idx: r.parent for r in got.collect()}
    assert changed and parent[0] == 1 and parent[1] is None
    assert sum(parent[i] is None for i in (2, 3, 4)) == 1 and all(parent[i] in (None, want) for i, want in ((2, 4), (3, 2), (4, 3)))
    assert parent[5] == 6 and parent[6] == 7 and parent[7] is None


def test_no_link_by_quotation_is_lost(spark):
    # 0 and 1 quote each other, 2 and 3 too; 4 quotes 3, and 5 quotes nothing.
    said = ["green trains depart early", "three yellow birds", "winter apples taste sweet", "one purple horse", "two orange fishes", "nothing here matches"]
    quoted = {0: 1, 1: 0, 2: 3, 3: 2, 4: 3}
    bodies = [(f"> {said[quoted[i]]}\n" if i in quoted else "") + f"{s}\nunique{i} ending{i}" for i, s in enumerate(said)]
    m = messages(spark, bodies, {}, {i: 100 * i for i in range(6)})
    conn = threads.connect(m)
    got = repair.repair(m, conn, lexicon.postings(m, conn))[0].collect()
    assert {r.idx: r.quotes for r in got} == {i: quoted.get(i) for i in range(6)}
    parent = {r.idx: r.parent for r in got}

    def root(i):
        return i if parent[i] is None else root(parent[i])

    # What isn't a parent would close a circle, one of each.
    left = [i for i in quoted if parent[i] is None]
    assert len(left) == 2 and all(root(quoted[i]) == i for i in left) and all(parent[i] == quoted[i] for i in quoted if i not in left)


def test_attributions_inside_quotations(spark):
    cases = [
        (["hi", "> Ann wrote:", "> > deep", "> said", "x"], ["> > deep", "> said", "x"]),
        (["> On Monday", "", "> Ann wrote:", "> > deep", "> said"], ["> > deep", "> said"]),
        (["> said", "> more"], ["> said", "> more"]),
        (["no quotation", "at all"], []),
        ([], []),
        (["> On Monday", "[cut]", ">> deep"], [">> deep"]),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, lines array<string>")
    got = {r.i: r.got for r in df.select("i", lexicon.past_attribution(F.col("lines")).alias("got")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_checks_find_what_is_wrong(spark):
    conn = spark.createDataFrame([(0, None, 3), (1, 0, 1), (2, 3, 2), (3, 2, 2)], "idx long, parent long, child_total long").withColumn("epoch", F.col("idx"))
    m = spark.createDataFrame([(0, "a@b"), (1, "a@b"), (2, "c@d"), (3, "e@f")], "idx long, msgid string")
    got = {r["check"]: r.n_wrong for r in verify.report(m, conn, False).collect()}
    assert got == {"reachable": 2, "lookup": 1, "order": 0, "totals": 1, "unique": 1, "similar_words": 1}


def test_weights_of_classifiers_move(spark):
    own = dict.fromkeys(spam.CLASSIFIERS, 1.0)
    spam._reweighed(own, {c: 0.9 if c != "nb" else 0.1 for c in spam.CLASSIFIERS}, True)
    assert own["nb"] == 1 - spam.WEIGHT_STEP and sum(w != 1 for w in own.values()) == 1
    spam._reweighed(own, {c: 0.1 if c != "nb" else 0.9 for c in spam.CLASSIFIERS}, True)
    assert own["nb"] == 1.0
    df = spark.createDataFrame([(i, ("buy cheap pills now " if i % 2 else "meeting notes about trains ") + str(i), bool(i % 2)) for i in range(30)], "idx long, body string, spam boolean")
    model, weights = spam.train(df)
    assert set(weights) == set(spam.CLASSIFIERS) and model.where("length(feature) > 4").count() == 0
    empty_model, plain = spam.train(df.where("false"))
    assert empty_model.count() == 0 and set(plain.values()) == {1.0}


def test_a_message_is_learnt_by_arrays(spark):
    """Against the rules feature by feature; a long message takes as many steps as a short one, not as many loops over its features."""
    import math
    import random

    import numpy as np

    r = random.Random(5)
    own = np.array([[r.uniform(-1, 1) if c in ("logist", "pa", "pam") else r.uniform(0.8, 1.2) if "winnow" in c or "confidence" in c else float(r.randint(0, 4)) for _ in range(40)] for c in spam.DEFAULTS])
    one = [dict(zip(spam.DEFAULTS, col, strict=True)) for col in own.T.tolist()]
    for kind in (True, False, True):
        sign = 1 if kind else -1
        spam._learn(own, kind)
        for f in one:
            for c in ("nb", "nsnb", "hit"):
                f[f"{c}_{'spam' if kind else 'ham'}"] += 1
            f["hit"] = (f["hit_spam"] - f["hit_ham"]) / (f["hit_spam"] + f["hit_ham"])
        for _ in range(100):
            p = 1 / (1 + math.exp(-math.fsum(f["logist"] for f in one) / 10))
            if (p > 0.75) == kind and abs(p - 0.5) > 0.25:
                break
            for f in one:
                f["logist"] += 0.05 * (kind - p)
        for name, scale in (("pa", 1.0), ("pam", 1.25)):
            loss = max(0.0, 1 - sign * math.fsum(f[name] for f in one) / scale)
            for f in one:
                f[name] += sign * min(1.0, loss / len(one))
        for _ in range(50):
            if sign * (math.fsum(f["winnow"] for f in one) / len(one) - 1) > 0.1:
                break
            for f in one:
                f["winnow"] *= 1.1 if kind else 0.9
        got = {c: own[i] for i, c in enumerate(spam.DEFAULTS)}
        for c in ("logist", "pa", "pam", "winnow", "hit", "nb_spam", "nsnb_ham"):
            assert np.allclose(got[c], [f[c] for f in one], rtol=0, atol=1e-12)
    # Weights that many steps have brought to a sum of zero.
    flat = dict.fromkeys(spam.CLASSIFIERS, 0.0)
    spam._reweighed(flat, dict.fromkeys(spam.CLASSIFIERS, 0.4), True)
    assert set(flat.values()) == {0.0} and set(spam._shares(flat).values()) == {1 / 8}
    df = spark.createDataFrame([(0, "buy pills now", True), (1, "meeting notes", False)], "idx long, body string, spam boolean")
    plan = spam.predict(df, spam.train(df)[0], 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [feature" not in plan and "BroadcastHashJoin [feature" in plan


def test_charsets_are_told_by_weighed_letters():
    from postloom.operators import mime

    assert mime.guess("zażółć gęślą jaźń".encode("cp1250")) == mime.guess("zażółć gęślą jaźń".encode("iso8859-2")) == "zażółć gęślą jaźń"
    # One frequent letter outweighs two rare ones.
    assert mime.guess(bytes([0x20, 0xB9])) == " ą" and mime.guess(bytes([0x20, 0xB1])) == " ą"


def test_no_machine_local_folder_on_a_cluster():
    import types

    from postloom import work

    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        work.shared_dir(fake)


def test_charts(spark):
    x = spark.createDataFrame([("srv a.b:7 c:9",), ("srv a.b:12",), ("two a.b:3",), (None,), ("bad",)], "xref string")
    assert sorted(tuple(r) for r in charts.xref(x, "a.b").collect()) == [("srv", 12), ("two", 3)]
    assert [tuple(r) for r in charts.xref(x, "a.b", "two").collect()] == [("two", 3)]


MBOX = b"junk\nFrom a\nSubject: 1\nLines: 1\n\nFrom is text\nignored\nFrom b@c\nMessage-ID: <2@h>\nReferences: <1@h>\n\nbody\r\nmore\n"


def test_mailboxes(spark, tmp_path):
    assert list(mail.split_mbox(MBOX)) == [b"Subject: 1\nLines: 1\n\nFrom is text\n", b"Message-ID: <2@h>\nReferences: <1@h>\n\nbody\nmore\n"]
    (tmp_path / "box").write_bytes(MBOX)
    assert mail.mbox(spark, str(tmp_path / "box")).count() == 2
    folder = tmp_path / "dir" / "sub"
    folder.mkdir(parents=True)
    (folder / "1").write_bytes(b"a\r\nb")
    (folder / ".no").write_bytes(b"x")
    assert [bytes(r.content) for r in mail.maildir(spark, str(tmp_path / "dir")).collect()] == [b"a\nb"]
    # A folder named like an earlier one, below a hidden one.
    deep = tmp_path / ".hidden" / "dir" / "more" / "dir"
    deep.mkdir(parents=True)
    (deep / "2").write_bytes(b"c")
    (deep / ".no").write_bytes(b"x")
    assert [bytes(r.content) for r in mail.maildir(spark, f"file://{deep}").collect()] == [b"c"]
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("d/1", "q\r\n")
        z.writestr("d/.2", "no")
    assert [bytes(r.content) for r in mail.packed(spark, str(tmp_path / "m.zip")).collect()] == [b"q\n"]


def raw_archive(spark):
    texts = [f"From: u{i} <u{i}@h>\nMessage-ID: <{i}@h>\n" + (f"References: <{i // 2}@h>\n" if i else "") + f"Subject: t\nDate: {i + 1} Jan 1999 00:00:00 GMT\nXref: srv g:{i}\n\ncommon words number{i % 3}\n" for i in range(9)]
    return spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate([*texts, texts[4]])], "idx long, content binary")


def test_archives_from_raw_to_queries(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    archive.build(raw_archive(spark), path, name="g", desc_short="d", desc_long="dd")
    a = archive.Archive.open(spark, path)
    assert tuple(a.info().first()) == (9, 1)
    assert all(r.n_wrong == 0 for r in a.verify().collect())
    assert a.idx("5@h").first().idx == a.view("5@h").first().idx >= 0 and a.idx("no@h").first().idx == -1
    assert a.parent("5@h").first().parent == a.idx("2@h").first().idx
    assert {a.view(r.idx).first().msgid for r in a.child("2@h").collect()} == {"4@h", "5@h"}
    assert a.date("0@h").first().date == "Fri Jan  1 00:00:00 1999" and a.subject("1@h").first().subject == "t" and a.author("1@h").first().author == "u1 <u1@h>"
    assert a.search("common words").count() == 9 and a.timechart().first().n == 9
    assert a.xref().first().last == 8 and a.desc()["desc_short"] == "d"
    assert archive.Archive.open(spark, f"file://{tmp_path}/none") is None
    archive.repack(spark, path, f"file://{tmp_path}/b", "lz4")
    found, table = archive.open_galaxy(spark, f"file://{tmp_path}", ["b", "gone"])
    assert list(found) == [0] and [r.available for r in table.orderBy("archive_id").collect()] == [True, False]
    assert archive.web_view(found, "5@h")[0] == 200 and "common words" in archive.web_view(found, "5@h")[1] and archive.web_view(found, "no@h") == (404, "")
    archive.repack_shared(spark, path, f"file://{tmp_path}/packed")
    assert {r.msgid: r.body for r in archive.read_shared(spark, f"file://{tmp_path}/packed").collect()} == {r.msgid: r.body for r in a.messages.collect()}
    mail.export(a.messages.select("idx", "msgid", F.col("body").alias("raw")), f"{tmp_path}/each", per_message=True)
    assert len(list((tmp_path / "each").glob("idx=*/*.txt"))) == 9
    broken = a.conn.withColumn("child_total", F.lit(7).cast("long"))
    assert verify.wrong_totals(broken).count() > 0


def test_an_archive_finds_similar_words_without_a_join(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    archive.build(raw_archive(spark), path)
    a = archive.Archive.open(spark, path)
    near = fuzzy.similar_words(lexicon.vocabulary(a.index))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = {("number0", "number1"), ("number0", "number2"), ("number1", "number0"), ("number1", "number2"), ("number2", "number0"), ("number2", "number1")}
    assert {(r.word, r.similar) for r in a.similar.collect()} == want == {(r.word, r.similar) for r in near.collect()}


def test_an_archive_is_built_without_its_vocabulary_on_the_driver(spark, tmp_path, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*a, **k):
        raise AssertionError("the vocabulary came to the driver")

    monkeypatch.setattr(DataFrame, "toArrow", refused)
    monkeypatch.setattr(SparkContext, "broadcast", refused)
    archive.build(raw_archive(spark), f"file://{tmp_path}/a")
    monkeypatch.undo()
    assert archive.Archive.open(spark, f"file://{tmp_path}/a").similar.count() == 6


def test_arriving_messages_are_merged_once(spark, tmp_path):
    schema = "msgid string, epoch long, body string"
    table, landing = f"{tmp_path}/table", f"{tmp_path}/landing"
    spark.createDataFrame([("a@h", 10, "old")], schema).withColumn("ts", F.timestamp_seconds("epoch")).write.parquet(f"{table}/batch=-1")
    spark.createDataFrame([("a@h", 11, "x"), ("b@h", 12, "new"), ("b@h", 12, "new"), ("c@h", 1, "early")], schema).write.parquet(landing)
    ingest.ingest(ingest.arriving(spark, landing, schema, since=5), table, f"{tmp_path}/cp").awaitTermination()
    assert ids(spark.read.option("recursiveFileLookup", "true").parquet(table)) == ["a@h", "b@h"]


def stored(folder, name, rows, schema, spark):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return f"file://{folder}"


def test_similar_words_of_the_whole_vocabulary(spark, tmp_path):
    from postloom.plans import catalog

    said = [(c, 0, "user", "alpha then gamma") for c in range(2)] + [(2 + c, 0, "user", "alphb them delta") for c in range(2)]
    folder = stored(tmp_path, "conversations", said, "conv_id long, turn long, role string, text string", spark)
    got = {tuple(r) for r in catalog.QUERIES["lexdist"](spark, folder).collect()}
    assert got == {("alpha", "alphb", 1), ("alphb", "alpha", 1), ("then", "them", 1), ("them", "then", 1)}


def test_average_of_similar_words_has_no_join(spark, tmp_path):
    from postloom.plans import catalog

    said = [(c, 0, "user", "alpha then gamma") for c in range(2)] + [(2 + c, 0, "user", "alphb them delta") for c in range(2)]
    got = catalog.QUERIES["lexdist_average"](spark, stored(tmp_path, "conversations", said, "conv_id long, turn long, role string, text string", spark))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and tuple(got.first()) == (4, 1.0)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_set_operations_on_all_sources(spark, tmp_path):
    from postloom.plans import catalog

    docs = [(1, "a", "en", "src1", 1), (2, "b", "en", "src4", 1), (3, "a", "en", "src8", 1), (4, "c", "en", "src15", 1), (5, "d", "en", None, 1), (6, "b", "en", "src17", 1)]
    folder = stored(tmp_path, "documents", docs, DOCUMENTS, spark)
    run = lambda name: sorted(r.idx for r in catalog.QUERIES[name](spark, folder).collect())
    assert run("merge_raw") == [2, 3, 4, 5] == run("update_append")
    assert run("rel_complement") == [4, 5]
    assert run("update_overwrite") == [1, 4, 5, 6]


def test_whole_texts_are_turned_and_cut(spark, tmp_path):
    import codecs
    import hashlib

    from postloom.plans import catalog

    long = "Some words " * 40
    folder = stored(tmp_path, "documents", [(1, long + "End", "en", "s", 1), (2, long + "Fin", "en", "s", 1)], DOCUMENTS, spark)
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r.idx: r.turned for r in catalog.QUERIES["rot13"](spark, folder).collect()}
    assert got == {1: digest(codecs.encode(long + "End", "rot13")), 2: digest(codecs.encode(long + "Fin", "rot13"))}
    got = {r.idx: r.subject for r in catalog.QUERIES["subject_kill"](spark, folder).collect()}
    assert got == {1: digest(long + "End"), 2: digest(long + "Fin")}
