import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from postloom.llm import quality

from .helpers import awkward
from .test_dedup import brute_fingerprint
from .test_text import base_secrets, overlap_by_brute_force, quality_counts

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: awkward rows with nulls in any column, a clashing extra column, and what each stage looks for."""
    at = tmp_path_factory.mktemp("tables")
    r = [(d, t, None if d is None else "en" if d % 2 else None, None if d == 3 else "src", None if d == 4 else len(t or ""), "x") for d, t in awkward(9)]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    prose = " ".join(f"plain{i} text of its own" for i in range(300))
    r += [(700, f"{prose} {passage} {prose}", "en", "src", 1, "x"), (701, f"la der token=abcdefghijklmnop und 0123456789abcdef " + " ".join(f"w{i}" for i in range(40)), "en", "src", 1, "x"), (702, None, None, None, None, None), (703, "", "fr", "src", 0, "x"), (704, "wort " * 60_000 + "ende", "de", "src", 1, "x")]
    r += [r[-1], r[-4]]
    spark.createDataFrame(r, "doc_id long, text string, lang string, source string, n_chars long, tk string").repartition(3).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(10, 50)] + [(None, 1, None), (12, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage_keeps_what_the_rules_and_the_verdict_keep(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = STAGES["quality_rules"](spark, docs, small)
    refs = quality.references(docs, spark.read.parquet(f"{small}/labels.parquet"))

    def good(t, lang):
        n, chars, _, _, again = quality_counts(t)
        return n >= 20 and 100 * again <= 30 * n and near(t, lang, n, chars, refs)

    assert got.columns == docs.columns
    assert rows_of(got) == sorted((tuple(r) for r in docs.collect() if good(r.text, r.lang)), key=str)


def near(t, lang, n, chars, refs):
    """The distances of one text by their definition, in plain numbers."""
    import math

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    if lang not in {x.lang for x in refs}:
        return True
    kinds = [0] * len(quality.CLASSES)
    for c in t:
        if c not in " \t\n\v\f\r":
            k = 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in ".,;:!?'\"()-" else 4 if ord(c) < 128 else 5 if ord(c) < 0x280 else 6
            kinds[k] += 1
    words = [quality.word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    for x in refs:
        known = [int(w) for w in x.words]
        shares = [words.count(w) / len(words) for w in known]
        by_class = js([k / sum(kinds) for k in kinds], list(x.classes))
        by_word = js([*shares, 1 - sum(shares)], list(x.shares))
        if (chars < quality.MIN_CHARS or by_class <= quality.CHAR_LIMIT + quality.CHAR_SLACK / math.sqrt(chars)) and (n < quality.MIN_WORDS or by_word <= quality.WORD_LIMIT + quality.WORD_SLACK / math.sqrt(n)):
            return True
    return False


def test_dedup_stage_keeps_the_least_of_each_group(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = STAGES["near_dedup"](spark, docs, small)
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r.doc_id is not None:
            least[g] = min(r.doc_id, least.get(g, r.doc_id))
    gone = {r.doc_id for r, g in zip(rows, group, strict=True) if r.doc_id is not None and r.doc_id != least[g]}
    assert got.columns == docs.columns and rows_of(got) == sorted((tuple(r) for r in rows if r.doc_id is None or r.doc_id not in gone), key=str)


def test_decontamination_stage_drops_every_row_with_a_hit(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = STAGES["decontaminate"](spark, docs, small)
    hit = lambda r: overlap_by_brute_force([(r.doc_id, r.text)], items)[0][2] > 0
    assert got.columns == docs.columns and rows_of(got) == sorted((tuple(r) for r in docs.collect() if not hit(r)), key=str)
    assert 700 not in {r.doc_id for r in got.collect()}


def test_secret_stage_replaces_base_spans_and_leaves_the_rest(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = STAGES["redact_secrets"](spark, docs, small)
    assert got.columns == docs.columns and got.count() == docs.count()
    plain = lambda r: not base_secrets(r.text)
    changed = {r.doc_id for r in docs.collect() if not plain(r)}
    assert changed == {701} and rows_of(got.where("doc_id is null or doc_id <> 701")) == sorted((tuple(r) for r in docs.collect() if r.doc_id != 701), key=str)
    assert got.where("doc_id = 701").first().text.startswith("la der [assign] und [hex] w0")


def test_piece_stage_is_lossless_on_all_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = STAGES["encode_pieces"](spark, docs, small)
    assert got.count() == docs.count() and got.where(~F.col("lossless")).count() == 0
    assert sorted((r.doc_id for r in got.where("n_pieces = 0").collect()), key=str) == sorted((r.doc_id for r in docs.collect() if not r.text), key=str)


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0, name


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "redact_secrets", "encode_pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == names, name
        now = spark.createDataFrame(after.collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(want) and 0 < want.count() < docs.count()
