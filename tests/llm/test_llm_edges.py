"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import common, langid, lattice, licenses, mixing, packing, quality, queries, sharding, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with everything that may go wrong, and columns whose names the operators use inside."""
    rows = [(1, "the of and to in " * 30, "en", "s", 10), (1, "the of and to in " * 30, "en", "s", 10),
            (2, None, None, None, None), (3, "", "en", None, 0), (None, "the of and to", "en", "s", 1),
            (None, None, None, None, None), (4, LONG, "en", "t", 5), (5, LONG, "en", "t", 5), (6, "\n \t", "de", "t", 3),
            (7, "der die und", "de", "", 1), (8, "123 !!! ###", "de", "u", 1), (-9, "der die und das", "de", "u", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("size", "row", "label", "kept", "score", "component_id", "_key", "n", "skey", "page", "bytes", "key", "fp", "node")
    return d.withColumns({c: F.lit("x") for c in extra}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (4, None, 0), (7, 5, 1), (-9, 0, 0), (77, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(docs, labels):
    return {
        "quality": lambda: quality.quality_rules(docs, quality.fit_quality(docs, labels)),
        "simhash": lambda: simhash.near_duplicates(docs),
        "language": lambda: langid.identify(docs, langid.fit_languages(docs)),
        "sharding": lambda: sharding.assign(docs, 1000),
        "licenses": lambda: licenses.scan(docs),
        "toxicity": lambda: toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)),
        "mixing": lambda: mixing.mix(docs),
    }


NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_input_row(odd, labels, name):
    got = operators(odd, labels)[name]()
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert got.count() == odd.count() and ids == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(odd, labels, name):
    got = operators(odd.limit(0), labels.limit(0))[name]()
    assert got.count() == 0 and "doc_id" in got.columns


@pytest.mark.parametrize("name", NAMES)
def test_no_usable_label(odd, labels, name):
    if name in ("quality", "toxicity"):
        assert operators(odd, labels.limit(0))[name]().count() == odd.count()


def test_defined_values(odd, labels):
    q = {r.doc_id: r for r in operators(odd, labels)["quality"]().collect()}
    assert q[2].n_words == 0 and q[2].base_failed and not q[2].kept and q[4].n_words == 200_000
    s = {r.doc_id: r for r in operators(odd, labels)["simhash"]().collect() if r.doc_id is not None}
    assert s[2].fingerprint == "0" * 16 and s[2].component_id == s[3].component_id == s[6].component_id == 2
    assert s[4].component_id == s[5].component_id == 4
    m = {r.doc_id: r for r in operators(odd, labels)["mixing"]().collect()}
    assert m[2].size == 0 and m[2].taken == 0
    t = operators(odd, labels.limit(0))["toxicity"]().collect()
    assert all(r.predicted == 0 for r in t)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, odd, name, stage):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars", "row", "size", "_key")
    got = stage(spark, plain, SF)
    assert got.columns == plain.columns and dict(got.dtypes) == dict(plain.dtypes)
    rows = got.collect()
    assert {r.text for r in rows} <= {r.text for r in plain.collect()}
    assert stage(spark, plain.limit(0), SF).count() == 0
    if name == "language":
        assert all(r.text and any(c.isalpha() for c in r.text) for r in rows)
    if name == "simhash":
        assert len(rows) == len({r.text for r in rows}) and sum(r.doc_id == 1 for r in rows) == 1
        assert sum(not (r.text or "").strip() for r in rows) == 1


def test_packing_edges(odd):
    got = packing.pack(odd, queries.tokenizer_path()).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    empty = [r for r in got if r.doc_id in (2, 3, 6)]
    assert len(empty) == 3 and all(r.length == 1 == r.doc_tokens for r in empty)
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_vectors_and_pages_edges(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.near_vectors(v).count() == 0
    v = spark.createDataFrame([(None, [1.0, 2.0], 1, 5), (3, [1.0, 2.0], 1, 5), (3, [2.0, 4.0], 1, 5), (4, None, None, 5)],
                              "vec_id long, embedding array<float>, label int, cid int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in lattice.near_vectors(v).collect())
    assert got == [("3", 2, 3), ("3", 2, 3), ("4", 0, 4), ("None", 2, 3)]
    p = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(p).count() == 0


def test_pipeline_matches_brute_force_per_stage(spark):
    """Each stage judged on its own input at the smallest size."""
    docs = common.table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    lang = common.materialise(steps["language"](spark, docs, SF), "t")
    pred = langid.identify(docs, langid.fit_languages(docs)).collect()
    assert sorted(r.doc_id for r in lang.collect()) == sorted(
        r.doc_id for r in pred if r.lang_pred != "und" and r.score > 0)
    tox = common.materialise(steps["toxicity"](spark, lang, SF), "t")
    model = toxicity.fit_toxicity(lang, common.table(spark, SF, "labels"))
    assert sorted(r.doc_id for r in tox.collect()) == sorted(
        r.doc_id for r in toxicity.score_toxicity(lang, model).where("predicted = 0").collect())
    sim = common.materialise(steps["simhash"](spark, tox, SF), "t")
    assert sorted(r.doc_id for r in sim.collect()) == sorted(
        {r.component_id for r in simhash.near_duplicates(tox).collect()})
    mixed = common.materialise(steps["mixing"](spark, sim, SF), "t")
    packed = steps["packing"](spark, mixed, SF)
    texts = [r.text for r in mixed.collect()]
    assert len(texts) > 50 and packed.agg(F.sum("length")).first()[0] == sum(
        len(x) + 1 for x in packing.WordTokenizer(queries.tokenizer_path())(pa.array(texts)))
    assert corpus_pipeline.run(spark, SF).columns == packed.columns
