"""Whitening, token files, spelling variants and the unit tokenizers."""

import glob
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm import langid, mixing, queries, spelling, tokenfile, tokens, whitening
from tarmac.session import work_dir
from tests.conftest import SF_SMALL as SF

ODD = ["", "  ", "a  b", " x y", "x y ", "a \n b", "l1\n\nl2  three", "don't it's  we'll", "<|endoftext|> hi", "a<|EndOfText|>b c",
       None, "é è ü 12 345 $%^ x", "tab\tx \ty", "\x1c a \x1d b", "日本語 テスト です。", "a" * 300 + " " + "b" * 500, "é ́x x́",
       "İstanbul ǅ ﬁ", "a\x01b c", "w.\nX y", "w\n", "\nw", "a.\n\nb", "a,b.c!? d", "\x01", "x\x85y 　z", "½ ² Ⅷ a1b2"]


@pytest.mark.parametrize("kind,name", [(tokens.BlankTokenizer, "byte_bpe_50k.json"), (tokens.WordTokenizer, "word_bpe_49k.json")])
def test_unit_tokenizers_equal_the_library(kind, name):
    path = queries.tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    texts = ODD + [(a or "") + " " + (b or "") for a in ODD for b in ODD]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most, group in ((tokens.MEMO, tokens.GROUP), (8, 100)):     # forgetting and grouping change nothing
        tok = kind(path)
        tok.memory.most = most
        for _ in range(2):
            got = [x.tolist() for a, b in tokens.grouped(np.full(len(texts), 10), group)
                   for x in tok(pa.array(texts[a:b], pa.string()))]
            assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.,!'\n\t1", max_size=30), min_size=1, max_size=5))
def test_blank_tokenizer_on_random_texts(texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = tokens.shared(tokens.BlankTokenizer, path)
    assert [x.tolist() for x in tok(pa.array(texts, pa.string()))] == [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]


# ---------------------------------------------------------------- op12
def _plain_ids(text):
    tok = tokens.shared(tokens.BlankTokenizer, queries.tokenizer_path("byte_bpe_50k.json")).tok
    return tok.encode(text or "", add_special_tokens=False).ids + [tokenfile.CLOSING]


def test_token_files_equal_the_plain_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_token_files(spark, SF).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = _plain_ids(r.text)
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == docs.count()


def test_token_files_edges(spark):
    long = "word " * 40_000
    rows = [(3, "a b"), (None, "none"), (3, "a b"), (1, None), (2, ""), (5, long), (3, "other"), (None, None), (-4, "x <|endoftext|> y")]
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in rows], "doc_id long, text string, ids string, n long")
    folder = work_dir(spark, "t") + "/files"
    tokenfile.write(tokenfile.encode(docs, queries.tokenizer_path(tokenfile.TOKENIZER), frame_ids=1_000), folder, file_ids=20_000)
    out = tokenfile.read_digests(spark, folder).collect()
    want = Counter((i, len(_plain_ids(t)), zlib.crc32(np.array(_plain_ids(t), "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at, last = 0, None
    for r in sorted(out, key=lambda r: r.start):            # ascending, NULL first, no gap
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    wanted = spark.createDataFrame([(5,), (None,), (77,)], "doc_id long")
    found = tokenfile.read_documents(spark, folder, wanted).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, len(r.ids) // 2) for r in found) == sorted(
        (-1 if i is None else i, len(_plain_ids(t))) for i, t in rows if i in (5, None))
    empty = tokenfile.token_files(docs.limit(0), queries.tokenizer_path(tokenfile.TOKENIZER))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_equal_ids_are_spread_over_files(spark):
    docs = spark.createDataFrame([(7, "same text here")] * 4_000, "doc_id long, text string").repartition(6)
    folder = work_dir(spark, "t") + "/files"
    tokenfile.write(tokenfile.encode(docs, queries.tokenizer_path(tokenfile.TOKENIZER)), folder, file_ids=2_000)
    sizes = [r["count"] for r in tokenfile.document_table(spark, folder).groupBy("path").count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) > 4 and max(sizes) < 1_500
    assert sorted(r.start for r in tokenfile.read_digests(spark, folder).collect()) == list(range(0, 16_000, 4))


def test_only_requested_frames_are_read_and_damage_is_found(spark, tmp_path):
    import io
    import zstandard
    stream = io.BytesIO()
    w, zipper = tokenfile.Writer(stream), tokenfile.compressor()
    docs = {1: np.arange(10), 2: np.arange(3), 4: np.arange(100, 104)}
    for d, ids in docs.items():
        w.add(d, tokenfile.frames_of(zipper, ids.astype("<u2").tobytes(), 4))
    w.close()
    raw = stream.getvalue()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(x.astype("<u2").tobytes() for x in docs.values())      # an ordinary reader skips the tables
    r = tokenfile.Reader(io.BytesIO(raw), len(raw))
    assert r.n_frames.tolist() == [3, 1, 1] and r.start.tolist() == [0, 10, 13]
    bad = bytearray(raw)
    at = int(r.begin[int(r.first[1])]) + 8
    bad[at] ^= 0xFF                                         # damage document 2
    r = tokenfile.Reader(io.BytesIO(bytes(bad)), len(bad))
    assert b"".join(r.frames(0)) == docs[1].astype("<u2").tobytes() and b"".join(r.frames(2)) == docs[4].astype("<u2").tobytes()
    with pytest.raises(Exception):
        b"".join(r.frames(1))
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_a_repeated_write_gives_the_same_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = tokenfile.encode(docs, queries.tokenizer_path(tokenfile.TOKENIZER))
    seen = []
    for _ in range(2):
        folder = work_dir(spark, "t") + "/files"
        tokenfile.write(ids, folder)
        seen.append(b"".join(open(f, "rb").read() for f in sorted(glob.glob(folder.removeprefix("file:") + "/part-*"))))
        assert not glob.glob(folder.removeprefix("file:") + "/_*")
    assert seen[0] == seen[1] and seen[0]


# ---------------------------------------------------------------- op11
def _factors():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    yield "random", rng.normal(size=(40, 12))
    yield "one", np.array([[2.0]])
    yield "wide", rng.normal(size=(3, 9))
    yield "equal values", np.diag([3.0, 3, 3, 1, 1])
    yield "clusters", (q * np.repeat([5.0, 2, 1], 10)) @ q.T
    yield "graded", (q * np.logspace(0, -5, 30)) @ q.T
    yield "zero", np.zeros((4, 4))
    yield "near diagonal", np.diag(np.arange(1.0, 20)) + np.diag(np.full(18, 1e-9), 1)
    w = np.diag(np.abs(np.arange(-10, 11)) + 11.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield "close pairs", np.linalg.cholesky(w).T


@pytest.mark.parametrize("name,r", list(_factors()), ids=lambda x: x if isinstance(x, str) else "")
def test_solver_against_singular_values(name, r):
    values, v = whitening.principal(r)
    want = np.zeros(r.shape[1])
    s = np.linalg.svd(r, compute_uv=False) ** 2
    want[:len(s)] = s
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-11
    assert np.abs(v @ (r.T @ r) - values[:, None] * v).max() < 1e-12 * top


def test_dqds_keeps_small_values_accurate():
    a, b = np.array([1.0, 1e-5, 1e-10, 1e-14]), np.array([1e-3, 1e-8, 1e-12])
    from decimal import Decimal, getcontext
    getcontext().prec = 60
    det = 1
    for x in a:
        det *= Decimal(float(x)) ** 2
    got = 1
    for x in whitening.dqds(a, b):
        got *= Decimal(float(x))
    assert abs(got / det - 1) < Decimal("1e-13")            # the product of all values, the small ones included


def _brute_whiten(x_rows, k=4):
    fit = np.array(sorted({tuple(x) for x in x_rows}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def test_whitening_equals_numpy(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64) for r in vecs.collect()}
    n, s, e, v, trace = _brute_whiten(x.values())
    out = queries.op11_whitening(spark, SF).collect()
    assert len(out) == 4 * len(x)
    got = {(r.vec_id, r.component): r for r in out}
    for c in range(4):
        want = np.array([((x[i] * n - s) / n) @ v[:, c] / np.sqrt(e[c]) for i in sorted(x)])
        have = np.array([got[i, c + 1].whitened for i in sorted(x)])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-9
        assert abs(got[min(x), c + 1].explained / (e[c] / trace) - 1) < 1e-10
    for i in x:
        assert got[i, 1].deviation == int(((n * x[i] - s).astype(object) ** 2).sum()) and got[i, 1].n == n
    assert out[0].identity_error < 1e-10 and len({r.identity_error for r in out}) == 1


def test_factors_merge_to_the_same_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(9)
    distinct = whitening.integer_vectors(vecs.select("embedding")).select("x").distinct().repartition(9)
    totals = whitening._exact_sums(distinct)
    (d, r), = whitening.triangular_factors(distinct, totals).items()
    x = np.array([q.x for q in distinct.collect()], dtype=np.float64)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10, atol=1e-8) and totals[d][0] == len(x)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, -1.5]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [0.0, 0.25]), (8, [0.0, 0.25]), (9, []), (10, [5.0]), (11, [1e300, 0.0]), (12, [-0.001, 7.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, x string")
    out = whitening.whiten(df).collect()
    two = [r for r in out if r.vec_id != 10]
    assert Counter(r.vec_id for r in two) == Counter({1: 2, 2: 2, None: 2, 8: 4, 12: 2})
    assert {r.n for r in two} == {4} and all(r.identity_error < 1e-10 for r in two)
    one = [r for r in out if r.vec_id == 10]                # a length of its own: one row, no variance
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0)]
    same = {r.vec_id: r.whitened for r in two if r.component == 1}
    assert same[1] == same[2]
    x = [[256, 512], [768, -384], [0, 64], [-1, 1792]]
    n, s, e, v, trace = _brute_whiten(x)
    assert abs(same[1]) == pytest.approx(abs(((np.array(x[0]) * n - s) / n) @ v[:, 0] / np.sqrt(e[0])), rel=1e-10)
    assert whitening.whiten(df.limit(0)).collect() == []
    big = spark.createDataFrame([(1, [2.0 ** 40, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(big).where("component = 1").collect()}
    assert got[1].deviation is None and int(got[1].deviation_exact) == (3 * 2 ** 48 - 2 ** 48 - 256) ** 2 + 256 ** 2


# ---------------------------------------------------------------- op13
def _brute_words(rows, every=spelling.EVERY):
    import re
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def _brute_variants(rows):
    vocab = _brute_words(rows)
    form, near = {}, {}
    for w, n in vocab.items():
        near[w] = [v for v in vocab if v != w and _near(v, w)]
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else vocab[form[w]]))
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def _variant_rows(seed=3):
    rng = random.Random(seed)
    base = ["colour", "behaviour", "aaaaaa", "étrange", "mississippi", "ÿÿÿÿÿÿß", "×multi÷ply", "z" * 90]
    words = []
    for w in base:
        v = w
        for size in (400, 60, 12):                          # a path of forms
            for _ in range(size < 400):
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + v[i + 1:], v[:i] + rng.choice("abzéà") + v[i:], v[:i] + rng.choice("abzéà") + v[i + 1:]])
            words += [v] * size
        words += [w[:-1]] * 7 + [w + "s"] * 5 + [w[0] + w] * 6
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return rows + [(None, "COLOUR, colour"), (3, None), (4, ""), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]


def test_spelling_variants_equal_brute_force(spark):
    rows = _variant_rows()
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n long, word string")
    want = _brute_variants(rows)
    assert any(r[1] for r in want) and any(r[2] != r[0] and r[2] != r[1] for r in want)
    assert _got(spelling.variants(df)) == want
    assert spelling.variants(df.limit(0)).collect() == []


def test_spelling_in_passes_and_small_pieces(spark, monkeypatch):
    rows = _variant_rows(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(spelling, "FILTER_BYTES", 64)       # several passes over the vocabulary
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "FLUSH", 3)
    monkeypatch.setattr(spelling, "CELLS", 20)
    monkeypatch.setattr(spelling, "WORDS", 10)
    assert _got(spelling.variants(df)) == _brute_variants(rows)


def test_very_long_runs(spark):
    run = "ab" * 50_000
    rows = [(i, f"{run} {run[:-1]}c short") for i in range(6)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[run].n_near >= 1 and all(r.root == w for w, r in got.items())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=7), min_size=1, max_size=25, unique=True))
def test_edit_hashes_meet_all_near_words(words):
    """Hashes of the edits of one word of each near pair equal the other's."""
    h = dict(zip(words, spelling.word_hashes(words).tolist()))
    found = set()
    for length, rows in spelling.by_length(words):
        c = spelling.codes([words[i] for i in rows], length)
        for letter, size, valid, hashes in spelling.edit_hashes(c, sorted(map(ord, "abcé"))):
            for r, k in zip(*np.nonzero(valid)):
                w = words[rows[r]]
                edit = w[:k] + ("" if letter is None else chr(letter)) + w[k + 1:]
                assert len(edit) == size
                if edit in h:
                    assert h[edit] == int(hashes[r, k])
                    pair = tuple(sorted((w, edit)))
                    assert pair not in found                # each pair once
                    found.add(pair)
    assert found == {tuple(sorted((a, b))) for a in words for b in words if a != b and _near(a, b)}


def test_filters_have_no_false_negatives(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    start = spelling.layout({7: len(words)}, 1)
    f = spelling.build_filters(df, start, 1, 0)
    assert len(f.find(spelling.word_hashes(words), 7)) == len(words)
    other = spelling.word_hashes([w.upper() for w in words])
    assert len(f.find(other, 7)) < 0.02 * len(words) and len(f.find(other, 9)) == 0


# ---------------------------------------------------------------- op3, long texts
def _plain_viterbi(scores, switch):
    best, came = scores[0].astype(np.float64), []
    for row in scores[1:]:
        lead = best.max() - switch
        came.append(np.where(best >= lead, np.arange(len(best)), best.argmax()))
        best = np.maximum(best, lead) + row
    path = [int(best.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("n,k", [(1, 2), (2, 3), (7, 2), (50, 4), (333, 5), (2000, 3)])
def test_block_path_equals_word_by_word(n, k, monkeypatch):
    rng = np.random.default_rng(n * 10 + k)
    scores = (-rng.integers(0, 64, size=(n, k)) / 8).astype(np.float32)
    want = _plain_viterbi(scores, 10.0)
    assert langid._block_path(scores, 10.0).tolist() == want
    monkeypatch.setattr(langid, "CELLS", 1)
    assert langid._block_path(scores, 10.0).tolist() == want
    doc = np.repeat([0, 1, 2], [3, n, 2])
    both = np.concatenate([scores[:1].repeat(3, 0), scores, scores[:1].repeat(2, 0)])
    short = langid.viterbi(doc, both)
    monkeypatch.setattr(langid, "LONG_WORDS", 2)
    assert langid.viterbi(doc, both).tolist() == short.tolist()


def test_long_texts_in_pieces_equal_the_whole(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    texts = [r.text for r in docs.limit(40).collect()]
    mixed = [" ".join(t or "" for t in texts), None, "", "x" * 5000, "a\tb\n" * 900, *texts]
    whole = langid.predict(model, mixed)
    monkeypatch.setattr(langid, "PIECE", 700)
    monkeypatch.setattr(langid, "LONG_WORDS", 50)
    cut = langid.predict(model, mixed)
    assert cut[0] == whole[0] and np.allclose(cut[1], whole[1]) and cut[2].tolist() == whole[2].tolist()


def test_an_eight_megabyte_text_is_labelled_in_seconds(spark):
    import time
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    text = " ".join(r.text or "" for r in docs.collect())
    text = (text * (1 + (8 << 20) // len(text)))[:8 << 20]
    t = time.process_time()
    lang, score, _ = langid.predict(model, [text])
    assert lang[0] in model.langs and score[0] > 0.2 and time.process_time() - t < 20     # 69 s word by word


def test_simhash_stage_with_map_and_dotted_columns(spark):
    from tarmac.llm import simhash
    rows = [(1, "one two three four five", {"a": 1}, "x"), (1, "something else entirely here now", {"b": 2}, "y"),
            (1, "one two three four five", {"a": 1}, "x"), (2, "one two three four five", {}, "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, ""), (1, "one two three four five"), (1, "something else entirely here now")]


def test_language_stage_with_map_and_dotted_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_languages(docs)
    odd = docs.limit(30).withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "a.b": F.lit("z")})
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() <= 30 and kept.first()["a.b"] == "z"


# ---- op10 ------------------------------------------------------------------------------------------------------

def _mixed_by_sql(rows):
    import duckdb
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                       "source": pa.array([r[1] for r in rows], pa.string()),
                                       "text": pa.array([r[2] for r in rows], pa.string())}))
    return sorted(map(str, db.execute(mixing.ORACLE_SQL).fetchall()))


@pytest.mark.parametrize("kind", ["no id", "one id", "equal rows"])
def test_mixing_buckets_stay_small(spark, kind):
    n = 20_000
    rows = [(None if kind == "no id" else 5, "a", "same words" if kind == "equal rows" else f"text {i} " + "x " * (i % 7)) for i in range(n)]
    rows += [(10 + i, "b", f"other {i}") for i in range(300)] + [(None, None, None), (None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    keyed, narrow = mixing._keyed(docs)
    targets = mixing.source_targets(narrow)
    sizes = narrow.join(targets, "skey").groupBy("skey", mixing._bucket().alias("bucket")).count().collect()
    assert sum(r["count"] for r in sizes) == len(rows) == keyed.count()
    assert max(r["count"] for r in sizes) <= (3 if kind == "equal rows" else 1.1) * mixing.BUCKET_ROWS
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot").collect()
    assert sorted(str(tuple(r)) for r in got) == _mixed_by_sql(rows)
    assert sum(r.taken for r in got) == sum(r.take for r in targets.collect())
