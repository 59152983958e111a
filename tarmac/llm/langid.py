"""Language identification with spans.

Every word with a letter gets one score per learned language: the sum of
log-probabilities of the hashed two- and three-letter windows around its
letters. The script of the word (by code point ranges) narrows the candidate
languages to those that use the script. Viterbi over the words, with a fixed
penalty for switching, labels spans of mixed-language text; the language
that holds most letters is the prediction.

The tables are counted on a bounded sample: at most ``per_lang`` documents of
each language, chosen by a hash of the id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarmac.llm.common import filter_rows, fold, hashed_sample, prepare

BITS = 16
PER_LANG = 3000            # bound of the labelled sample, documents of one language
SMOOTH = 0.5
CLIP = 8.0                 # largest advantage one word gives a language (nats)
SWITCH = 10.0              # penalty for changing the language (nats)
PIECE = 1 << 19            # code points scored at a time
LONG_WORDS = 4096          # texts of more words are labelled in blocks
CELLS = 1 << 21            # block scores held at once
UNKNOWN = "und"

# Code point ranges of scripts (fixed values, inclusive).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0531, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Arabic", 0x08A0, 0x08FF), ("Arabic", 0xFB50, 0xFDFF),
    ("Arabic", 0xFE70, 0xFEFF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = ("Other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


@lru_cache(maxsize=1)
def _planes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and the number of its script."""
    letter = np.zeros(0x110000, bool)
    letter[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = True
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = SCRIPT_NAMES.index(name)
    return letter, script


@dataclass
class LangModel:
    langs: list[str]            # sorted
    two: np.ndarray             # float32[2**BITS, languages], log-probabilities
    three: np.ndarray
    allowed: np.ndarray         # bool[scripts, languages]


_SPACE = re.compile(r"[ \t-\r]")


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(document of each part, parts) of about PIECE code points together. A
    longer text is cut at white space, so no word is cut and every window stays as it is."""
    of: list[int] = []
    group: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        at = 0
        while True:
            end = len(t)
            if end - at > PIECE:
                m = _SPACE.search(t, at + PIECE)
                end = m.start() if m else end
            if group and size + end - at > PIECE:
                yield np.array(of), group
                of, group, size = [], [], 0
            of.append(i)
            group.append(t[at:end])
            size += end - at
            at = end
            if at >= len(t):
                break
    if group:
        yield np.array(of), group


def _windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of the texts as (document of word, letters of word, script of
    word, first window of word, hashes of two, hashes of three). Windows are
    centred on letters; anything else is a boundary. A piece ends at a
    document's end, in a longer document at white space; words without a
    letter are left out."""
    letter, script = _planes()
    for of, group in _pieces(texts):
        low = [t.lower() for t in group]
        u = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), "<u4")
        first = np.cumsum([1] + [len(t) + 1 for t in low])
        pos = np.flatnonzero(letter[u])
        if len(pos):
            v = np.where(letter[u], u, np.uint32(0)).astype(np.uint32)
            a, b, c = v[pos - 1], v[pos], v[pos + 1]
            two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
            three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
            two, three = ((x * np.uint32(0x165667B1)) >> np.uint32(32 - BITS) for x in (two, three))
            space = (u == 32) | ((u >= 9) & (u <= 13))
            word = np.cumsum(space)[pos]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            letters = np.diff(np.append(start, len(pos)))
            doc = of[np.searchsorted(first, pos[start], side="right") - 1]
            yield doc, letters, script[u[pos[start]]], start, two.astype(np.int64), three.astype(np.int64)


def word_scores(model: LangModel, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """(document, letters, scores[word, language], known) of all words with a
    letter. Scores are relative to the word's best language and clipped;
    languages outside the script's candidates get the clip value; a word with
    no candidate scores zero everywhere and is not ``known``."""
    k = len(model.langs)
    parts = []
    for doc, letters, script, start, two, three in _windows(texts):
        s = np.add.reduceat(model.two[two], start, axis=0)
        s += np.add.reduceat(model.three[three], start, axis=0)
        ok = model.allowed[script]
        known = ok.any(axis=1)
        s = np.where(ok, s, -np.inf)
        top = np.where(known, s.max(axis=1), 0)
        s = np.maximum(s - top[:, None], -CLIP)
        s[~known] = 0
        parts.append((doc, letters, s.astype(np.float32), known))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, k), np.float32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best path of one long text, in blocks of about the square root of its
    words that advance together. Max-plus products give the best scores with
    which each block is entered; from there every block takes the ordinary
    steps, and blocks are joined by the states in which they are entered."""
    n, k = scores.shape
    size = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // size)
    s = np.zeros((blocks * size, k))
    s[:n] = scores                                          # padding scores zero: nothing changes behind the end
    s = s.reshape(blocks, size, k)
    own = np.arange(k, dtype=np.int16)
    enter = np.zeros((blocks, k))                           # best scores of the word before the block
    chunk = max(1, CELLS // (k * k))
    for a in range(0, blocks, chunk):
        part = s[a:a + chunk]
        through = -switch * (1.0 - np.eye(k)) + part[:, 0, None, :]     # [block, state before it, state]
        for t in range(1, size):
            through = np.maximum(through, through.max(axis=2, keepdims=True) - switch) + part[:, t, None, :]
        for i in range(len(part)):
            if a + i + 1 < blocks:
                enter[a + i + 1] = (enter[a + i][:, None] + through[i]).max(axis=0)
    came = np.empty((size, blocks, k), np.int16)
    best, every = enter, np.arange(blocks)
    for t in range(size):
        top = best.argmax(axis=1)
        lead = best[every, top] - switch
        came[t] = np.where(best >= lead[:, None], own, top[:, None].astype(np.int16))
        best = np.maximum(best, lead[:, None]) + s[:, t]
    start = np.tile(own, (blocks, 1))                       # state before the block, for each state at its end
    for t in range(size - 1, -1, -1):
        start = np.take_along_axis(came[t], start.astype(np.int64), axis=1)
    state = np.empty(blocks, np.int64)
    state[-1] = best[-1].argmax()
    for i in range(blocks - 1, 0, -1):
        state[i - 1] = start[i, state[i]]
    path = np.empty((size, blocks), np.int16)
    for t in range(size - 1, -1, -1):
        path[t] = state
        state = came[t][every, state].astype(np.int64)
    return path.T.reshape(-1)[:n]


def viterbi(doc: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language number of every word. All documents advance together,
    longest first; a tie stays in the same language, then takes the first.
    Documents of more than LONG_WORDS words are labelled on their own."""
    n, k = scores.shape
    path = np.zeros(n, np.int16)
    if not n or k < 2:
        return path
    _, first, count = np.unique(doc, return_index=True, return_counts=True)
    for a, c in zip(first[count > LONG_WORDS].tolist(), count[count > LONG_WORDS].tolist()):
        path[a:a + c] = _block_path(scores[a:a + c], switch)
    first, count = first[count <= LONG_WORDS], count[count <= LONG_WORDS]
    if not len(first):
        return path
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    falling = -count
    came = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    best = scores[first].astype(np.float64)
    for t in range(1, int(count[0])):
        m = int(np.searchsorted(falling, -t, side="left"))      # documents longer than t words
        prev, at = best[:m], first[:m] + t
        top = prev.argmax(axis=1)
        lead = prev[np.arange(m), top] - switch
        stay = prev >= lead[:, None]
        came[at] = np.where(stay, own, top[:, None].astype(np.int16))
        best[:m] = np.maximum(prev, lead[:, None]) + scores[at]
    state = best.argmax(axis=1).astype(np.int16)
    path[first + count - 1] = state
    for t in range(int(count[0]) - 1, 0, -1):
        m = int(np.searchsorted(falling, -t, side="left"))
        at = first[:m] + t
        state[:m] = came[at, state[:m]]
        path[at - 1] = state[:m]
    return path


def predict(model: LangModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, spans) of each text. Score: share of the letters that
    lie in words of a known script labelled with the language. ``und`` with
    score 0 for NULL texts, texts without a letter, or a model without
    languages."""
    n, k = len(texts), len(model.langs)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
    doc, letters, scores, known = word_scores(model, texts)
    path = viterbi(doc, scores)
    held = np.bincount(doc * k + path, letters * known, minlength=n * k).reshape(n, k)
    total = np.bincount(doc, letters, minlength=n)
    spans = np.bincount(doc, np.concatenate([[True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])])
                        if len(doc) else None, minlength=n).astype(np.int64)
    best = held.argmax(axis=1)
    score = np.where(total > 0, held[np.arange(n), best] / np.maximum(total, 1), 0.0)
    lang = [model.langs[b] if t > 0 else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
    return lang, score, spans


def learnable() -> Column:
    """Rows that a model of the registered query may learn from."""
    return F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1)


def fit_languages(docs: DataFrame, learn: Column | None = None, per_lang: int = PER_LANG) -> LangModel:
    """Window counts of at most ``per_lang`` documents of each language.

    Only (doc_id, lang) is sampled; the chosen ids are bounded by ``per_lang``
    times the number of languages. Counting runs on the executors; per task and
    language one table of fixed size returns. Rows with NULL lang, text or id
    teach nothing (a chosen row without a text is not replaced by another); no
    usable row gives a model without languages.
    """
    learn = learnable() if learn is None else learn
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang")      # no text is read to choose
    ids = hashed_sample(rows, ["lang"], per_lang, 5)
    sample = (docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).where("text IS NOT NULL")
              .groupBy("doc_id", "lang").agg(F.min("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, found = 1 << BITS, {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                two, three, used = found.setdefault(lang, [np.zeros(size), np.zeros(size), np.zeros(len(SCRIPT_NAMES))])
                for _, letters, script, _, h2, h3 in _windows([t for x, t in zip(langs, texts) if x == lang]):
                    two += np.bincount(h2, minlength=size)
                    three += np.bincount(h3, minlength=size)
                    used += np.bincount(script, letters, minlength=len(SCRIPT_NAMES))
        for lang, parts in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), *(pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in parts)],
                names=["lang", "two", "three", "used"])

    def add(key, got):
        sums = [sum(np.frombuffer(x.as_py(), "<f4") for x in got.column(c)).astype("<f4").tobytes() for c in ("two", "three", "used")]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()),
                         **{c: pa.array([x], pa.binary()) for c, x in zip(("two", "three", "used"), sums)}})

    schema = "lang string, two binary, three binary, used binary"
    rows = (sample.select("lang", "text").coalesce(8).mapInArrow(count, schema)
            .groupBy("lang").applyInArrow(add, schema).collect())           # one row for each language
    langs = sorted({r["lang"] for r in rows})
    size, k = 1 << BITS, len(langs)
    two, three, used = np.zeros((size, k)), np.zeros((size, k)), np.zeros((len(SCRIPT_NAMES), k))
    for r in rows:
        at = langs.index(r["lang"])
        for into, name in ((two, "two"), (three, "three"), (used, "used")):
            into[:, at] += np.frombuffer(r[name], "<f4")

    def logs(c):
        return np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * size)).astype(np.float32)

    return LangModel(langs, logs(two), logs(three), used > 0.01 * np.maximum(used.sum(axis=0), 1))


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans), one row per input row.
    Only doc_id and text are read. A NULL id is not held out."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # 1 MB for each pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score, spans = predict(m, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(spans, pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long"))


def language_spans(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, first_word, words, lang): the spans of every document; words
    are counted among the words that hold a letter. Documents without such a
    word have no row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            doc, _, scores, _ = word_scores(m, b.column(1).to_pylist())
            if not len(doc) or not m.langs:
                continue
            path = viterbi(doc, scores)
            start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])]))
            begin = np.searchsorted(doc, doc[start], side="left")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc[start])), pa.array(start - begin, pa.int64()),
                 pa.array(np.diff(np.append(start, len(doc))), pa.int64()),
                 pa.array([m.langs[x] for x in path[start]], pa.string())],
                names=["doc_id", "first_word", "words", "lang"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, first_word long, words long, lang string"))


def keep_identified(docs: DataFrame, model: LangModel, min_score: float = 0.0) -> DataFrame:
    """The documents whose language is known, with at least ``min_score`` if
    one is given; all columns unchanged. NULL texts, texts without a letter and
    texts without a word of a known script are rejected."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep_of():
        m = shared.value

        def keep(texts):
            lang, score, _ = predict(m, texts)
            return (np.array(lang, dtype=object) != UNKNOWN) & (score > 0) & (score >= min_score)
        return keep

    return filter_rows(docs, "text", keep_of)
