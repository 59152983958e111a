"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted, frequent ones form the vocabulary, and every word is
linked with those one edit away. All deletions of a word and its replacements
by later letters are generated as 64-bit hashes (an insertion is a deletion
of the longer word, a replacement is seen from the smaller letter), probed
against blocked Bloom filters of the vocabulary, one for each word length;
only the few edits that pass become strings and go through a shuffle to an
exact join with the vocabulary, which removes false positives.

The filters are built by Spark in slices and broadcast. They hold BITS bits a
word and at most FILTER_BYTES in all: a larger vocabulary is dealt by a hash
into passes that each broadcast one part's filters, so memory and the rate of
false positives stay the same at every size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarmac.llm.common import materialise, prepare

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5                  # a form is at least so many times as frequent
EVERY = 199                # one run in so many loses a letter
BITS = 16                  # filter bits a word
FILTER_BYTES = 64 << 20    # filters broadcast at once
SLICE = 1 << 14            # blocks of 64 bytes built by one group
LONG = 64                  # words of this many letters and more share a shard
WORDS = 20_000             # words probed by one task
PIECE = 4 << 20            # longer texts are cut into runs one by one
FLUSH = 300_000            # words counted before a task hands them on
CELLS = 1 << 18            # hashes made at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- counting
def damaged(run: str, prefix: int, every: int = EVERY) -> str:
    """The run, without one letter if the hash of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(run.encode("utf-8"), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, every: int = EVERY) -> DataFrame:
    """(word, n) of all words with ``least_letters`` letters or more: maximal
    letter runs of whole texts, A-Z in lower case, see ``damaged``. A NULL
    doc_id reads as an empty text in the hash. Counts are summed inside each
    task first, so a frequent word costs a row for each task."""
    prepare(docs.sparkSession)
    find = re.compile(f"[{LETTERS}]{{{least_letters},}}")   # shorter runs hold no word

    def batch_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                low = text.encode("utf-8").lower().decode("utf-8")          # A-Z only
                runs = Counter(find.findall(low) if len(low) <= PIECE else (m.group() for m in find.finditer(low)))
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for r, k in runs.items():
                    w = damaged(r, prefix, every)
                    if len(w) >= least_letters:
                        total[w] += k
                        size += len(w) > LONG and len(w)
            if len(total) > FLUSH or size > 1 << 25:
                yield batch_of(total)
                total, size = Counter(), 0
        if total:
            yield batch_of(total)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- hashes of edits
def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _mix(h: np.ndarray, length: int) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = h ^ np.uint64(length * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, as a matrix."""
    raw = "".join(words).encode("utf-32-le")
    return np.frombuffer(raw, "<u4").reshape(len(words), length).astype(np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(length, rows) in chunks of bounded size; a very long word is alone."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        step = max(1, CELLS // max(length, 1))
        for at in range(0, len(rows), step):
            yield length, rows[at:at + step].tolist()


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, rows in by_length(words):
        out[rows] = _mix((codes([words[i] for i in rows], length) * _powers(length)).sum(axis=1), length)
    return out


def edit_hashes(c: np.ndarray, alphabet: list[int]) -> Iterator[tuple[int | None, int, np.ndarray, np.ndarray]]:
    """(letter, length, valid, hashes) for words of one length: the deletion
    of each letter (``letter`` None), then the replacement of each by
    ``letter`` where that is larger. Entries that repeat another are not valid."""
    n, length = c.shape
    p = _powers(length + 1)
    whole = c * p[:length]
    if length > 1:
        front = np.cumsum(whole, axis=1) - whole
        back = np.zeros_like(whole)
        back[:, 1:] = c[:, 1:] * p[:length - 1]
        behind = back.sum(axis=1, keepdims=True) - np.cumsum(back, axis=1)
        valid = np.ones((n, length), bool)
        valid[:, 1:] = c[:, 1:] != c[:, :-1]                # deleting either of two equal letters is one edit
        yield None, length - 1, valid, _mix(front + behind, length - 1)
    full = whole.sum(axis=1, keepdims=True)
    for letter in alphabet:
        a = np.uint64(letter)
        yield letter, length, c < a, _mix(full + (a - c) * p[:length], length)


# ---------------------------------------------------------------- filters
@dataclass
class Filters:
    """Blocked Bloom filters of one pass: shard s has blocks
    ``start[s]:start[s + 1]`` of eight 64-bit words; a key sets one bit in
    each word of its block."""
    start: np.ndarray
    passes: int
    turn: int
    words: np.ndarray

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Indices of hashes that may be in the vocabulary."""
        at = np.arange(len(hashes))
        if self.passes > 1:
            at = at[turn_of(hashes, self.passes) == self.turn]
        block = block_of(hashes[at], length, self.start)
        ok = block >= 0
        at, block = at[ok], block[ok] * 8
        bits = bits_of(hashes[at])
        for k in range(8):
            hit = (self.words[block + k] >> ((bits >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) != 0
            at, block, bits = at[hit], block[hit], bits[hit]
        return at


def shard_of(length: int) -> int:
    return min(length, LONG)


def turn_of(hashes: np.ndarray, passes: int) -> np.ndarray:
    return ((hashes * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(33)) % np.uint64(passes)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(16)


def block_of(hashes: np.ndarray, length: int, start: np.ndarray) -> np.ndarray:
    """Block of each hash in the shard of a length, -1 where that is empty."""
    s = shard_of(length)
    many = int(start[s + 1] - start[s])
    if not many:
        return np.full(len(hashes), -1, np.int64)
    return int(start[s]) + (((hashes >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)).astype(np.int64)


def build_filters(vocabulary: DataFrame, start: np.ndarray, passes: int, turn: int) -> Filters:
    """The filters of one pass; each slice of blocks is one group's work."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            h = word_hashes(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            block = np.full(len(words), -1, np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                block[rows] = block_of(h[rows], n, start)
            mine = turn_of(h, passes) == turn
            block, bits = block[mine], bits_of(h[mine]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block // SLICE), pa.array(block % SLICE), pa.array(bits)],
                                             names=["slice", "block", "bits"])

    def build(key, got):
        out = np.zeros(SLICE * 8, np.uint64)
        block, bits = got.column("block").to_numpy() * 8, got.column("bits").to_numpy().view(np.uint64)
        for k in range(8):
            np.bitwise_or.at(out, block + k, np.uint64(1) << ((bits >> np.uint64(6 * k)) & np.uint64(63)))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([out.tobytes()], pa.binary())})

    blocks = int(start[-1])
    words = np.zeros(-(-blocks // SLICE) * SLICE * 8, np.uint64)
    rows = vocabulary.select("word").mapInArrow(place, "slice long, block long, bits long")
    for r in rows.groupBy("slice").applyInArrow(build, "slice long, words binary").toLocalIterator():   # FILTER_BYTES in all
        words[r["slice"] * SLICE * 8:(r["slice"] + 1) * SLICE * 8] = np.frombuffer(r["words"], np.uint64)
    return Filters(start, passes, turn, words)


def layout(sizes: dict[int, int], passes: int) -> np.ndarray:
    """First block of each shard, from words per shard."""
    need = [-(-(-(-sizes.get(s, 0) // passes)) * BITS // 512) for s in range(LONG + 1)]
    return np.cumsum([0, *need])


# ---------------------------------------------------------------- links
def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, an, b, bn): each pair of vocabulary words one edit apart, once.
    ``vocabulary``: (word, n), stored, words distinct and not NULL."""
    spark = vocabulary.sparkSession
    shards = (vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("s"))
              .agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each length below LONG
    sizes = {int(r["s"]): int(r["n"]) for r in shards}
    letters = (vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    alphabet = sorted(ord(r["c"]) for r in letters)         # letters of the run pattern: at most 116
    total = sum(sizes.values())
    passes = max(1, -(-total * BITS // 8 // FILTER_BYTES))
    start = layout(sizes, passes)
    spread = vocabulary.repartition(max(1, -(-total // WORDS)), "word")
    found = None
    for turn in range(passes):
        shared = spark.sparkContext.broadcast(build_filters(vocabulary, start, passes, turn))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters = shared.value
            for b in batches:
                words, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
                for length, rows in by_length(words):
                    c = codes([words[i] for i in rows], length)
                    of, edits = [], []
                    for letter, size, valid, hashes in edit_hashes(c, alphabet):
                        at = np.flatnonzero(valid)
                        at = at[filters.find(hashes.ravel()[at], size)]
                        for i in at.tolist():
                            w, k = words[rows[i // length]], i % length
                            of.append(rows[i // length])
                            edits.append(w[:k] + ("" if letter is None else chr(letter)) + w[k + 1:])
                    if of:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[i] for i in of], pa.string()), pa.array(counts[of]), pa.array(edits, pa.string())],
                            names=["a", "an", "edit"])

        some = spread.select("word", "n").mapInArrow(probe, "a string, an long, edit string")
        some = materialise(some, "spellprobes")
        found = some if found is None else found.unionByName(some)
    exact = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("bn"))
    return found.join(exact, F.col("edit") == F.col("b")).select("a", "an", "b", "bn")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, the length of
    the known path doubling each round. ``steps`` bounds the longest path."""
    cur = materialise(forms.select("word", F.col("form").alias("root")), "spellroots")
    known = 1
    while known < steps:
        ahead = cur.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        cur = materialise(cur.join(ahead, F.col("root") == F.col("_w"), "left")
                          .select("word", F.coalesce("_r", "root").alias("root")), "spellroots")
        known *= 2
    return cur


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word that occurs
    ``least_count`` times or more.

    NULL and empty texts have no words; a run of any length is a word; repeated
    rows count as often as they occur. The near word with the largest n is the
    form if it is ``ratio`` times as frequent as the word (ties: the smallest in
    code-point order). As n grows along forms, paths are short and have no
    cycle. An empty table gives an empty result. Only doc_id and text are read.
    """
    words = count_words(docs, least_letters, every).where(F.col("n") >= least_count)
    vocabulary = materialise(words, "vocabulary")
    pairs = materialise(near_pairs(vocabulary), "spellpairs")
    both = (pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n"))
            .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    near = near.select("word", "n_near", F.col("best")["near"].alias("best"), (-F.col("best")["col1"]).alias("best_n"))
    has = F.col("best_n") >= F.lit(ratio) * F.col("n")
    table = vocabulary.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best_n")).alias("form_n"))
    table = materialise(table, "spellforms")
    most, steps, at = table.agg(F.max("n").alias("n")).first()["n"] or 0, 0, max(1, least_count)
    while at * max(2, ratio) <= most:
        at, steps = at * max(2, ratio), steps + 1
    ends = roots(table.where("form IS NOT NULL").select("word", "form"), steps)
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


ORACLE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
each_run AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
points AS (SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: unicode(c)) AS cs FROM each_run),
bytes AS (SELECT * EXCLUDE (cs), flatten(list_transform(cs, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END)) AS bs FROM points),
hashed AS (SELECT * EXCLUDE (bs), xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bs, lambda b: CAST(b AS BIGINT))),
    lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM bytes),
words AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM vocabulary),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM holes a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM holes a JOIN vocabulary v ON a.rest = v.word),
near AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM links GROUP BY word),
forms AS (SELECT v.word, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n FROM vocabulary v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word)
SELECT f.word, form, w.root, n, n_near, form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL"""
