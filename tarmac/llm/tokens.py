"""Token ids of whole texts by looking up the ids of their units.

A unit is a stretch of text that the tokenizer never joins with its
neighbours, so a text's ids are its units' ids in order. The units of a batch
are numbered by Arrow's dictionary encoding; only distinct units are looked
up in a memory that lives as long as the Python worker, only units not held
there are encoded, and the ids of all units are gathered by numpy.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 700_000             # units remembered, in two halves
ARENA = 8_000_000          # ids remembered in a half
LONG = 64                  # longer units are not remembered
GROUP = 8 << 20            # bytes of text whose units are numbered together
JOINED = 20_000            # units encoded together as one text

MARK = "\x01"              # before a unit: no blank before it

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def load_tokenizer(path: str):
    """The tokenizer of a file, one thread (tasks are the parallelism)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def added_texts(tok) -> list[str]:
    """Texts of the added tokens, which a tokenizer finds before all else."""
    return sorted(t.content for t in tok.get_added_tokens_decoder().values())


class Half:
    """Units and their ids: unit -> row, rows are stretches of one array."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint16)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lens = np.empty(1 << 14, dtype=np.int64)
        self.odd = np.empty(1 << 14, dtype=bool)
        self.used = self.rows = 0

    def add(self, ids: np.ndarray, lens: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """New rows, laid end to end in ``ids``; returns their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.rows + len(lens) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.empty_like(self.lens)])
            self.odd = np.concatenate([self.odd, np.empty_like(self.odd)])
        rows = np.arange(self.rows, self.rows + len(lens))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[rows] = self.used + np.cumsum(lens) - lens
        self.lens[rows] = lens
        self.odd[rows] = odd
        self.used, self.rows = self.used + len(ids), self.rows + len(lens)
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows end to end, and how many each has."""
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[rows] - ends + lens, lens)
        at += np.arange(total)
        return self.ids[at], lens


class UnitMemory:
    """Remembered units in a young and an old half; the old half is forgotten
    first. ``encode`` maps units to (ids end to end, lengths, odd flags)."""

    def __init__(self, encode, most: int = MEMO):
        self.encode, self.most = encode, most
        self.young, self.old = Half(), Half()

    def turn(self) -> None:
        """Make room before a batch."""
        if len(self.young.row) > self.most // 2 or self.young.used > ARENA:
            self.old, self.young = self.young, Half()

    def rows(self, units: list[str]) -> np.ndarray:
        """Rows of the young half for distinct units."""
        young, old = self.young, self.old
        out = np.fromiter(map(young.row.get, units, repeat(-1)), np.int64, len(units))
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out
        lost = [units[i] for i in miss.tolist()]
        known = np.fromiter(map(old.row.get, lost, repeat(-1)), np.int64, len(lost))
        back = np.flatnonzero(known >= 0)
        if len(back):
            ids, lens = old.gather(known[back])
            self._keep([lost[i] for i in back.tolist()], miss[back], out, ids, lens, old.odd[known[back]])
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            words = [lost[i] for i in fresh.tolist()]
            self._keep(words, miss[fresh], out, *self.encode(words))
        return out

    def _keep(self, words: list[str], at: np.ndarray, out: np.ndarray, ids, lens, odd) -> None:
        out[at] = rows = self.young.add(ids, lens, odd)
        self.young.row.update((w, r) for w, r in zip(words, rows.tolist()) if len(w) <= LONG)


def grouped(sizes: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Spans of rows with about ``most`` bytes together; a longer row alone."""
    at, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > at and total + s > most:
            yield at, i
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def ids_of(encodings) -> tuple[np.ndarray, np.ndarray]:
    """Ids of several encodings end to end, and their lengths."""
    got = [e.ids for e in encodings]
    return (np.fromiter(chain.from_iterable(got), np.uint16),
            np.fromiter(map(len, got), np.int64, len(got)))


# Letters (ASCII and Latin-1). Neither tokenizer ever joins one with the closing punctuation behind it.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
CLOSING = ".,!?;:*#$%&|"
_PLAIN = re.compile(f"[{LETTERS}]+")


def is_plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word) is not None)


class UnitTokenizer:
    """What both tokenizers share: added tokens, groups, and the look-up."""

    def __init__(self, path: str):
        self.tok = load_tokenizer(path)
        self.size = self.tok.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self.added = added_texts(self.tok)
        self.memory = UnitMemory(self._encode)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Lists of units of each text."""
        raise NotImplementedError

    def _look(self, lists: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids of each list of units, does it hold an odd unit)."""
        offsets = lists.offsets.to_numpy()
        units = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        numbered = units.dictionary_encode()
        rows = self.memory.rows(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        half = self.memory.young
        odd = np.concatenate([[0], np.cumsum(half.odd[rows])])[offsets]
        ids, lens = half.gather(rows)
        ends = np.concatenate([[0], np.cumsum(lens)])[offsets]
        return np.split(ids, ends[1:-1]), odd[1:] > odd[:-1]

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that hold no added token."""
        self.memory.turn()
        return self._look(self._cut(texts))[0]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (16 bits) of each text; NULL and empty texts have none. A text
        that may hold an added token goes through the tokenizer as a whole."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for a in [*self.added, MARK]:
            special |= pc.match_substring(texts, a, ignore_case=True).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        for i in np.flatnonzero(special).tolist():
            out[i] = self._whole(texts[i].as_py())
        plain = np.flatnonzero(~special & (size > 0))
        for a, b in grouped(size[plain]):
            part = plain[a:b]
            for i, x in zip(part.tolist(), self._group(texts.take(pa.array(part)))):
                out[i] = x
        return out


class BlankTokenizer(UnitTokenizer):
    """Ids of texts under a byte-level tokenizer whose pieces hold a blank at
    their front only.

    A single blank between two characters that are not white space begins a
    piece, so texts are cut there; they are also cut around a single line end
    and between a letter and closing punctuation, where a mark stands for "no
    blank before". Texts with other white space beside a blank or line end are
    cut at safe blanks only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__(path)
        # Plain words with a blank before each are pieces: the same model without the search for pieces.
        self.quick = Tokenizer(self.tok.model)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Bytes of each id: a byte-level vocabulary writes every byte as one character.
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.size)], dtype=np.int64)

    def _joined(self, tok, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words with a blank before each, many at a time."""
        ids, lens = [], []
        for at in range(0, len(words), JOINED):
            part = words[at:at + JOINED]
            got = np.array(tok.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint16)
            ends = np.cumsum(1 + pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64))
            lens.append(np.diff(np.searchsorted(np.cumsum(self.width[got]), ends) + 1, prepend=0))
            ids.append(got)
        return flat(ids), np.concatenate(lens) if lens else np.zeros(0, np.int64)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds: list[list[int]] = [[], [], [], []]           # plain, other, without a blank, odd
        for i, u in enumerate(units):
            if is_plain(u):
                kinds[0].append(i)
            elif not u or u[0].isspace() or u[-1].isspace():
                kinds[2 if u == MARK + "\n" else 3].append(i)
            elif u[0] == MARK:
                kinds[3 if len(u) == 1 or u[1].isspace() else 2].append(i)
            else:
                kinds[1].append(i)
        plain, other, bare, odd = ([units[i] for i in k] for k in kinds)
        parts = [self._joined(self.quick, plain), self._joined(self.tok, other),
                 ids_of(self.tok.encode_batch_fast([u[1:] for u in bare], add_special_tokens=False)),
                 ids_of(self.tok.encode_batch_fast([u[1:] if u[:1] == MARK else " " + u for u in odd], add_special_tokens=False))]
        order = np.argsort(np.array([i for k in kinds for i in k], dtype=np.int64))
        ids, lens = flat([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        flags = np.repeat([False, False, False, True], [len(k) for k in kinds])
        half = Half()
        return *half.gather(half.add(ids, lens, flags)[order]), flags[order]

    def _cut(self, texts: pa.Array) -> pa.Array:
        lined = pc.replace_substring(pc.binary_join_element_wise(MARK, texts, ""), "\n", f" {MARK}\n {MARK}")
        closed = pc.replace_substring_regex(lined, f"([{LETTERS}])([{re.escape(CLOSING)}])", rf"\1 {MARK}\2")
        return pc.split_pattern(closed, " ")

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        self.memory.turn()
        out, odd = self._look(self._cut(texts))
        again = np.flatnonzero(odd).tolist()
        if again:
            pieces = [_SAFE.split(MARK + texts[i].as_py()) for i in again]
            for i, x in zip(again, self._look(pa.array(pieces, pa.list_(pa.string())))[0]):
                out[i] = x
        return out


class WordTokenizer(UnitTokenizer):
    """Ids of texts under a tokenizer that drops white space and never joins
    two words: a text's ids are its words' ids in order. Letters and the
    closing punctuation behind them are two words to it.

    Plain words are encoded many at a time: each ends at its one word-end
    token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        super().__init__(path)
        # Plain lower-case words need no normaliser and split at blanks only: the same model without those steps.
        self.quick = Tokenizer(self.tok.model)
        self.quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        good = np.fromiter(map(is_plain, units), bool, len(units))
        plain = [u for u, g in zip(units, good.tolist()) if g]
        rest = [u for u, g in zip(units, good.tolist()) if not g]
        ids, lens = [], []
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            got = np.array(self.quick.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, dtype=np.uint16)
            size = np.diff(np.flatnonzero(self.ends[got]), prepend=-1)
            if len(size) != len(part):                      # a word without a word-end token
                got, size = ids_of(self.tok.encode_batch_fast(part, add_special_tokens=False))
            ids.append(got)
            lens.append(size)
        got, size = ids_of(self.tok.encode_batch_fast(rest, add_special_tokens=False))
        order = np.argsort(np.concatenate([np.flatnonzero(good), np.flatnonzero(~good)]))
        half = Half()
        rows = half.add(flat([*ids, got]), np.concatenate([*lens, size]), np.zeros(len(units), bool))
        return *half.gather(rows[order]), np.zeros(len(units), bool)

    def _cut(self, texts: pa.Array) -> pa.Array:
        # The tokenizer lowers letters itself; lowering A-Z first makes more words equal.
        closed = pc.replace_substring_regex(pc.ascii_lower(texts), f"([{LETTERS}])([{re.escape(CLOSING)}])", r"\1 \2")
        return pc.ascii_split_whitespace(closed)


_kept: dict[tuple[type, str], UnitTokenizer] = {}


def shared(kind: type[UnitTokenizer], path: str) -> UnitTokenizer:
    """One tokenizer of a kind and file for all tasks of a Python worker."""
    key = (kind, path)
    if key not in _kept:
        _kept[key] = kind(path)
    return _kept[key]


def forget() -> None:
    """Free the tokenizers of this worker."""
    _kept.clear()
