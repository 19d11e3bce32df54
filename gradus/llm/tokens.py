"""Token ids of whole texts inside tasks."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of pieces and their ids that a task remembers; then it starts anew
REMEMBERED_BYTES = 12_000_000
#: ASCII signs that are tokens of their own behind a letter or digit (an apostrophe may begin a contraction)
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: lower-case letters of Latin-1; no normal form changes them, whatever stands beside them
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Loaded once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _letters(path: str) -> dict[int, str] | None:
    """What the pre-tokenizer makes of each of ``LETTERS``, if it keeps a run of them in one piece and no added token is such a run; else nothing."""
    tokenizer = _tokenizer(path)
    if tokenizer.pre_tokenizer is None or tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str(LETTERS) != LETTERS:
        return None
    parts = [tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in LETTERS]
    whole = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(LETTERS)]
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    if any(len(p) != 1 for p in parts) or whole != ["".join(p[0][0] for p in parts)] or any(set(a) <= set(LETTERS) for a in added):
        return None
    return {ord(c): p[0][0] for c, p in zip(LETTERS, parts)}


class WordTokenizer:
    """Encodes texts piece by piece between ASCII white space, and each distinct piece once while it is remembered.

    A task makes its own, so what is remembered goes with the task. Right for
    tokenizers that ignore the case of ASCII letters, drop white space, split
    signs from letters and digits, and never join ids across these borders,
    such as BPE with word ends.
    """

    def __init__(self, path: str):
        self.tokenizer, self.letters = _tokenizer(path), _letters(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.size, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _places(self, names: list[str]) -> np.ndarray:
        """The places of pieces in ``first`` and ``size``; unknown ones are encoded."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        fresh = list({p: None for p in names if p not in self.known})
        plain, fresh = self._runs(fresh)
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        if plain:
            merged, flat, lengths = self.tokenizer.model.tokenize, array("I"), array("q")
            for piece in plain:
                found = merged(piece.translate(self.letters))
                flat.extend([t.id for t in found])
                lengths.append(len(found))
            sizes.append(np.frombuffer(lengths, np.int64))
            ids.append(np.frombuffer(flat, np.uint32))
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        fresh = plain + fresh
        size, ids = np.concatenate(sizes), np.concatenate(ids)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.held += sum(map(len, fresh)) + 4 * len(ids) + 16 * len(fresh)
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def _runs(self, pieces: list[str]) -> tuple[list[str], list[str]]:
        """Pieces that are a run of ``LETTERS``, which the model can take as they are, and the others."""
        if self.letters is None or not pieces:
            return [], pieces
        run = pc.match_substring_regex(pa.array(pieces, pa.string()), f"^[{LETTERS}]+$").to_pylist()
        return list(compress(pieces, run)), [p for p, r in zip(pieces, run) if not r]

    @staticmethod
    def _parts(pieces: pa.Array) -> tuple[pa.Array, list[str], np.ndarray]:
        """The pieces without the signs at their ends, where a letter or digit is before them; the distinct signs, and each piece's place among these."""
        lower = pc.ascii_lower(pieces)
        core = pc.ascii_rtrim(lower, SIGNS)
        cut = pc.and_(pc.match_substring_regex(core, "[a-z0-9]$"), pc.less(pc.binary_length(core), pc.binary_length(lower)))
        special = pc.match_substring(pieces, "<|")  # may be a special token
        core = pc.if_else(special, pieces, pc.if_else(cut, core, lower))
        at = np.flatnonzero(pc.and_not(cut, special).to_numpy(zero_copy_only=False))
        kept, place = {"": 0}, np.zeros(len(pieces), np.int64)
        lengths = (pc.binary_length(lower).to_numpy() - pc.binary_length(core).to_numpy())[at].tolist()
        place[at] = [kept.setdefault(p[-n:], len(kept)) for p, n in zip(lower.take(pa.array(at)).to_pylist(), lengths)]
        return core, list(kept), place

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, end of each text among them); every text is followed by ``end_id``, a null text has that alone."""
        n = len(texts)
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        core, signs, sign_at = self._parts(coded.dictionary)
        core = core.dictionary_encode()
        both = self._places([*core.dictionary.to_pylist(), *signs])
        core_at, sign_at = both[: -len(signs)][core.indices.to_numpy()], both[-len(signs) :][sign_at]
        # the ids of each distinct piece, one after another, and the end id behind them
        two = np.stack([core_at, sign_at], 1).ravel()
        lengths = self.size[two]
        before = np.cumsum(lengths) - lengths
        flat = np.append(self.flat[np.repeat(self.first[two] - before, lengths) + np.arange(lengths.sum())], np.uint32(end_id))
        # the pieces of the texts, each text with the end behind it
        lists = pa.LargeListArray.from_arrays(np.append(before[::2], [len(flat) - 1, len(flat)]), flat)
        stops = np.cumsum(counts)
        taken = lists.take(pa.array(np.insert(coded.indices.to_numpy(), stops, len(lists) - 1)))
        return taken.values.to_numpy(), taken.offsets.to_numpy()[1:][stops + np.arange(n)] if n else np.zeros(0, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes: the more text at once, the fewer distinct words in all. What Arrow holds is given back behind the last one."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)
    held = batch = None
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, end of each text among the words): A-Z in lower case, cut at ASCII white space."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    flat = pieces.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # blanks at the ends of a text give empty pieces
    ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), ends.astype(np.int64)
