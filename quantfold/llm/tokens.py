"""Whole-text encoding with a public tokenizer file, many texts at a time.

The result is exactly ``Tokenizer.encode(text, add_special_tokens=False)``.  A word-level BPE never
joins text across white space, so every distinct white-space word of a slice is encoded once and
the ids are put back together with numpy.  Plain words (ASCII and Latin-1 letters, digits,
punctuation) are cut into pre-tokens here and only the BPE model runs on them; any other word goes
through the library's full encode.  Files whose configuration is another one are encoded text by
text.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, ragged_take, words

# The pre-token pattern of the file, for words of the plain characters only.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
PLAIN = r"^[!-~À-ÖØ-öø-ÿ]*$"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Stands for the end of a word in merged bytes; plain words don't hold it.
END = "\x01"

#: Pre-tokens whose ids a Python worker remembers between slices.
MEMORY = 100_000

_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
        give_back()  # what the file's lists and the check of its ranks took
    return _LOADED[path]


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + n)] = b
    return out


def by_rank(said: dict, pattern: str):
    """The BPE model of a byte-level file as ranks of merged bytes (``END`` for the end of a word), which encodes the same
    faster, or None where it could differ.

    Merging by rank takes any two neighbours that spell an entry, the file only listed ones, in the order of the list.  If
    that is the order of ids and every entry comes out whole of its own characters, no unlisted pair is ever merged: within
    the span of an entry both take the same steps, by induction over its length, and the last one gave the entry."""
    import tiktoken
    from tokenizers import Tokenizer

    model, of = said["model"], byte_of_character()
    suffix = model.get("end_of_word_suffix") or ""
    vocab, special = model["vocab"], {x["content"] for x in said.get("added_tokens", [])}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if min(merged, default=0) < 0 or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    plain = {"version": said["version"], "model": model | {"end_of_word_suffix": None}}
    for ends in (False, True) if suffix else (False,):
        own = {t: i for t, i in vocab.items() if t not in special and bool(suffix and t.endswith(suffix)) == ends}
        coder = Tokenizer.from_str(json.dumps(plain if not ends else plain | {"model": model}))
        names, ids = [t.removesuffix(suffix) if ends else t for t in own], list(own.values())
        for at in range(0, len(names), 2000):
            got = coder.encode_batch_fast(names[at : at + 2000], add_special_tokens=False)
            if any(e.ids != [i] for e, i in zip(got, ids[at : at + 2000])):
                return None
    ranks = {}
    for t, i in vocab.items():
        whole = bool(suffix) and t.endswith(suffix)
        name = t.removesuffix(suffix) if whole else t
        if t in special or (suffix and chr(256 + ord(END)) in name and len(t) > 1):
            continue
        ranks[bytes(of[c] for c in name) + (END.encode() if whole else b"")] = i
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        full = Tokenizer.from_file(path)
        self.path, self._full = path, None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
        split = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == WORD_PATTERN
                        and said["model"].get("end_of_word_suffix") == "</w>" and not said.get("post_processor"))
        self.special = [x["content"] for x in said.get("added_tokens", [])]
        self.ranks = by_rank(said, f"[^{END}]+{END}") if self.by_word else None
        if not self.ranks:
            self.model = Tokenizer(full.model)  # pre-tokens separated by spaces
            self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(full.get_vocab_size(), bool)
        self.ends[[i for x, i in full.get_vocab().items() if x.endswith("</w>")]] = True
        if not self.by_word or not self.ranks:
            self._full = full
        self._forget()

    @property
    def full(self):
        """The library's tokenizer, loaded again when a word needs it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    def _forget(self) -> None:
        """Number 0 is the line end between words, which has no ids."""
        self.known, self.starts, self.lens, self.flat = {"\n": 0}, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of an array of texts without nulls."""
        if not self.by_word:
            return _joined([x.ids for x in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        offsets, flat = words(texts)
        coded = flat.dictionary_encode()
        at, (starts, flat_ids) = coded.indices.to_numpy(), self._distinct(coded.dictionary)
        lens = np.diff(starts)[at]
        ids = ragged_take(starts[at], lens, flat_ids)
        return np.concatenate([[0], np.cumsum(lens)])[offsets], ids

    def _distinct(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of distinct words."""
        if not len(distinct):
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        plain = pc.match_substring_regex(distinct, PLAIN)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(distinct, s))
        lower = pc.utf8_lower(distinct.filter(plain)).dictionary_encode()
        starts, ids = self._plain(lower.dictionary.to_pylist())
        odd = distinct.filter(pc.invert(plain)).to_pylist()
        odd_starts, odd_ids = _joined([x.ids for x in self.full.encode_batch_fast(odd, add_special_tokens=False)] if odd else [])
        plain, which = plain.to_numpy(zero_copy_only=False), lower.indices.to_numpy()
        at, lens = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        at[plain], lens[plain] = starts[:-1][which], np.diff(starts)[which]
        at[~plain], lens[~plain] = odd_starts[:-1] + len(ids), np.diff(odd_starts)
        return np.concatenate([[0], np.cumsum(lens)]), ragged_take(at, lens, np.concatenate([ids, odd_ids]))

    def _plain(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct lower-case words of plain characters."""
        if not distinct:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        parts = PRE_TOKEN.findall("\n".join(distinct))
        if len(self.known) > MEMORY:
            self._forget()
        new = [p for p in set(parts) if p not in self.known]
        added, lens = [self.flat], []
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            got = np.array(self.ranks.encode_ordinary(END.join(part) + END) if self.ranks else self.model.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            lens.append(np.diff(np.flatnonzero(self.ends[got]), prepend=-1))
            added.append(got)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.lens = np.concatenate([self.lens, *lens])
            self.flat = np.concatenate(added)
            self.starts = np.cumsum(self.lens) - self.lens
            if len(self.lens) != len(self.known):
                raise ValueError("a pre-token has no end-of-word id")
        number = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        lens = self.lens[number]
        ids = ragged_take(self.starts[number], lens, self.flat)
        ends = np.append(np.flatnonzero(number == 0), len(parts))
        return np.concatenate([[0], np.concatenate([[0], np.cumsum(lens)])[ends]]), ids


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    return offsets, np.fromiter(chain.from_iterable(lists), np.uint32, int(offsets[-1]))
