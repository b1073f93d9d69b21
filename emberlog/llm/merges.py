"""Byte-pair merges of many words at once, for tokenizers whose words are runs of letters or of marks.

The library spends most of its time on a word on what doesn't depend on merges (normalisers that keep track of places, regular expressions).
Here words of Latin letters (ASCII and U+00C0 to U+00FF, which NFC leaves alone and whose lower case is one letter) and runs of ASCII marks
go through the merges column by column: in each round every word merges its pair of lowest rank, the leftmost one of equals, as the library
does. All else stays with the library: digits, apostrophes, first characters of special tokens, other letters, runs above LONGEST bytes.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from emberlog.llm import frames

#: Bytes of a run that is merged here.
LONGEST = 48
#: The parts of a vocabulary file that decide how text is split, and with which values the rules here hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: The table of pairs has 2 ** SLOT_BITS slots.
SLOT_BITS = 18
_NEVER = np.int32(np.iinfo(np.int32).max)
_OTHER, _LETTER, _MARK = 0, 1, 2


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)


class Merges:
    """The merges of a vocabulary file; of() gives None for a file whose rules are not those above."""

    @classmethod
    def of(cls, path: str) -> Merges | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec.get("model", {}), [x["content"] for x in spec.get("added_tokens", [])]
        if spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != PRE_TOKENIZER or any(model.get(k, v) != v for k, v in MODEL.items()):
            return None
        if any(not x or x[0].isalpha() or x[0].isspace() for x in added):  # could begin within a run of letters
            return None
        vocabulary, pairs = model["vocab"], [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        single = byte_characters()
        if any(x not in vocabulary or f"{x}</w>" not in vocabulary for x in single) or max(vocabulary.values()) >= 1 << 16:
            return None
        if any(len(x) != 2 or x[0] not in vocabulary or x[1] not in vocabulary or "".join(x) not in vocabulary for x in pairs):
            return None
        if len({"".join(x) for x in pairs}) < len(pairs):  # the library goes by what a merge makes, here it is by rank
            return None
        return cls(vocabulary, pairs, single, {x[0] for x in added})

    def __init__(self, vocabulary: dict[str, int], pairs: list[list[str]], single: list[str], special: set[str]):
        self.inner = np.array([vocabulary[x] for x in single], dtype=np.uint16)
        self.last = np.array([vocabulary[f"{x}</w>"] for x in single], dtype=np.uint16)
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], dtype=np.uint32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.uint16)
        ranks = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[ranks], np.uint32(0xFFFFFFFF)), np.append(ranks, _NEVER).astype(np.int32)
        # a slot has one of its pairs; those of a slot with several are looked for in the sorted ones
        slots = _slots(keys)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, 0xFFFFFFFF, dtype=np.uint32), np.full(1 << SLOT_BITS, _NEVER, dtype=np.int32)
        self.slot_key[slots], self.slot_rank[slots] = keys, np.arange(len(keys))
        self.crowded = np.bincount(slots, minlength=1 << SLOT_BITS) > 1
        self.kinds = np.full(256, _OTHER, dtype=np.uint8)
        for b in range(0x21, 0x7F):
            c = chr(b)
            self.kinds[b] = _LETTER if c.isalpha() else _OTHER if c.isdigit() or c == "'" or c in special else _MARK
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NEVER where they don't merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right
        slot = _slots(key)
        hit = self.slot_key[slot] == key
        out = np.where(hit, self.slot_rank[slot], _NEVER)
        again = np.nonzero(~hit & self.crowded[slot])
        place = np.searchsorted(self.keys, key[again])
        out[again] = np.where(self.keys[place] == key[again], self.ranks[place], _NEVER)
        return out

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Which chunks are made of known runs alone, and the ids of those. No chunk holds white space."""
        body, ends = frames.raw(chunks)
        kinds, body = self.kinds[body], self.lower[body]
        lead = np.flatnonzero(body == 0xC3)  # U+00C0 to U+00FF, with two signs among the letters
        second = body[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kinds[lead], kinds[lead + 1] = _LETTER, _LETTER
        body[lead + 1] = np.where(second < 0x9F, second + np.uint8(0x20), second)
        begins = np.ones(len(body) + 1, dtype=bool)
        begins[1:-1] = kinds[1:] != kinds[:-1]
        begins[ends] = True
        bounds = np.flatnonzero(begins)  # the last one is the end of all
        starts, size = bounds[:-1], np.diff(bounds)
        odd = np.zeros(len(bounds), dtype=np.int64)
        np.cumsum((kinds[starts] == _OTHER) | (size > LONGEST), out=odd[1:])
        runs = np.searchsorted(bounds, ends)
        known = odd[runs[1:]] == odd[runs[:-1]]
        mine = np.repeat(known, np.diff(runs))
        symbols = self.inner[body]
        symbols[bounds[1:] - 1] = self.last[body[bounds[1:] - 1]]
        ids, places = self.merged(symbols, starts[mine], size[mine])
        first = np.zeros(int(known.sum()) + 1, dtype=np.int64)
        np.cumsum(np.diff(runs)[known], out=first[1:])
        return known, pa.ListArray.from_arrays(pa.array(places[first].astype(np.int32)), pa.array(ids.astype(np.uint32)))

    def merged(self, symbols: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each run of symbols after all merges, and the n + 1 places of the runs in that.

        Each round takes one symbol from every run at hand, so they have one length; shorter runs join when it comes to theirs.
        """
        order = np.argsort(-size, kind="stable")
        joins = np.searchsorted(-size[order], np.arange(0, -LONGEST - 2, -1))  # joins[n]: the number of runs longer than n
        done, lengths = [], np.zeros(len(size), dtype=np.int64)
        who, at_hand = order[:0], np.zeros((0, LONGEST), dtype=np.uint16)
        ranks = np.zeros((0, LONGEST - 1), dtype=np.int32)
        for n in range(LONGEST, 0, -1):
            new = order[joins[n] : joins[n - 1]]
            if len(new):
                own = symbols[starts[new][:, None] + np.arange(n)]
                who, at_hand = np.concatenate([who, new]), np.concatenate([at_hand, own])
                ranks = np.concatenate([ranks, self.rank(own[:, :-1], own[:, 1:])])
            if n == 1:
                break
            place = ranks.argmin(axis=1) if len(who) else np.zeros(0, np.int64)
            least = ranks[np.arange(len(who)), place]
            go = least != _NEVER
            if not go.all():
                done.append((who[~go], at_hand[~go]))
                who, at_hand, ranks, place, least = who[go], at_hand[go], ranks[go], place[go], least[go]
            rows = np.arange(len(who))
            at_hand[rows, place] = self.made[least]
            stay = np.ones(at_hand.shape, dtype=bool)
            stay[rows, place + 1] = False
            at_hand = at_hand[stay].reshape(len(who), n - 1)
            stay = np.ones(ranks.shape, dtype=bool)
            stay[rows, place] = False
            ranks = ranks[stay].reshape(len(who), n - 2)
            before, after = np.flatnonzero(place > 0), np.flatnonzero(place < n - 2)
            for these, left in ((before, place[before] - 1), (after, place[after])):
                ranks[these, left] = self.rank(at_hand[these, left], at_hand[these, left + 1])
        done.append((who, at_hand))
        for which, left in done:
            lengths[which] = left.shape[1]
        places = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(lengths, out=places[1:])
        out = np.empty(places[-1], dtype=np.uint16)
        for which, left in done:
            out[places[which][:, None] + np.arange(left.shape[1])] = left
        return out, places
