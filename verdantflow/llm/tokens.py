"""Token ids of whole texts by the tokenizers library, one call for each distinct unit of text.

A pre-tokenizer cuts a text at places that its white space alone decides: before a space that leads a word,
and around other white space. No token crosses such a place, so the ids of a text are the ids of its units in
order. Units are found and hashed (64 bits, equal hashes are taken for equal units) over the Arrow buffer, each distinct
unit is encoded once for as long as a worker keeps it, and the ids of all units are gathered by one index. A unit that is a single word goes straight
to the tokenizer's model; any other goes through the whole tokenizer. Texts with white space beyond ASCII, and
texts that hold the string of an added token, are encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

from verdantflow.llm.shared import held
from verdantflow.llm.words import buffers, mixed, word_spans

KEPT = 1 << 19
# fixed values: the characters with the White_Space property that aren't ASCII, and the first bytes of their UTF-8
_WIDE_SPACE = "[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
_WIDE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``ids(texts)``: the ids of all texts in one array, and the n + 1 places where each text's ids begin.

    ``kind``: ``byte``, where a leading space belongs to its word, or ``word``, where white space is dropped
    and case folded.
    """

    def __init__(self, tokenizer: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(f"unknown kind: {kind}")
        if not os.path.exists(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model, self.spaced, self.letters = self.tokenizer.model, kind == "byte", _byte_letters()
        # what texts that can't be cut have: one of these bytes, and a match of the pattern
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.lead = np.zeros(256, bool)
        self.lead[[*(x for t in added for c in {t[0], t[0].lower(), t[0].upper()} for x in c.encode()[:1]), *(_WIDE_LEADS if self.spaced else ())]] = True
        self.uncut = re.compile("|".join([*map(re.escape, added), *([_WIDE_SPACE] if self.spaced else [])]) or r"(?!)", re.IGNORECASE)
        self.tails: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of known units, and their numbers
        self.flat, self.begin, self.count = array("I"), array("q"), array("q")

    def _slots(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of units by hash, and which of them are known."""
        if not len(self.hashes):
            return np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        at = np.minimum(np.searchsorted(self.hashes, units), len(self.hashes) - 1)
        return self.slots[at], self.hashes[at] == units

    def _trim(self, units: np.ndarray) -> None:
        """Keep only those of the known units that the current texts have too: the frequent ones."""
        slot, known = self._slots(units)
        kept, slot = units[known], slot[known]
        begin, count, flat = (np.frombuffer(x, t) for x, t in ((self.begin, np.int64), (self.count, np.int64), (self.flat, np.uint32)))
        begin, count = begin[slot], count[slot]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        flat = flat[np.arange(total) + np.repeat(begin - ends + count, count)]
        self.forget()
        self.hashes, self.slots = kept, np.arange(len(kept))
        self.flat.frombytes(flat.astype(np.uint32).tobytes())
        self.begin.frombytes((ends - count).astype(np.int64).tobytes())
        self.count.frombytes(count.astype(np.int64).tobytes())

    def _word(self, unit: str) -> list[int] | None:
        """Ids of a unit that is one word of letters, or one and a mark; None for any other."""
        tail = unit[-1] if unit[-1] in _MARKS and len(unit) > 1 else ""
        core = unit[:-1] if tail else unit
        if tail and tail not in self.tails:
            self.tails[tail] = [t.id for t in self.model.tokenize(tail)]
        if not (core[1:] if core[0] == " " else core).isalpha():
            return None
        if not self.spaced:
            if core[0] == " " or not core.isascii() and max(core) > "\xff":
                return None  # other letters may change under normalisation
            core = core.lower()
        written = core.replace(" ", "Ġ") if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        out = [t.id for t in self.model.tokenize(written)]
        return out + self.tails[tail] if tail else out

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        found = [self._word(t) for t in texts]
        other = [i for i, ids in enumerate(found) if ids is None]
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
                found[i] = e.ids
        fresh, size = len(self.begin), np.fromiter(map(len, found), np.int64, len(found))
        self.begin.frombytes((len(self.flat) + np.cumsum(size) - size).tobytes())
        self.count.frombytes(size.tobytes())
        self.flat.extend(chain.from_iterable(found))
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")  # two sorted runs
        self.hashes, self.slots = hashes[order], np.concatenate([self.slots, np.arange(fresh, fresh + len(found))])[order]

    def _units(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and hash of each unit, in order."""
        begin, end, h = word_spans(raw, at, fold=not self.spaced)
        if not self.spaced:
            return begin, end, h
        h = h.copy()
        text = np.searchsorted(at, begin, side="right")  # the text of a word ends at at[text]
        floor = np.maximum(at[text - 1], np.concatenate(([0], end[:-1]))) if len(begin) else begin
        led = (begin > floor) & (raw[np.maximum(begin - 1, 0)] == 32)
        h[led] = mixed(h[led] + np.uint64(1))
        lead = begin - led
        # white space before a word's unit; its last character stands alone if it isn't the word's own space
        gap = lead > floor
        alone = gap & ~led & (lead - floor > 1)
        a = [lead, floor[gap], lead[alone] - 1]
        b = [end, (lead - alone)[gap], lead[alone]]
        # white space after the last word of a text, or a text of nothing else
        last = np.searchsorted(begin, at[1:]) - 1
        tail = np.maximum(at[:-1], np.where(last >= 0, np.append(end, 0)[last], 0))
        more = tail < at[1:]
        a.append(tail[more])
        b.append(at[1:][more])
        space = [hash(bytes(raw[x:y])) for x, y in zip(np.concatenate(a[1:]).tolist(), np.concatenate(b[1:]).tolist())]
        h = np.concatenate([h, mixed(np.array(space, np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(a, kind="stable")
        return a[order], b[order], h[order]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, at = buffers(texts)
        whole = self._whole(raw, at, texts)
        begin, end, h = self._units(raw, at)
        unit, first, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unit) > KEPT:
            self._trim(unit)
        slot, known = self._slots(unit)
        if not known.all():
            own = first[~known]
            data = raw.tobytes()
            self._learn(unit[~known], [data[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist())])
            slot, _ = self._slots(unit)
        count = np.frombuffer(self.count, np.int64)[slot][place] if len(unit) else np.zeros(0, np.int64)
        source = np.frombuffer(self.begin, np.int64)[slot][place] if len(unit) else count
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = np.frombuffer(self.flat, np.uint32)[np.arange(total) + np.repeat(source - ends + count, count)] if total else np.zeros(0, np.uint32)
        cuts = np.concatenate(([0], ends))[np.searchsorted(begin, at)]
        return self._spliced(out, cuts, whole) if whole else (out, cuts)

    def _whole(self, raw: np.ndarray, at: np.ndarray, texts: pa.Array) -> dict[int, list[int]]:
        """Ids of the texts that can't be cut by ASCII white space alone."""
        lead = np.flatnonzero(self.lead[raw])
        rows = np.unique(np.searchsorted(at, lead, side="right") - 1).tolist()
        found = [(i, t) for i in rows if self.uncut.search(t := texts[i].as_py())]
        encoded = self.tokenizer.encode_batch_fast([t for _, t in found], add_special_tokens=False) if found else []
        return {i: e.ids for (i, _), e in zip(found, encoded)}

    @staticmethod
    def _spliced(ids: np.ndarray, cuts: np.ndarray, whole: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(whole[i], np.uint32) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def encoder(tokenizer: str, kind: str) -> Encoder:
    """One encoder for each worker process, until its tasks are others; ``tokenizer`` is a path, or the name of an installed public file."""
    return held((tokenizer, kind), lambda: Encoder(tokenizer, kind))
