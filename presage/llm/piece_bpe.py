"""SentencePiece BPE by a table of each prefix's last token, and its decoding.

The encoding of a text by BPE has two properties: every prefix of it has an
encoding of its own whose last token is the only one that fits there, and a row
of tokens is an encoding where each two neighbours are (they are compatible). So
one pass suffices: an automaton over the vocabulary finds the tokens that end at
each character; of these the one is stored that is compatible with the stored
last token of the prefix before it. Reading the table backwards from the end of
the text gives the ids. The pass is linear in the text, whatever its length, and
holds four bytes a character. Two tokens are compatible if merging their
characters by score, the leftmost of equals first, gives just these two; what was
found is kept.

Characters that are no token take no part in merges and become bytes, so they
bound what is encoded. Where no token has a space mark behind another character,
neither do merges cross there, and a text is the row of its words; each word is
encoded once while a worker's memo holds it, and long words pass the memo by.

Defined results: a null text counts as empty; empty texts have the begin and end
ids alone; every row gives a row, repeated or not; an empty table gives no rows;
extra columns are ignored, whatever their names; a very long text is encoded in
one task, four bytes a character of its longest word and four bytes an id.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The mark that stands for a space.
MARK = "▁"
#: Words of more characters are not kept; words kept by a worker before those not asked for again go; pairs kept.
LONG, MEMO, PAIRS = 48, 400_000, 1_000_000
#: A rank after all others.
NEVER = 1 << 40


class Pieces:
    """Encoding under one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.texts = {i: names[i] for i in range(n) if not odd[i]}
        self.sizes = [len(x) for x in names]
        #: A merge comes the earlier the lower its rank; tied holds ranks of several pieces.
        places = {x: r for r, x in enumerate(sorted({model.get_score(i) for i in self.texts}, reverse=True))}
        self.ranks = {names[i]: places[model.get_score(i)] for i in self.texts}
        self.tied = {r for r, n in Counter(self.ranks.values()).items() if n > 1}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i, text in self.texts.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.words_apart = not any(MARK in text.lstrip(MARK) for text in self.texts.values())
        inside = {(a, b) for x in self.texts.values() for a, b in zip(x, x[1:])}
        stops = "".join(re.escape(y) for y in ".,;:!?" if not any((x, y) in inside for x in ascii_letters))
        line = "" if any("\n" in x for x in self.texts.values()) else "\n"
        self.cut = re.compile((f"{MARK}*[A-Za-z]+(?=[{stops}])|" if stops else "") + (f"{line}|" if line else "") + f"{MARK}*[^{MARK}{line}]+|{MARK}+")
        self.alphabet = set("".join(self.texts.values()))
        self.foreign = re.compile("[^" + "".join(map(re.escape, sorted(c for c in self.alphabet if c in self.ranks))) + "]")
        self.fits: dict[int, bool] = {}
        self.sides: dict[int, tuple[list, list] | None] = {}
        #: What an id stands for when decoded, but for the first one's mark.
        self.decoded = [b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        for byte, i in self.bytes.items():
            self.decoded[i] = bytes((byte,))
        self.decoded[self.unknown] = " ⁇ ".encode()
        self.memo = _Memo(self)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best pair first, the leftmost of equals. For short texts."""
        parts, _ = self._merged(text)
        return parts

    def _merged(self, text: str) -> tuple[list[str], list[tuple[str, str, str]]]:
        """The tokens, and the merges (left, right, whole) in their order."""
        parts, done = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                return parts, done
            done.append((parts[at], parts[at + 1], parts[at] + parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, token: int) -> tuple[list, list] | None:
        """What stands at a token's left and right end while it is merged, as (text, rank it is made at, rank it goes at), the token first.

        None if the token is not the encoding of its text, or its merges share
        ranks or do not come in order of rank: then no order of time can be told
        from ranks.
        """
        if token not in self.sides:
            text = self.texts[token]
            parts, done = self._merged(text)
            found = None
            times = [self.ranks[x] for _, _, x in done]
            if len(parts) == 1 and not self.tied & set(times) and times == sorted(set(times)):
                sides = []
                for side in (0, 1):
                    top, until, chain = text, NEVER, []
                    for step in [*reversed(done), None]:
                        if step is None or (step[2] == top and (text.startswith(top) if side == 0 else text.endswith(top))):
                            made = -1 if len(top) == 1 else self.ranks[top]
                            chain.append((top, made, until))
                            if step is not None:
                                top, until = step[side], made
                            if len(chain) > 1 and len(chain[-1][0]) == 1:
                                break
                    sides.append(chain)
                found = (sides[0], sides[1])
            self.sides[token] = found
        return self.sides[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether tokens left and right may be neighbours; left -1: whether right may be first.

        They may not where a merge across their border comes first: among the
        tokens that stand at both sides of it at one time, from the last back, one
        pair is a token of a rank before those at which its two go.
        """
        if left < 0:
            return self.merge(self.texts[right]) == [self.texts[right]]
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return self.merge(self.texts[left] + self.texts[right]) == [self.texts[left], self.texts[right]]
        ranks, tail, head = self.ranks, a[1], b[0]
        i = j = 0
        while True:
            x, made_x, until_x = tail[i]
            y, made_y, until_y = head[j]
            rank = ranks.get(x + y)
            if rank is not None:
                if rank in self.tied:
                    return self.merge(self.texts[left] + self.texts[right]) == [self.texts[left], self.texts[right]]
                if rank < until_x and rank <= until_y:  # of equals the left one comes first
                    return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1

    def segment(self, text: str) -> list[int]:
        """Ids of a text whose characters are all tokens."""
        last = array("i", [-1]) * (len(text) + 1)
        fits, compatible, base = self.fits, self.compatible, 1 << 20
        if len(fits) > PAIRS:
            fits.clear()
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            before = last[start]
            if before < 0 < start:
                continue
            key = before * base + token
            fit = fits.get(key)
            if fit is None:
                fit = fits[key] = compatible(before, token)
            if fit:
                last[end + 1] = token
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= self.sizes[last[i]]
        out.reverse()
        return out

    def word(self, text: str) -> bytes:
        """Ids of a marked text as unsigned 32-bit integers."""
        if self.foreign.search(text) is None:
            return array("I", self.segment(text)).tobytes()
        ids, at = array("I"), 0
        for found in self.foreign.finditer(text):
            if found.start() > at:
                ids.extend(self.segment(text[at : found.start()]))
            ids.extend([self.bytes[b] for b in found[0].encode()] if self.bytes else [self.unknown])
            at = found.end()
        if at < len(text):
            ids.extend(self.segment(text[at:]))
        return ids.tobytes()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids, or a part of it, marks being spaces."""
        raw = b"".join(map(self.decoded.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").encode()

    def words(self, marked: str) -> list[str]:
        """The parts of a text that are encoded apart: no token holds what stands at both sides of a border."""
        return self.cut.findall(marked) if self.words_apart else [marked]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids with the begin and end ids, what they decode to)."""
        first, last = (np.uint32(i).tobytes() for i in (self.begin, self.end))
        if not text:
            return first + last, b""
        marked = MARK + text.replace(" ", MARK)
        words, memo = self.words(marked), self.memo
        memo.exact = True
        ids = b"".join(map(memo.__getitem__, words))
        # Where each word's ids decode to the word, the text's do to the text; the mark before a text is dropped on decoding.
        back = marked.replace(MARK, " ").encode() if memo.exact else b"".join(self.decode(memo[w]) for w in words)
        return first + ids + last, back[1:]


class _Memo(dict):
    """Ids of words; what was not asked for since the last turn goes when it is full. exact: whether all words asked for decode to themselves."""

    def __init__(self, made: Pieces) -> None:
        super().__init__()
        self.made, self.older, self.exact = made, {}, True

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.made.word(word)
            if self.made.decode(ids) != word.replace(MARK, " ").encode():
                self.exact = False
                return ids
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One a worker process and file; its memo outlives the task."""
    return Pieces(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: digests of the little-endian 32-bit ids and of the decoded text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pieces(path)
            n, ids, decoded = [], [], []
            for text in b.column(1):
                raw, back = made.encode(text.as_py())
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
