"""BPE encoding with the tokenizers library: a memo over pre-tokens, and tree concatenation of long texts.

BPE encodes each pre-token by itself, so a text's ids are its pre-tokens' ids in
turn. Texts of common Latin characters are cut by a pattern here and each
distinct pre-token is encoded once a worker; any other text goes to the library
whole.

A text of over `longest` characters is halved, wherever that falls, until its
parts are small, and the parts are encoded in parallel tasks. At each join a
window grows on both sides to places where any text is cut alike (between a
printable character and a space before another), is encoded anew, and takes the
place of its tokens if it begins and ends with the tokens that both sides have
there; where it does not agree with them, it grows to the next such places. A text
with an unsplit stretch longer than a part is cut into pre-tokens first and the
long ones are halved; there the window grows until its first and last token
agree with the sides. Adjacent tokens of one BPE encoding are valid wherever each
pair of neighbours is, hence the result is the encoding of the whole.

Defined results: a null text counts as empty; empty texts have no ids; every row
gives a row, repeated or not; an empty table gives no rows; extra columns are
ignored; the ids of a very long text are joined in one task, which holds them as
Python integers (36 bytes an id or less).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that is encoded at once, and of a part of a longer one.
LONGEST, LEAF = 1 << 15, 4096
#: Pre-tokens kept by a worker before a memo begins its next generation (word) or starts anew (byte).
MEMO = 150_000


def _safe(code: int) -> bool:
    """Latin characters and punctuation of which every Unicode version says the same."""
    return code < 0x1C or 0x20 <= code < 0x180 and code not in (0x85, 0x130) or 0x2010 <= code <= 0x2027


def _chars(want: str) -> str:
    codes = [c for c in [*range(0x180), *range(0x2010, 0x2028)] if _safe(c)]
    space = [9, 10, 11, 12, 13, 0x20, 0xA0]
    kinds = {c: "S" if c in space else unicodedata.category(chr(c))[0] for c in codes}
    return "".join(re.escape(chr(c)) for c in codes if kinds[c] in want and (kinds[c] != "S" or c in space or want == "O"))


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    letter, number = _chars("L"), _chars("N")
    space = "".join(map(re.escape, "\t\n\x0b\x0c\r \xa0"))
    other = f"[^{space}{letter}{number}]+"
    # The published pre-tokenization patterns of the two vocabularies.
    return {
        "byte": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?{other}|[{space}]+(?![^{space}])|[{space}]+"),
        "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|{other}"),
        "run": re.compile(f" (?:[{space}]|\\Z)|[{space}] "),
        "unsafe": re.compile("<\\||[^" + "".join(re.escape(chr(c)) for c in [*range(0x180), *range(0x2010, 0x2028)] if _safe(c)) + "]"),
    }


class Encoder:
    """ids of texts under one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        plain = all(x["special"] and "<|" in x["content"] for x in spec["added_tokens"])
        self.kind = None
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "byte"
        elif plain and steps == ["Split", "ByteLevel"] and "[\\p{N}]" in json.dumps(pre, ensure_ascii=False).replace("\\\\", "\\"):
            self.kind = "word"
        if self.kind == "word":  # chunks and pre-tokens are spelled alike: one memo holds both
            self.memo = self.chunks = _Memo(self._word)
        else:
            self.memo, self.chunks = _Memo(self._piece), _Memo(self._chunk)

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        plain = piece.isascii() and piece.isprintable() and " " not in piece  # stands for itself
        stand_in = piece if plain else piece.encode().decode("latin-1").translate(_stand_ins())
        return array("I", [t.id for t in self.tokenizer.model.tokenize(stand_in)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of what stands between two spaces, with the space before it if that counts."""
        chunk = " " + chunk if self.kind == "byte" else chunk
        return b"".join(map(self.memo.__getitem__, _patterns()[self.kind].findall(chunk)))

    def _word(self, chunk: str) -> bytes:
        """The ids of what stands between white space, or of one pre-token of it."""
        if chunk.isalpha():
            return self._piece(chunk)
        pieces = _patterns()["word"].findall(chunk)
        return self._piece(chunk) if len(pieces) == 1 else b"".join(map(self.memo.__getitem__, pieces))

    def _text(self, text: str) -> bytes:
        if self.kind is None or _patterns()["unsafe"].search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.kind == "word":  # white space is dropped, and no pre-token spans it
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        if _patterns()["run"].search(text):  # a space within a run of white space: the run is cut as a whole
            return b"".join(map(self.memo.__getitem__, _patterns()["byte"].findall(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.memo.__getitem__, _patterns()["byte"].findall(first))) + b"".join(map(self.chunks.__getitem__, rest))

    def forget(self) -> None:
        """Empties the memos."""
        for memo in (self.memo, self.chunks):
            memo.clear()
            memo.old = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        for t in texts:
            yield self._text(t or "")
            if self.kind == "word":
                if len(self.memo) > MEMO:
                    self.memo.turn()
                continue
            for memo in (self.memo, self.chunks):
                if len(memo) > MEMO:
                    memo.clear()


class _Memo(dict):
    """A dict that takes what it misses from the generation before, or makes it."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def turn(self) -> None:
        """Begins a generation: what is in use comes back from the last one, the rest goes with it."""
        self.old = dict(self)
        self.clear()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One a worker process and file; its memo outlives the task."""
    return Encoder(path)


@lru_cache(maxsize=1)
def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, to bytes: printable bytes stand for themselves, others follow from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _stand_ins() -> dict[int, str]:
    """For str.translate: Latin-1 characters that hold bytes, to their stand-ins."""
    return {b: c for c, b in _byte_chars().items()}


class Decoder:
    """Bytes of ids under a byte-level vocabulary."""

    def __init__(self, path: str):
        tokenizer = encoder(path).tokenizer
        chars, n = _byte_chars(), tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(i) or "" for i in range(n)]
        self.table = [bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode() for t in names]
        self.digits = [str(i) for i in range(n)]

    def digest(self, raw: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        joined, decoded = hashlib.sha256(), hashlib.sha256()
        n, held = len(raw) // 4, b""
        for at in range(0, n, 1 << 16):
            ids = np.frombuffer(raw, "<u4", min(1 << 16, n - at), at * 4).tolist()
            joined.update((("," if at else "") + ",".join(map(self.digits.__getitem__, ids))).encode())
            held += b"".join(map(self.table.__getitem__, ids))
            # A character may go on in the next block.
            cut = len(held)
            while cut and cut > len(held) - 4 and held[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            cut = cut - 1 if cut and held[cut - 1] >= 0xC0 else len(held)
            decoded.update(held[:cut].decode("utf-8", "replace").encode())
            held = held[cut:]
        decoded.update(held.decode("utf-8", "replace").encode())
        return n, joined.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def leaves(piece: str, leaf: int = LEAF) -> list[str]:
    """Parts of a pre-token, by halving, in order."""
    if len(piece) <= leaf:
        return [piece]
    mid = len(piece) // 2
    return leaves(piece[:mid], leaf) + leaves(piece[mid:], leaf)


def join_ids(left: list[int], right: list[int], encode: Callable[[str], list[int]], token: Callable[[int], str]) -> list[int]:
    """The encoding of two neighbouring parts of a pre-token from the parts' encodings."""
    if not left or not right:
        return left + right
    k = 1
    while True:
        a, b = left[-k:], right[:k]
        window = encode("".join(map(token, a + b)))
        if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def join_tree(parts: list[list[int]], join: Callable[[list[int], list[int]], list[int]]) -> list[int]:
    """Joins neighbours pairwise until one encoding is left."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def join_texts(left: list[int], right: list[int], encode: Callable[[str], list[int]], table: list[bytes]) -> list[int]:
    """The encoding of two neighbouring parts of a text from the parts' encodings."""
    if not left or not right:
        return left + right

    def sure(i: int, j: int) -> bool:
        """Whether any text that holds tokens i and j side by side is cut between them."""
        a, b = table[i], table[j]
        return 0x21 <= a[-1] <= 0x7E and len(b) > 1 and b[0] == 0x20 and 0x21 <= b[1] <= 0x7E

    k = m = 1  # a first guess: the nearest places where any text is cut alike
    while k < len(left) and not sure(left[-k - 1], left[-k]):
        k += 1
    while m < len(right) and not sure(right[m - 1], right[m]):
        m += 1
    while True:
        window = encode(b"".join(map(table.__getitem__, left[-k:] + right[:m])).decode())
        # Both sides agree where the window, cut by itself, begins and ends with their own tokens, or with a text's end.
        agree = (k >= len(left) or window[:1] == left[-k : len(left) - k + 1]) and (m >= len(right) or window[-1:] == right[m - 1 : m])
        if agree and (k >= len(left) or sure(left[-k - 1], left[-k])) and (m >= len(right) or sure(right[m - 1], right[m])):
            return left[: len(left) - k] + window + right[m:]
        k, m = _farther(left, k, lambda at: sure(left[-at - 1], left[-at])), _farther(right, m, lambda at: sure(right[at - 1], right[at]))


def _farther(side: list[int], at: int, sure: Callable[[int], bool]) -> int:
    """The next place behind `at` tokens where any text is cut alike, or the side's end."""
    at = min(len(side), 2 * at)
    while at < len(side) and not sure(at):
        at += 1
    return at


#: A place where any text is cut alike.
_SURE = re.compile("[!-~] (?=[!-~])")


def _splits(text: str, leaf: int) -> bool:
    """Whether no stretch of over `leaf` characters lacks a place where any text is cut alike."""
    at = 0
    for found in _SURE.finditer(text):
        if found.start() - at > leaf:
            return False
        at = found.start()
    return len(text) - at <= leaf


def _model(path: str) -> tuple[Callable[[str], list[int]], Callable[[int], str]]:
    tokenizer = encoder(path).tokenizer
    model = tokenizer.model
    return (lambda s: [t.id for t in model.tokenize(s)]), tokenizer.id_to_token


def _pretokens(text: str, path: str) -> Iterator[tuple[str, bool]]:
    """(piece in stand-in characters, False), or (special token, True)."""
    tokenizer = encoder(path).tokenizer
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut = re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]
    for i, part in enumerate(cut):
        if i % 2:
            yield part, True
        elif part:
            for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(part):
                yield piece, False


#: Piece numbers of parts that are pre-tokens in turn, and of parts of a text halved anywhere.
_WHOLE, _HALVED = -1, -2


def encode_digests(docs: DataFrame, path: str, leaf: int = LEAF, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row under a byte-level tokenizer.

    Rows of over `longest` characters go by tree concatenation: their parts are
    rows of their own, dealt over all tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dec = decoder(path)
            rows = [dec.digest(raw) for raw in encoder(path).encode(b.column(1).to_pylist())]
            cols = list(zip(*rows)) or [(), (), ()]
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, doc_id, part, piece, text): parts of the text or of long pre-tokens, and runs of other pre-tokens."""
        schema = pa.schema([("row", pa.int64()), ("doc_id", out_id), ("part", pa.int32()), ("piece", pa.int32()), ("text", pa.list_(pa.string()))])

        def parts(text: str) -> Iterator[tuple[int, list[str]]]:
            if encoder(path).kind == "byte" and _splits(text, leaf):
                yield from ((_HALVED, [x]) for x in leaves(text, leaf))
                return
            run: list[str] = []
            for i, (piece, special) in enumerate(_pretokens(text, path)):
                if not special and len(piece) > leaf:
                    yield _WHOLE, run
                    yield from ((i, [x]) for x in leaves(piece, leaf))
                    run = []
                else:
                    if len(run) >= leaf:
                        yield _WHOLE, run
                        run = []
                    run.append(piece)
            yield _WHOLE, run

        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for part, (piece, x) in enumerate(parts(text)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "part": part, "piece": piece, "text": x}], schema)

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _ = _model(path)
        tokenizer = encoder(path).tokenizer
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        for b in batches:
            out = []
            for piece, parts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if piece == _HALVED:
                    out.append(np.frombuffer(next(encoder(path).encode(parts)), "<u4").tolist())
                else:
                    out.append([i for x in parts for i in ([special[x]] if x in special else ids(x))])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.int32()))], ["row", "doc_id", "part", "piece", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        encode, token = _model(path)
        whole: list[int] = []
        piece, held = _WHOLE, []

        def again(text: str) -> list[int]:
            return np.frombuffer(next(encoder(path).encode([text])), "<u4").tolist()

        def joined() -> list[int]:
            if piece == _HALVED:
                return join_tree(held, lambda a, b: join_texts(a, b, again, decoder(path).table))
            return join_tree(held, lambda a, b: join_ids(a, b, encode, token))

        for p, ids in zip(table["piece"].to_pylist(), table["ids"].to_pylist()):
            if p != piece:
                whole += joined()
                piece, held = p, []
            if p == _WHOLE:
                whole += ids
            else:
                held.append(ids)
        whole += joined()
        n, a, b = decoder(path).digest(np.array(whole, "<u4").tobytes())
        return pa.table({"doc_id": table["doc_id"][:1], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]})

    from pyspark.sql.pandas.types import to_arrow_type

    out_id = to_arrow_type(docs.schema["doc_id"].dataType)
    far = F.coalesce(F.char_length("text") > longest, F.lit(False))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text")
    long = (
        rows.where(far)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(cut, f"row bigint, doc_id {kind}, part int, piece int, text array<string>")
        .repartition(tasks, "row", "part")  # a given number, since parts so few and small would be put together
        .mapInArrow(encode_parts, f"row bigint, doc_id {kind}, part int, piece int, ids array<int>")
        .groupBy("row")
        .applyInArrow(assemble, digests)
    )
    return rows.where(~far).mapInArrow(short, digests).unionByName(long)
