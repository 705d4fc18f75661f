"""Token ids of whole texts, with the ids of frequent stretches of text kept per worker process.

Both public tokenizers used here cut a text before white space that follows other characters, so a text may be cut there
and the ids of its stretches put together. The stretches repeat, as words do, so most ids come from a dictionary. Texts
for which the cut could matter (rare control characters that count as white space only here) are encoded whole.

A new stretch of ASCII and Latin-1 letters, digits and signs is cut further, into the pieces in which the tokenizer's own
pattern cuts it, and the tokenizer's model encodes those pieces that are new as well.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Control characters that are white space only here, the mark between stretches, and the beginning of special tokens.
ODD = re.compile(r"[\x01\x1c-\x1f]|<\|")
#: Fixed value that stands between stretches that are encoded together, where their first ids don't tell them apart.
MARK = "\x01"
#: White space before a space, an odd character, or nothing between spaces: in joined stretches a sign of a hard one.
HARD = re.compile(r"\s |  |\s\Z|\A |[\x01\x1c-\x1f]|<\|")
#: A stretch: white space, then all up to the next white space.
STRETCH = re.compile(r"\s*\S+|\s+")
NEXT_CUT = re.compile(r"(?<=\S)\s")
#: Letters of plain stretches, all else that is not plain, and the patterns of the two tokenizers over plain characters.
#: In the second a space, which its tokenizer drops, stands for the beginning of a stretch.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
UNPLAIN = re.compile(rf"[^\n -~{LETTERS}]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(rf"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf" |{ENDINGS}|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
#: Fixed value: how a tokenizer of the second kind cuts.
WORD_PATTERN = ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces kept.
KEEP_PIECES = 300_000
#: Stretches kept per generation; two generations at most are held.
KEEP = 600_000
#: Longer stretches are not kept.
KEEP_CHARS = 64
#: Characters of a long text cut into stretches at once.
SPAN = 1 << 20
#: Characters of the texts that are encoded together.
HELD = 4 << 20
#: Rows of an Arrow batch encoded together.
STEP = 512

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    With ``special`` the strings of special tokens in a text give these tokens, as they do by the tokenizer's plain call;
    without it they are encoded like other characters.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id begins with a space, in vocabularies that keep spaces; else the id of the mark.
        self.begins, self.mark = np.zeros(max(vocabulary.values()) + 1, bool), -1
        self.begins[[i for word, i in vocabulary.items() if word[0] == "\u0120"]] = True
        if self.begins.sum() < 256:
            (self.mark,) = self.tokenizer.encode(f" {MARK} ", add_special_tokens=False).ids
        self.cuts, self.lower = _cuts(json.loads(self.tokenizer.to_str()))
        if self.cuts:
            spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            table = ["\0"] * 256
            for c in filter(lambda c: not UNPLAIN.match(c), map(chr, range(256))):
                for byte, sign in zip(c.encode(), spell(c)[0][0], strict=True):
                    table[byte] = sign
            #: What stands for each byte of a plain character in the vocabulary.
            self.spelt = "".join(table)
            self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        #: Ids of stretches that follow a space, by what follows the space.
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; a null text has none."""
        waiting: list[str] = []
        held = 0
        for text in texts:
            held += len(text or "")
            if held > HELD:
                yield from self._encode(waiting)
                waiting, held = [], len(text)
            if text is None or len(text) <= SPAN:
                waiting.append(text or "")
            else:
                yield from self._encode(waiting)
                waiting = []
                yield b"".join(self._slow(text))
        yield from self._encode(waiting)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Cut at single spaces where every part is plain, else by stretches."""
        if len(self.new) > KEEP:
            self.new, self.old = {}, self.new
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, words = split.offsets.to_numpy(), split.values
        first = np.zeros(len(words), bool)
        first[bounds[:-1]] = True
        heads = words.filter(pa.array(first)).to_pylist()
        bounds = bounds - np.arange(len(bounds))
        coded = words.filter(pa.array(~first)).dictionary_encode()
        here, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.new.get, here))
        lacking = {s for s, found in zip(here, ids, strict=True) if found is None}
        # A part that is empty or ends in white space stands before a longer gap; such texts are cut with more care.
        hard = set()
        if HARD.search(" ".join(lacking)) or "" in lacking:
            hard = {s for s in lacking if not s or s[-1].isspace() or ODD.search(s)}
            lacking -= hard
        self._learn(lacking)
        ids = [self.new.get(s, b"") if found is None else found for s, found in zip(here, ids, strict=True)]
        careful = np.zeros(len(texts), bool)
        if hard:
            met = np.flatnonzero(np.array([s in hard for s in here])[places])
            careful[np.searchsorted(bounds, met, "right") - 1] = True
        joined, ends = _gather(ids, places)
        out = []
        for i, (text, head) in enumerate(zip(texts, heads, strict=True)):
            if careful[i] or not head or head[-1].isspace() or ODD.search(head):
                out.append(b"".join(self._slow(text)))
            else:
                out.append(self.plain(head) + joined[ends[bounds[i]] : ends[bounds[i + 1]]].tobytes())
        self._forget(lacking)
        return out

    def _slow(self, text: str) -> Iterator[bytes]:
        if ODD.search(text):
            yield self.plain(text)
            return
        for span in _spans(text):
            stretches = STRETCH.findall(span)
            after_space = [s[0] == " " and len(s) > 1 and not s[1].isspace() for s in stretches]
            lacking = {s[1:] for s, ok in zip(stretches, after_space, strict=True) if ok}.difference(self.new)
            self._learn(lacking)
            for s, ok in zip(stretches, after_space, strict=True):
                yield self.new[s[1:]] if ok else self.plain(s)
            self._forget(lacking)
            if len(self.new) > 2 * KEEP:
                self.new, self.old = {}, {}

    def _forget(self, lacking: set[str]) -> None:
        for s in lacking:
            if len(s) > KEEP_CHARS:
                self.new.pop(s, None)

    def _learn(self, lacking: set[str]) -> None:
        """Put the ids of unknown stretches, each after a space, into the dictionary."""
        known = self.old.keys() & lacking
        self.new.update((s, self.old[s]) for s in known)
        joined = list(lacking.difference(known))
        if self.cuts:
            plain, joined = joined, []
            if UNPLAIN.search(" ".join(plain)):
                joined = [s for s in plain if UNPLAIN.search(s)]
                plain = list(lacking.difference(known, joined))
            self._compose(plain)
        if not joined:
            return
        if self.mark < 0:
            done = np.array(self._fast(" " + " ".join(joined)), "<u4")
            cuts = np.flatnonzero(self.begins[done])
        else:
            done = np.array(self._fast(f" {MARK} ".join(["", *joined])), "<u4")
            marks = done == self.mark
            cuts = np.flatnonzero(marks) - np.arange(len(joined))
            done = done[~marks]
        if len(cuts) != len(joined):
            raise ValueError("stretches encoded together can't be told apart")
        data, places = done.tobytes(), [*(4 * cuts).tolist(), 4 * len(done)]
        self.new.update(zip(joined, [data[a:b] for a, b in zip(places, places[1:], strict=False)], strict=True))

    def _compose(self, plain: list[str]) -> None:
        """Put the ids of plain stretches into the dictionary, from those of their pieces."""
        if not plain:
            return
        text = " " + " ".join(plain)
        pieces = self.cuts.findall(text.lower() if self.lower else text)
        if len(self.pieces) > KEEP_PIECES:
            self.pieces = {}
        here = set(pieces)
        found = dict(zip(here, map(self.pieces.get, here), strict=True))
        if self.lower:
            found[" "] = b""
        lacking = [s for s, ids in found.items() if ids is None]
        # Fixed value: the mark between pieces, no character of a plain one.
        spelt = charmap_decode("\0".join(lacking).encode(), "strict", self.spelt)[0].split("\0") if lacking else []
        tokens = list(map(self.model.tokenize, spelt))
        data = array("I", [t.id for piece in tokens for t in piece]).tobytes()
        ends = [4 * n for n in accumulate(map(len, tokens), initial=0)]
        made = dict(zip(lacking, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))
        found.update(made)
        self.pieces.update(made if max(map(len, made), default=0) <= KEEP_CHARS else {s: ids for s, ids in made.items() if len(s) <= KEEP_CHARS})
        ids = list(map(found.__getitem__, pieces))
        cuts = [i for i, s in enumerate(pieces) if s[0] == " "]
        if len(cuts) != len(plain):
            raise ValueError("stretches cut together can't be told apart")
        cuts.append(len(pieces))
        self.new.update(zip(plain, [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _fast(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def _gather(ids: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at ``places`` one after the other, and where each word's begin, the end last."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts = np.cumsum(lengths) - lengths
    counts = lengths[places]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(starts[places] - ends[:-1], counts) + np.arange(ends[-1])
    return np.frombuffer(b"".join(ids), "<u4")[at], ends


def _cuts(tokenizer: dict) -> tuple[re.Pattern | None, bool]:
    """The pattern of pieces and whether capitals are made small first; None for other kinds of tokenizers."""
    model, before = tokenizer["model"], tokenizer["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model.get("dropout"):
        return None, False
    if before.get("type") == "ByteLevel":
        whole = not before["add_prefix_space"] and before["use_regex"] and tokenizer["normalizer"] is None
        return (BYTE_PIECES if whole else None), False
    made = [(n["type"], n.get("pattern"), n.get("content")) for n in (tokenizer["normalizer"] or {}).get("normalizers", [])]
    steps = [(n["type"], n.get("pattern"), n.get("behavior"), n.get("invert"), n.get("add_prefix_space"), n.get("use_regex")) for n in before.get("pretokenizers", [])]
    wanted = [("Split", {"Regex": WORD_PATTERN}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
    small = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    return (WORD_PIECES, True) if made == small and steps == wanted else (None, False)


def _spans(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = NEXT_CUT.search(text, at + SPAN)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def encoder(path: str, special: bool = False) -> Encoder:
    """The encoder of a tokenizer file, one per process."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def map_texts(
    df: DataFrame,
    columns: list[str],
    text: str,
    schema: str,
    fn: Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch],
) -> DataFrame:
    """``fn(batch of columns, texts)`` over all rows, a small slice of rows at a time; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STEP):
                part = batch.slice(first, STEP)
                texts = part.column(len(columns)).to_pylist()
                yield fn(part.select(range(len(columns))), texts)

    source = df.select(*columns, df[text].alias("_text"))
    return source.mapInArrow(run, schema)
