"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A sequence of tokens is what the merge rules make of its text exactly when each
token is what the rules make of its own spelling and each two neighbours are what
they make of theirs.  So a word needs no merging:

* ``encode_word``: one Aho-Corasick pass (over the reversed word, with reversed tokens)
  gives the longest token that begins at each position.  Going left to right the
  longest token that is compatible with the token before it is taken; where none is,
  the position is marked dead and the last token gives way to the next shorter one that
  begins it.  What the rules make of a prefix is unique, so a dead position stays dead
  and the work is linear in the word.
* the pair table: a pair's answer comes from merging the two spellings alone and is
  kept.
* decoding: the tokens' spellings lie behind each other in one buffer; a batch of ids is
  a gather through their offsets.

The vocabulary is a file of the ``tokenizers`` library (``path``); the driver reads it
and broadcasts its bytes (1.7 MB; at most ``MAX_FILE_BYTES``, else an error).  Texts are
cut into words as that library does.  The file's own rules are applied here for code
points whose classes do not change between Unicode versions (``STABLE``); a text with any other
code point, or a file with other rules, is cut by the library's normaliser and
pre-tokeniser.  Merging is done here in every case.

Edge cases: a null or empty text has no tokens and decodes to an empty text; special
tokens that stand in a text are recognised as the library does; null ids decode to an
empty text, and null or unknown ids within a row are skipped; a word of any length is
encoded whole; rows that share a doc_id are kept apart; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text
from hepark.llm.text import as_list, list_values

MAX_FILE_BYTES = 64 << 20
#: Words kept with their ids, and pairs kept with their answer, in a Python worker.
KEPT_WORDS, KEPT_PAIRS = 1 << 18, 1 << 20
#: Characters of text, and ids, handled at a time.
PIECE = 1 << 19

# The file's own cutting rule.  White space as its expressions understand it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(RULE.replace(r"\s", SPACE))
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": RULE}, "behavior": "Removed", "invert": True}
STABLE = regex.compile(r"[\x00-\u052f\u2000-\u206f\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fef\uac00-\ud7a3]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: the
    byte's own character where it is printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary with its tables.  A word is spelt with one character per byte; where
    the file marks word ends, the last byte's character lies 256 higher."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback",
                           "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"only plain byte-level BPE is supported, not {model['type']} with {odd}")
        self.library = None
        self.spec = spec
        letters = byte_letters()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.end = 256 if suffix else 0
        spelling = {vocab[c]: chr(b) for b, c in enumerate(letters)}
        if suffix:
            spelling |= {vocab[c + suffix]: chr(256 + b) for b, c in enumerate(letters)}
        self.single = {s: i for i, s in spelling.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[a + b]
            self.rank.setdefault((vocab[a], vocab[b]), (r, new))
            spelling.setdefault(new, spelling[vocab[a]] + spelling[vocab[b]])
        self.spelling = spelling
        self.length = {i: len(s) for i, s in spelling.items()}
        # only tokens that the rules make of their own spelling ever occur
        live = {s: i for i, s in spelling.items() if self.merge(s) == [i]}
        self.automaton = ahocorasick.Automaton()
        for s, i in live.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        self.shorter = {i: next((live[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in live), None)
                        for s, i in live.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        # special tokens, and the table of spellings for decoding
        added = data.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with matching options are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        pre = data.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers") or []
        self.own_rule = (data.get("normalizer") or {}).get("normalizers") == NORMALIZER and len(steps) == 2 \
            and steps[0] == SPLIT and steps[1]["type"] == "ByteLevel" \
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        decoder = data.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError(f"decoder {decoder['type']} is not supported")
        self.gap = 0 if decoder else 1                  # without a decoder, a space between tokens
        back = {c: b for b, c in enumerate(letters)}
        table = {i: bytes(back[c] for c in t) if decoder else t.encode() for t, i in vocab.items()}
        table |= {i: t.encode() for t, i in self.added.items()}
        self.known = np.zeros(max(table, default=-1) + 1, bool)
        self.known[list(table)] = True
        flat = [table.get(i, b"") + b" " * self.gap for i in range(len(self.known))]
        self.offsets = np.cumsum([0] + [len(t) for t in flat])
        self.flat = np.frombuffer(b"".join(flat), np.uint8)

    def merge(self, spelt: str) -> list[int]:
        """The merge rules applied as they stand, lowest rank first (for single tokens and pairs)."""
        ids = [self.single[c] for c in spelt]
        while len(ids) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i:i + 2] = [new]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Do the rules leave these two neighbours apart?"""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.spelling[a] + self.spelling[b]) == [a, b]
        return known

    def encode_word(self, spelt: str) -> list[int]:
        n, length, shorter, compatible = len(spelt), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.automaton.iter(spelt[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0] if n else None
        while at < n:
            while token is not None and (at + length[token] in dead or out and not compatible(out[-1], token)):
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _kept(self, word: str) -> bytes:
        """A word's ids as bytes, kept for the next time."""
        spelt = word.encode().decode("latin-1")
        if self.end:
            spelt = spelt[:-1] + chr(ord(spelt[-1]) + self.end)
        ids = np.array(self.encode_word(spelt), np.int32).tobytes()
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.own_rule and STABLE.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return WORD.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.spec.decode())
            self.back = {ord(c): b for b, c in enumerate(byte_letters())}
        tok = self.library
        text = tok.normalizer.normalize_str(text) if tok.normalizer else text
        return [w.translate(self.back).encode("latin-1").decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> np.ndarray:
        words, kept, out = self.words, self._kept, []
        parts = self.split_added.split(text) if self.split_added and "<" in text else [text]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.added[part]], np.int32).tobytes())
            elif part:
                out += [words.get(w) or kept(w) for w in self.cut(part)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets): the text of each ``ids[ptr[r]:ptr[r+1]]``."""
        ok = (ids >= 0) & (ids < len(self.known))
        ok[ok] = self.known[ids[ok]]
        ptr = np.r_[0, np.cumsum(ok)][ptr]
        ids = ids[ok]
        size = self.offsets[ids + 1] - self.offsets[ids]
        if self.gap:                                    # none behind the last
            size[ptr[1:][ptr[1:] > ptr[:-1]] - 1] -= self.gap
        ends = np.r_[0, np.cumsum(size)]
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends[:-1], size)
        return self.flat[at], ends[ptr]


@lru_cache(maxsize=2)
def _loaded(spec: bytes) -> Bpe:
    return Bpe(spec)


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        spec = f.read(MAX_FILE_BYTES + 1)
    if len(spec) > MAX_FILE_BYTES:
        raise ValueError(f"{path}: over {MAX_FILE_BYTES} bytes, too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    shared = _shared(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = _loaded(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held, chars, lo = [], 0, 0
            for r in range(batch.num_rows):
                text = texts[r].as_py()
                held.append(bpe.encode(text))
                chars += len(text)
                if chars >= PIECE or r == batch.num_rows - 1:
                    ptr = np.cumsum([0] + [len(h) for h in held])
                    yield pa.RecordBatch.from_arrays(
                        [keys[lo:r + 1], as_list(np.concatenate(held), ptr, pa.int32())], schema=schema)
                    held, chars, lo = [], 0, r + 1

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text of every row's ids, special tokens kept.  Bytes
    that are not UTF-8 (byte-level decoders only) become U+FFFD."""
    shared = _shared(encoded, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        bpe = _loaded(shared.value)
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            ids, ptr = list_values(lists)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ptr, ptr[lo] + PIECE, side="right")) - 1)
                hi = min(hi, batch.num_rows)
                flat, ends = bpe.decode(ids[ptr[lo]:ptr[hi]], ptr[lo:hi + 1] - ptr[lo])
                if bpe.gap:
                    text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat))
                else:
                    raw = flat.tobytes()
                    text = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([keys[lo:hi], lists[lo:hi], text], schema=schema)
                lo = hi

    known = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.filter(known, lambda i: i.isNotNull()).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))
