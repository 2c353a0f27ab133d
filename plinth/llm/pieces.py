"""SentencePiece BPE encoding with a prefix table, and decoding.

Merging pairs in order of rank gives one result, and two neighbours can stand in it only if encoding both together
keeps them apart (they are compatible). So for each prefix of a text there is one last piece: the piece that
ends there and is compatible with the last piece of the prefix before it. The table stores that piece for every prefix, found
from the pieces that an automaton matches at each end, and the ids are read off it backwards.

Pieces hold the word mark at their start alone, and characters outside the vocabulary never merge, so words are encoded each for itself
and a bounded table remembers the recent ones. Characters without a piece become byte pieces.

Defined results: null and empty texts have no ids and decode to the empty text; texts are taken whole; repeated rows get a row each;
a lone surrogate, which UTF-8 lacks, is read as U+FFFD; an empty table gives no rows. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, small

MARK = "▁"
#: Words that a worker remembers: two tables of this many, of which the older goes first.
REMEMBERED = 100_000
#: A word of more characters is not remembered; so many answers of the pair test are, before they are forgotten.
LONG_WORD, PAIRS = 100, 400_000


class Pieces:
    """The vocabulary of a BPE model with byte fallback, prepared for prefix tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[int, str] = {}
        self.bytes_of: dict[int, int] = {}
        self.byte_id: dict[int, int] = {}
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(model.vocab_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = int(p[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[p], self.text[i], self.rank[p] = i, p, model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds the word mark after its start: words can't be encoded each for itself")
        # How each piece comes about: the last merge of its own encoding. None for single characters.
        self.halves: dict[str, tuple[str, str] | None] = {}
        for p in sorted(self.id, key=len):
            if len(p) == 1:
                self.halves[p] = None
            elif half := self._last_merge(p):
                self.halves[p] = half
        # Pieces that merging never makes can't occur in a result, so the automaton leaves them out.
        self.automaton = ahocorasick.Automaton()
        for p in self.halves:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.characters = {p for p in self.id if len(p) == 1}
        self.known: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts = list(piece)
        while len(parts) > 1:
            best = max(((self.rank[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = -best[1]
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when merging starts from the characters of a + b.

        Follows the merges backwards: at each step the later of the two sides' merges is undone, unless a merge across the border
        would have come before it."""
        key = (a, b)
        if (known := self.known.get(key)) is not None:
            return known
        rank, halves = self.rank, self.halves
        limit = float("-inf")
        result = True
        while True:
            across = rank.get(a + b)
            # The pair would have merged before one of the later merges took it apart, or now.
            if across is not None and across > limit:
                result = False
                break
            left, right = halves[a], halves[b]
            if left is None and right is None:
                break
            # Of equal ranks the left one merges first, so the right one is undone first.
            if right is None or left is not None and rank[a] < rank[b]:
                limit, was_left = rank[a], True
                a = left[1]
            else:
                limit, was_left = rank[b], False
                b = right[0]
            across = rank.get(a + b)
            if across is not None and (across > limit or across == limit and was_left is False):
                result = False
                break
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[key] = result
        return result

    def _run(self, run: str) -> list[str]:
        """The pieces of a run of known characters, by its prefix table."""
        if run in self.halves:
            return [run]
        n = len(run)
        last: list[str | None] = [None] * (n + 1)
        known = self.known
        for end, p in self.automaton.iter(run):
            end += 1
            if last[end] is not None:
                continue
            at = end - len(p)
            if not at:
                last[end] = p
            elif (before := last[at]) is not None:
                fits = known.get((before, p))
                if fits if fits is not None else self.compatible(before, p):
                    last[end] = p
        out, i = [], n
        while i:
            p = last[i]
            if p is None:
                raise ValueError(f"no piece ends at {i} of {run[:50]!r}")
            out.append(p)
            i -= len(p)
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        if self.characters.issuperset(word):
            return [self.id[p] for p in self._run(word)]
        ids: list[int] = []
        run = ""
        for c in word:
            if c in self.id:
                run += c
                continue
            if run:
                ids += [self.id[p] for p in self._run(run)]
                run = ""
            ids += [self.byte_id[x] for x in c.encode("utf-8", "replace")] if not "\ud800" <= c <= "\udfff" else [self.byte_id[x] for x in b"\xef\xbf\xbd"]
        if run:
            ids += [self.id[p] for p in self._run(run)]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, still with word marks for blanks; byte pieces that are not UTF-8 become U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def look_up(self, units: list[str]) -> list[tuple[str, int, str]]:
        """For each unit the ids joined by commas, their number, and what they decode to. A unit is a word without its mark, or starts
        with a line end."""
        found = list(map(self.young.get, units))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.young.get(units[i]) or self._new(units[i])
        return found

    def _new(self, unit: str) -> tuple[str, int, str]:
        if (found := self.old.get(unit)) is None:
            word = unit if unit[:1] == "\n" else MARK + unit
            ids = self.encode_word(word)
            decoded = self.decode_ids(ids)
            found = ",".join(map(str, ids)), len(ids), word if decoded == word else decoded
            if len(unit) > LONG_WORD:
                return found
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[unit] = found
        return found


#: A word: marks, then what follows up to the next mark; a line end starts a word too (it has no piece).
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


@functools.cache
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def marked(text: str) -> str:
    """What the library's normaliser makes of a text under this model: a blank before it, blanks as word marks."""
    return MARK + text.replace(" ", MARK) if text else ""


def encode(p: Pieces, text: str | None) -> list[int]:
    return [i for w in _WORDS.findall(marked(text or "")) for i in p.encode_word(w)]


def decode(p: Pieces, ids: list[int]) -> str:
    """Of ids as the library decodes them: the blank that encoding puts first is taken off."""
    return p.decode_ids(ids).replace(MARK, " ").removeprefix(" ")


def units_of(text: str) -> list[str] | None:
    """The words between single blanks, without marks; None where blanks come in a row or marks stand in the text."""
    units = text.replace("\n", " \n").split(" ")
    return None if "" in units or MARK in text else units


def _plain(p: Pieces, word: str) -> tuple[str, int, str]:
    ids = p.encode_word(word)
    return ",".join(map(str, ids)), len(ids), p.decode_ids(ids)


def digest(p: Pieces, text: str | None) -> tuple[int, str, str]:
    """The number of ids, and the SHA-256 of the ids and of what they decode to."""
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    text = text or ""
    units = units_of(text)
    words = units if units is not None else _WORDS.findall(marked(text))
    for i in range(0, len(words), 50_000):  # a very long text in parts
        part = words[i : i + 50_000]
        found = p.look_up(part) if units is not None else [p.look_up([w[1:]])[0] if w[0] == MARK and w[1:2] not in ("", MARK, "\n") else _plain(p, w) for w in part]
        joined, back = ",".join([x[0] for x in found]), "".join([x[2] for x in found]).replace(MARK, " ")
        ids.update(("," + joined if i else joined).encode())
        decoded.update((back if i else back.removeprefix(" ")).encode("utf-8", "replace"))
        n += sum([x[1] for x in found])
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in small(batches):
            ids = [encode(p, t) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(p, x or []) for x in column(b, "ids")], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs: ids and decoded text stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in small(batches):
            found = [digest(p, t) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
