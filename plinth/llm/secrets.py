"""Secret scans: fixed base patterns, and a token-efficiency test for random strings.

A tokenizer that learned from ordinary text needs few tokens for words and many for random characters. Runs of key-like
characters with few characters a token (a tiktoken vocabulary counts) are reported as kind `random`, after runs that
are known to be harmless are taken out: digests of standard lengths in hex of either case, UUIDs, numbers and dates,
runs of capitals, small letters or digits alone (words that the vocabulary doesn't know are such), and runs of few characters. A run is counted part by part between its slashes, so a path passes if its names read like words and
a key with slashes doesn't. Base spans are always kept as they are; a random run inside one is reported too.

Defined results: null and empty texts have no spans; repeated rows get a row each; spans are in code points, end
exclusive, ordered by start and then by kind in the order of KINDS; an empty list is the empty text, and has its digest.
Whole texts are searched, whatever their length; an empty table gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, small

KINDS = ("assign", "access", "hex", "random")
#: The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Runs that the token test looks at: their least length, most characters a token, least bits a character.
RUN_LEAST, CHARS_A_TOKEN, BITS = 16, 2.0, 3.0
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{RUN_LEAST},}}={{0,2}}")
#: Known digests (MD5, SHA-1, SHA-224 to SHA-512) and identifiers (UUIDs, numbers and dates).
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+)")

_LOOK = bytes.maketrans(bytes(range(256)), bytes(0x78 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 0x20 for c in range(256)))
_HEXES = bytes.maketrans(bytes(range(256)), bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256)))
_NAMES = (b"passw", b"secret", b"token", b"key")


@functools.cache
def vocabulary(path: str):
    """The tokenizer of a rank file; one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns. Cheap byte tests leave out texts without a match."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    low = raw.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in raw.translate(_HEXES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def reads_like_words(run: str, path: str) -> bool:
    """Whether the parts between slashes have CHARS_A_TOKEN characters a token together. Long parts are counted piece by piece: the ratio needs no
    token across a cut."""
    parts = [x[i : i + 1000] for x in run.rstrip("=").split("/") for i in range(0, len(x), 1000)]
    return sum(map(len, parts)) >= CHARS_A_TOKEN * sum(len(vocabulary(path).encode_ordinary(x)) for x in parts)


def random_spans(text: str, path: str) -> list[tuple[int, int, int]]:
    if b"x" * RUN_LEAST not in text.encode("utf-8", "surrogatepass").translate(_LOOK):
        return []
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if KNOWN.fullmatch(run) or text[m.start() - 1 : m.start()].isalpha() or text[m.end() : m.end() + 1].isalpha():  # the rest of a word in other letters
            continue
        if sum(any(map(kind, run)) for kind in (str.islower, str.isupper, str.isdigit)) < 2:
            continue
        n = Counter(run)
        if -sum(c / len(run) * math.log2(c / len(run)) for c in n.values()) < BITS:
            continue
        if not reads_like_words(run, path):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random for each row of docs."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            counts, digests, spans = [[], [], [], []], [], []
            for t in column(b, "text"):
                base = base_spans(t) if t else []
                extra = random_spans(t, path) if t else []
                both = sorted(base + extra)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in both))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests), pa.array(spans), pa.array(counts[3], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
