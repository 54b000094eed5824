"""Secrets in whole texts: known forms by pattern, random strings by how badly a tokenizer compresses them."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import read_table, texts

# The kinds in the order of the result, and the patterns of the base.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ with 32 characters or more
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
ASSIGN_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.!@#$%^&*~-]{12,}")
ENDS = "=.-_/!@#$%^&*~"  # signs that are no part of a string at its ends
PART = re.compile(r"[A-Za-z0-9!@#$%^*~]{12,}")  # between separators of a run
# Least lengths: a run, a part of several kinds of characters, a part of letters only.  Long words of little known
# languages compress badly too, so letters alone must be more.
RUN_LENGTH, MIXED_LENGTH, LETTERS_LENGTH = 20, 12, 24
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}  # md5, sha1, ... sha512 in hexadecimal
HEX_ONLY = re.compile(r"(?:0x)?([0-9a-fA-F]+)")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
SEPARATOR = re.compile(r"[._/=+-]+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+\d{0,4}|[A-Z]+\d{0,4}|\d+|")
_VOCABULARIES: dict[str, object] = {}


def vocabulary(path: str):
    """The tiktoken encoding of this Python worker for a file of base64 tokens and ranks."""
    if path not in _VOCABULARIES:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _VOCABULARIES[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _VOCABULARIES[path]


def known_form(text: str) -> bool:
    """Digests, UUIDs, numbers and identifiers: long and perhaps badly compressed, but no secrets."""
    if (m := HEX_ONLY.fullmatch(text)) and len(m[1]) in DIGEST_LENGTHS:
        return True
    if UUID.fullmatch(text):
        return True
    # snake_case, dotted, path-like or dashed names: parts that are words, constants or numbers
    return all(NAME_PART.fullmatch(p) for p in SEPARATOR.split(text))


def stripped(m: re.Match, text: str) -> tuple[int, int]:
    """Ends of a match without the signs around it."""
    found = text[m.start() : m.end()]
    start = m.end() - len(found.lstrip(ENDS))
    return start, max(start, m.start() + len(found.rstrip(ENDS)))


def random_part(part: str, random) -> bool:
    """Whether a string without separators is random: badly compressed, no number and no digest."""
    if part.isdigit() or (m := HEX_ONLY.fullmatch(part)) and len(m[1]) in DIGEST_LENGTHS:
        return False
    mixed = any(c.isdigit() for c in part) or not part.isalnum()
    mixed = mixed or not (part.islower() or part.isupper() or part[1:].islower())
    return len(part) >= (MIXED_LENGTH if mixed else LETTERS_LENGTH) and random(part)


def random_spans(text: str, tokens, most_chars_per_token: float) -> Iterator[tuple[int, int]]:
    """Whole runs that are random, and of other runs the random parts between separators."""

    def random(found: str) -> bool:
        return len(found) / len(tokens.encode_ordinary(found)) <= most_chars_per_token

    for m in CANDIDATE.finditer(text):
        start, end = stripped(m, text)
        found = text[start:end]
        kinds = any(c.isdigit() for c in found) + any(c.isupper() for c in found) + any(c.islower() for c in found)
        if len(found) >= RUN_LENGTH and kinds > 1 and not known_form(found) and not UUID.search(found) and random(found):
            name = found.rfind("=") + 1  # what is assigned stands alone if it is random itself
            yield (start + name if len(found) - name >= MIXED_LENGTH and random(found[name:]) else start), end
            continue
        uuids = [u.span() for u in UUID.finditer(text, start, end)]
        for part in PART.finditer(text, start, end):
            a, b = stripped(part, text)
            if not any(a < high and low < b for low, high in uuids) and random_part(text[a:b], random):
                yield a, b


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def find_secrets(
    docs: DataFrame, ranks: str, most_chars_per_token: float = 2.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end) in code points, end exclusive.

    Base kinds are assign, access and hex.  ``random`` spans are strings whose characters per token under the vocabulary
    in ``ranks`` are at most ``most_chars_per_token``: text that the vocabulary was made from compresses to four or more,
    random strings to less than two.  A run of letters, digits and signs of RUN_LENGTH or more is judged as a whole; if it
    is random, only what follows its last ``=`` counts, should that be random too; if not, each of its parts is judged, between separators (``. _ / = + & -``), from MIXED_LENGTH on, or from
    LETTERS_LENGTH on when it is letters of one case.  Known digests, UUIDs and numbers are left out of this kind only.

    Spans are ordered by start, then by kind as listed above.  Whole texts are searched where they are read, without
    a shuffle; a text of any length is one string of its task.  Null and empty texts have no spans; null ids and repeated rows are kept; an empty table gives an empty
    result; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    fields = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = []
                for text in batch.column(1).to_pylist():
                    found = base_spans(text) + [(a, 3, b) for a, b in random_spans(text, tokens, most_chars_per_token)]
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, fields[1].type)], schema=fields)

    kind = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return texts(docs, id_col, text_col).mapInArrow(search, kind)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = find_secrets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("random"),
    )
