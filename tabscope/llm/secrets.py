"""Secrets by patterns and by a token-efficiency test.

Patterns find assignments to names of secrets, access keys and long hexadecimal strings. The token-efficiency test holds
every run of 16 or more characters of ``[A-Za-z0-9+/_-]``, with padding, against a tiktoken vocabulary: text that people write takes few
tokens for its length, random strings take many. A run with fewer than ``CHARS_PER_TOKEN`` characters per token is a span
``random``, unless it is a known digest (hexadecimal, of the length of a common digest), a UUID, or an identifier or number
(words of letters and digits in one of the usual spellings) each word of which has as many characters per token by itself:
its marks may cost tokens, its words may not. Keys of lower-case or upper-case letters or of digits alone are tested like others.

Defined cases: a null text counts as empty and has no spans. Matches that fail their test are dropped without a second
try. Rows that repeat a doc_id are judged each by its text. Texts are searched whole; an empty table gives an empty result;
other columns are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import by_value, slices

KINDS = ("assign", "access", "hex", "random")
CHARS_PER_TOKEN = 2.0

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("passw", "secret", "token", "api")
# Runs are maximal and start where the plain pattern's do, so the least length can stand in the pattern.
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
_RUN = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
_DIGEST = re.compile("[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Numbers, and words of letters, alone or joined by one kind of mark, with a number at the end at most.
_IDENTIFIER = re.compile("[0-9/_=+-]+|[_/=+-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[0-9]{0,4}[_/=+-]*|[A-Z]?[a-z]{3,}(?:[A-Z][a-z]{2,})*[0-9]{0,4}")
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Scanner:
    """Searches texts; one per worker, with the answers it gave before."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._random: dict[str, bool] = {}

    def _inefficient(self, run: str) -> bool:
        return len(run) < CHARS_PER_TOKEN * len(self._encode(run))

    def is_random(self, run: str) -> bool:
        if (known := self._random.get(run)) is None:
            if len(self._random) > 200_000:
                self._random.clear()
            exempt = (_UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run)
                      or _IDENTIFIER.fullmatch(run) and not any(map(self._inefficient, _WORDS.findall(run))))
            known = self._random[run] = not exempt and self._inefficient(run)
        return known

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        low = text.lower()
        if any(name in low for name in _NAMES):
            found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        found += [("random", *m.span()) for m in _RUN.finditer(text) if self.is_random(m[0])]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scanned(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct(kind, start, end)>) for every row, spans by start and kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(ranks_path, pattern)
        for batch in slices(batches, 1):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(value or "")] for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long")))])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


by_value(__name__)
