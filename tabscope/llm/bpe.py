"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: its arcs are labelled with tokens, and of the token sequences that spell a word it
accepts exactly the one that applying the merges in order gives. It is built by one gadget per merge, in order.
For the merge of ``a`` and ``b`` to ``ab`` the gadget

* splits the state that ``a`` leads to off from the states it shares, and closes its arc ``b``: after ``a``
  there is no ``b`` any more;
* gives every state with an open arc ``a`` an arc ``ab`` that leads where ``b`` led before.

So a state is named by the token read last. States inherit from the right part of their token what had been
closed before it was made, and arcs inherit from their left part.

When all gadgets are in, the automaton is laid out in flat arrays of a few MB. Arcs are numbered so that an arc comes after
all arcs that inherit from it, older ones first: what one gadget closes is then one run of numbers, and the row of a state is
its own runs and those inherited, united and sorted. Whether an arc is open is one search in the sorted rows. Beside them a
table of symbols, with failure links, gives for each node the longest token that ends there, and for each token the next shorter one.

Words are encoded many at a time, symbol by symbol and table read by table read over arrays. Each prefix of a word has one
accepted sequence, so at each symbol its last token is the one, of those that end there, whose arc is open from the state
of what precedes it. Decoding emits the labels of the arcs.

Texts are split into words beforehand the way the vocabulary file says: special tokens are cut out, then the text
is normalised, lower-cased and split. Latin-1 texts, where these steps are a lower-casing and one expression that
never crosses a space, are remembered by what stands between spaces; all others go through the file's own normaliser and splitter.

Defined cases: null and empty texts give no tokens. Texts of any length are encoded whole, a few MB at a time; repeated rows
give their tokens each, and an empty table an empty result. Further columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import Remembered, by_value, give_back, slices

#: Chunks that a worker remembers in each of two generations, and symbols that it encodes at a time.
REMEMBERED, AT_ONCE = 100_000, 1 << 20


class _Gadgets:
    """The automaton while it is built: what each merge closed, and what inherits from what."""

    def __init__(self, size: int):
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.closed: dict[tuple[int, int], int] = {}

    def is_open(self, state: int, arc: int) -> bool:
        before = 1 << 60
        while state >= 0:
            part, until = arc, 1 << 60
            while part >= 0:
                number = self.closed.get((state, part))
                if number is not None and number < before and number <= until:
                    return False
                part, until = self.left[part], self.made[part]
            state, before = self.right[state], self.made[state]
        return True

    def add(self, number: int, left: int, right: int, joined: int) -> bool:
        """Whether a path still reads the pair, so that its gadget changes anything."""
        if not self.is_open(left, right):
            return False
        self.closed[left, right] = number
        self.made[joined], self.left[joined], self.right[joined] = number, left, right
        return True

    def numbered(self) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """(number of each arc, lowest number among what inherits from it, its heirs from the oldest)."""
        size = len(self.made)
        heirs: list[list[int]] = [[] for _ in range(size)]
        for token in sorted(range(size), key=self.made.__getitem__):
            if self.left[token] >= 0:
                heirs[self.left[token]].append(token)
        place, lowest, count = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        stack = [(token, False) for token in range(size - 1, -1, -1) if self.left[token] < 0]
        while stack:
            token, done = stack.pop()
            if done:
                place[token] = count
                count += 1
            else:
                lowest[token] = count
                stack.append((token, True))
                stack += [(heir, False) for heir in reversed(heirs[token])]
        return place, lowest, heirs

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each arc, sorted run starts, run ends), both as state * states + number."""
        size = len(self.made)
        place, lowest, heirs = self.numbered()
        own: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        for (state, arc), number in self.closed.items():  # in order of number
            first = next((h for h in heirs[arc] if self.made[h] >= number), arc)
            own[state].append((number, int(lowest[first] if first != arc else place[arc]), int(place[arc])))
        runs = [np.array(o, np.int64).reshape(-1, 3) for o in own]
        inherited: dict[int, np.ndarray] = {}
        starts, ends = [], []
        nothing = np.empty((0, 2), np.int64)
        for state in sorted(range(size), key=self.made.__getitem__):
            above, given = self.right[state], nothing
            if above >= 0:
                before = runs[above][:np.searchsorted(runs[above][:, 0], self.made[state]), 1:]
                given = _united(np.concatenate([before, inherited[above]]))
            inherited[state] = given
            row = _united(np.concatenate([runs[state][:, 1:], given])) + state * size
            starts.append(row[:, 0])
            ends.append(row[:, 1])
        low, high = np.concatenate([nothing[:, 0], *starts]), np.concatenate([nothing[:, 1], *ends])
        order = low.argsort()
        return place, low[order].astype(np.int64), high[order].astype(np.int64)


def _united(runs: np.ndarray) -> np.ndarray:
    """Overlapping or adjacent runs as one."""
    if len(runs) < 2:
        return runs
    runs = runs[runs[:, 0].argsort()]
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.r_[True, runs[1:, 0] > reach[:-1] + 1])
    return np.stack([runs[first, 0], reach[np.r_[first[1:] - 1, len(runs) - 1]]], axis=1)


class TokenAutomaton:
    """Deterministic automaton over tokens, compiled from the merges of a vocabulary.

    ``tables`` is all of it in flat arrays, for shipping it once to each worker.
    """

    def __init__(self, tables: dict):
        self.tables = tables

    @classmethod
    def compiled(cls, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = "") -> TokenAutomaton:
        size = max(vocabulary.values(), default=-1) + 1
        labels = [""] * size
        for label, i in vocabulary.items():
            labels[i] = label
        made = {left + right for left, right in merges}
        # Tokens of several symbols that no merge makes have no arc.
        arcs = {i for label, i in vocabulary.items()
                if label in made or len(label.removesuffix(word_end) if word_end else label) == 1}
        gadgets = _Gadgets(size)
        for number, (left, right) in enumerate(merges):
            a, b, joined = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if a not in arcs or b not in arcs or not gadgets.add(number, a, b, joined):
                arcs.discard(joined)
        place, low, high = gadgets.rows()
        spelled = {}
        for i in arcs:
            last = bool(word_end) and labels[i].endswith(word_end)
            spelled[i] = [ord(c) for c in (labels[i].removesuffix(word_end) if last else labels[i])]
            if last:
                spelled[i][-1] += _LAST
        # One string of all labels: many small objects would keep the memory of the construction from being given back.
        return cls({"labels": _BETWEEN.join(labels), "place": place, "low": low, "high": high, "ends": bool(word_end)} | _symbols(spelled, size))

    def _is_open(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        t = self.tables
        key = states * len(t["place"]) + t["place"][arcs]
        at = np.searchsorted(t["low"], key, side="right") - 1
        return (at < 0) | (t["high"][at] < key) if len(t["low"]) else np.ones(len(key), bool)

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Tokens of each word, given as a string of base symbols; 4 bytes each."""
        out: list[bytes] = []
        start = held = 0
        for i, word in enumerate(words):
            held += len(word)
            if held >= AT_ONCE or i + 1 == len(words):
                out += self._encode(words[start:i + 1])
                start, held = i + 1, 0
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        t = self.tables
        n = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-n, kind="stable")
        shortness = -n[order]
        first = np.zeros(len(words) + 1, np.int64)
        np.cumsum(n, out=first[1:])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        if t["ends"]:
            codes[first[1:][n > 0] - 1] += _LAST
        begin = first[:-1][order]
        last = np.empty(len(codes), np.int64)  # of each prefix the token read last
        node = np.zeros(len(words), np.int64)
        for spot in range(int(n.max(initial=0))):
            active = int(np.searchsorted(shortness, -spot, side="left"))  # the words longer than this
            here = begin[:active] + spot
            node = self._follow(node[:active], codes[here])
            token, undecided = t["longest"][node], np.arange(active)
            while len(undecided):
                arc = token[undecided]
                if (arc < 0).any():
                    raise ValueError(f"a symbol of {words[order[undecided[(arc < 0).argmax()]]]!r} is not in the vocabulary")
                before = spot - t["length"][arc]
                inner = before >= 0
                spans, arcs = undecided[inner], arc[inner]
                shut = spans[~self._is_open(last[begin[spans] + before[inner]], arcs)]
                token[shut] = t["shorter"][token[shut]]
                undecided = shut
            last[here] = token
        return self._traced(last, first, n)

    def _follow(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next node of each, by the table of arcs, else by the node's failure link."""
        t, new, seeking = self.tables, np.zeros(len(node), np.int64), np.arange(len(node))
        while len(seeking):
            key = node << 22 | code
            at = np.searchsorted(t["arcs"], key)  # the last arc is larger than any
            found = t["arcs"][at] == key
            new[seeking[found]] = t["to"][at[found]]
            left = np.flatnonzero(~found & (node > 0))  # at the root nothing is left to try
            seeking, code, node = seeking[left], code[left], t["fail"][node[left]]
        return new

    def _traced(self, last: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Back from the end of each word, token by token."""
        length, at, words, tokens = self.tables["length"], n.copy(), [], []
        active = np.flatnonzero(at)
        while len(active):
            token = last[first[active] + at[active] - 1]
            words.append(active)
            tokens.append(token.astype("<i4"))
            at[active] -= length[token]
            active = active[at[active] > 0]
        if not words:
            return [b""] * len(n)
        word, token = np.concatenate(words)[::-1], np.concatenate(tokens)[::-1]
        flat = token[np.argsort(word, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(n)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, word: str) -> list[int]:
        return np.frombuffer(self.encode_all([word])[0], "<i4").tolist()


#: Between two labels; no label holds it.
_BETWEEN = "\0"
#: Added to the code of a word's last symbol, where the vocabulary tells it from the same symbol inside.
_LAST = 1 << 21


def _symbols(spelled: dict[int, list[int]], size: int) -> dict[str, np.ndarray]:
    """Tables that read symbols: arcs (node << 22 | symbol) and where they lead, failure links, and tokens by length."""
    to: dict[int, int] = {}
    token_at: list[int] = [-1]
    for token, codes in spelled.items():
        node = 0
        for code in codes:
            key = node << 22 | code
            if (after := to.get(key)) is None:
                after = to[key] = len(token_at)
                token_at.append(-1)
            node = after
        token_at[node] = token
    arcs = sorted(to)  # by node
    nodes = np.array(arcs, np.int64) >> 22
    starts = np.searchsorted(nodes, np.arange(len(token_at) + 1)).tolist()
    fail, longest, queue = [0] * len(token_at), token_at[:], [0]
    shorter, length = np.full(size, -1, np.int64), np.ones(size, np.int64)
    for node in queue:  # breadth first, so that shorter suffixes are ready
        for key in arcs[starts[node]:starts[node + 1]]:
            child, code, link = to[key], key & (1 << 22) - 1, fail[node]
            while node and link and (link << 22 | code) not in to:
                link = fail[link]
            fail[child] = to.get(link << 22 | code, 0) if node else 0
            if (token := token_at[child]) >= 0:
                shorter[token], length[token] = longest[fail[child]], len(spelled[token])
            else:
                longest[child] = longest[fail[child]]
            queue.append(child)
    return {"arcs": np.array([*arcs, 1 << 62], np.int64), "to": np.array([*map(to.__getitem__, arcs), 0], np.int64), "fail": np.array(fail, np.int64),
            "longest": np.array(longest, np.int64), "shorter": shorter, "length": length}


def byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


@functools.lru_cache(2)
def compiled(path: str) -> dict:
    """The tables of a vocabulary file with word ends."""
    tables = _compiled(path)
    give_back()
    return tables


def _compiled(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    bpe, special = model["model"], {t["content"]: t["id"] for t in model["added_tokens"]}
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    tables = TokenAutomaton.compiled(bpe["vocab"], pairs, bpe["end_of_word_suffix"] or "").tables
    labels = tables["labels"].split(_BETWEEN)
    labels += [""] * (max(special.values(), default=-1) + 1 - len(labels))
    for label, i in special.items():
        labels[i] = label
    return tables | {"labels": _BETWEEN.join(labels), "special": special, "split": model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], "path": path}


#: Marks of words that are no chunk of a plain text, and of special tokens; neither begins a chunk.
_WORD, _SPECIAL = "\0", "\1"


class Codec:
    """Encoder and decoder over such tables. What it has seen stays in ``known``, for the worker's next task."""

    def __init__(self, tables: dict, known: Remembered):
        import regex

        self.automaton, self.special, self._path = TokenAutomaton(tables), tables["special"], tables["path"]
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._split = regex.compile(tables["split"]).findall
        self._plain = re.compile(r"[\t\n\r\x20-\x7E\xA0-\xFF]*").fullmatch
        self._symbols, self._labels = byte_symbols(), pa.array(tables["labels"].split(_BETWEEN), pa.string())
        self._letters = r"|[\p{L}]+|" in tables["split"]  # letters alone are one word then
        self._known, self._library = known, None

    def _words(self, chunk: str) -> list[str]:
        """The words between two spaces, as symbols."""
        words = [chunk] if self._letters and chunk.isalpha() else self._split(chunk)
        if chunk.isascii():  # each character is its own symbol
            return words
        return ["".join(map(self._symbols.__getitem__, w.encode())) for w in words]

    def _others(self, text: str) -> list[str]:
        """Words, as symbols, of any text, by the file's own normaliser and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Tokens of distinct chunks; all words not seen before are encoded together."""
        get, found, unseen = self._known.get, [], {}
        for i, chunk in enumerate(chunks):
            ids = get(chunk)
            found.append(ids)
            if ids is None:
                unseen[i] = [chunk[1:]] if chunk[:1] == _WORD else self._words(chunk)
        words = list(dict.fromkeys(chain.from_iterable(unseen.values())))
        ids_of = dict(zip(words, self.automaton.encode_all(words)))
        for i, own in unseen.items():
            found[i] = ids_of[own[0]] if len(own) == 1 else b"".join(map(ids_of.__getitem__, own))
            self._known.put(chunks[i], found[i])
        return found

    def _chunks(self, texts: list[str]) -> pa.ListArray:
        """What stands between spaces in texts of the plain kind, else the words, marked as such."""
        plain = [self._plain(t) is not None and not (self._cut and self._cut.search(t)) for t in texts]
        lowered = pc.utf8_lower(pa.array([t if is_plain else "" for t, is_plain in zip(texts, plain)], pa.string()))
        lists = pc.utf8_split_whitespace(lowered)
        if all(plain):
            return lists
        others = [[w for part in (self._cut.split(t) if self._cut else [t])
                   for w in ([_SPECIAL + part] if part in self.special else [_WORD + w for w in self._others(part)])]
                  for t, is_plain in zip(texts, plain) if not is_plain]
        both = pa.concat_arrays([lists, pa.array(others, lists.type)])
        place = np.arange(len(texts))
        place[~np.array(plain)] = len(texts) + np.arange(len(others))
        return both.take(pa.array(place))

    def __call__(self, texts: list[str | None]) -> tuple[pa.ListArray, pa.Array]:
        """Tokens and decoded text of each: the labels of the arcs, joined by a space, as for a file without a decoder."""
        lists = self._chunks([t or "" for t in texts])
        ends, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        special = [i for i, c in enumerate(chunks) if c[:1] == _SPECIAL]
        ids = self._ids([c if c[:1] != _SPECIAL else "" for c in chunks]) if chunks else []
        for i in special:
            ids[i] = np.int32(self.special[chunks[i][1:]]).tobytes()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, known = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<i4")
        n = size[at]
        reached = np.concatenate([[0], np.cumsum(n)])
        flat = known[np.repeat(start[at] - reached[:-1], n) + np.arange(reached[-1])]
        offsets = pa.array(reached[ends - ends[0]], pa.int32())
        found = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
        return found, pc.binary_join(pa.ListArray.from_arrays(offsets, self._labels.take(found.values)), " ")


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) per row: the tokens of the whole text and what they decode to."""

    # Some MB, by the vocabulary alone. A worker unpacks it once, so what it has seen serves its later tasks too.
    shared = docs.sparkSession.sparkContext.broadcast((compiled(path), Remembered(REMEMBERED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in slices(batches, 1):
            ids, texts = codec(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, texts if decoded else pa.nulls(len(texts), pa.string())], names=["doc_id", "ids", "decoded"])
        give_back()

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


by_value(__name__)
