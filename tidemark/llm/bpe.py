"""BPE by dynamic programming over prefixes, with a suffix automaton of the vocabulary.

The BPE encoding of every prefix of a word ends in one token, and that token decides all
others: cut it off, and what is left is a prefix again. So one token for each prefix is all
there is to store, and following the tokens back gives the ids. The token of a prefix is a
vocabulary entry that ends there, as the suffix automaton of all entries tells, and that goes
with the last token before it: merging the two side by side crosses no border between them.
Exactly one entry passes.

Whether two tokens go together is read off the edges of their merge trees: the pieces that
touch the border are, at each moment, one of the right edge of the left token and one of the
left edge of the right token. Going back in time from the whole tokens, the pair that touches
must not have a merge that comes before both pieces are merged away from the border. (At equal
rank the leftmost merge comes first, as in the algorithm itself.) Answers are kept in a table
of fixed size.

The time is linear in the length of a word, however long. Words of a batch of texts are encoded
together, position by position, as numpy arrays; words seen before are taken from a bounded
cache. A long text is handled in pieces cut at white space. The vocabulary's arrays are
broadcast: their size (some 20 MB here) depends on the vocabulary alone.

Nulls: a null text is empty, and an empty text has no ids. A null doc_id is kept; repeated
rows are encoded each. Names of extra columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.common import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = np.int64(1) << 40
PIECE = 1 << 20  # characters of a text handled at a time
TOGETHER = 1 << 20  # symbols of words encoded at a time
CACHE = 1 << 18  # words held
LONGEST = 64  # characters of a word that is held
ALONE = 2048  # bytes of a word that is encoded by itself
PAIRS = 1 << 18  # slots for answers on pairs of tokens


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones of Latin-1 for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in printable else next(other)) for b in range(256)]


@dataclass
class Vocabulary:
    """A word BPE as arrays. Symbols are bytes, plus 256 for the last byte of a word."""

    tokens: list[str]  # by id
    special: dict[str, int]
    pattern: str  # of a word
    spelt: str  # the same with its classes spelt out, which is slower
    other: str  # signs on which the two differ
    pair: np.ndarray  # sorted left << 32 | right of all merges
    pair_rank: np.ndarray
    born: np.ndarray  # rank of the merge that makes a token; -1 for a symbol
    left: np.ndarray
    right: np.ndarray
    edge: np.ndarray  # sorted state << 9 | symbol of the automaton
    target: np.ndarray
    link: np.ndarray
    length: np.ndarray  # of the longest string of a state
    token: np.ndarray  # entry that is this string, or -1
    above: np.ndarray  # nearest state with an entry among the proper suffixes, or 0


def classes(split: pre_tokenizers.PreTokenizer) -> tuple[set[int], set[int], set[int]]:
    """Code points that the splitter takes for letters, those for numbers, and those that `regex` takes for something else.

    Tables of Unicode differ between libraries. Code points that Python's tables don't know
    but `regex` does are put to the splitter, each between two letters or two signs: one
    piece is a letter, three pieces between signs are a number.
    """
    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = {ord(c): unicodedata.category(c) for c in signs}
    new = [ord(c) for c in regex.findall(r"\P{Cn}", signs) if kind[ord(c)] == "Cn"]

    def pieces(side: str, codes: list[int]) -> list[int]:
        found = split.pre_tokenize_str("\n".join(f"{side}{chr(c)}{side}" for c in codes))
        return np.bincount(np.array([a for _, (a, _) in found], dtype=np.int64) // 4, minlength=len(codes)).tolist()

    letters = {c for c, n in zip(new, pieces("a", new), strict=True) if n == 1} | {c for c, k in kind.items() if k[0] == "L"}
    numbers = {c for c, n in zip(new, pieces("!", new), strict=True) if n == 3 and c not in letters} | {c for c, k in kind.items() if k[0] == "N"}
    other = {ord(c) for c in regex.findall(r"\p{L}", signs)} ^ letters | {ord(c) for c in regex.findall(r"\p{N}", signs)} ^ numbers
    return letters, numbers, other


def _ranges(codes: set[int]) -> str:
    """The inside of a character set."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file with lower-cased, byte-level words and word ends.

    Raises ValueError for a file that works in another way.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    told = [n["type"] for n in spec["normalizer"]["normalizers"]] + [s["type"] for s in steps] + [spec["post_processor"], spec["decoder"]]
    if told != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel", None, None] or not end or model["continuing_subword_prefix"] or model["dropout"]:
        raise ValueError(f"not a word BPE of the kind handled here: {told}")
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(*vocab.values(), *special.values(), 0) + 1)
    for t, i in [*vocab.items(), *special.items()]:
        tokens[i] = t
    n = len(tokens)
    born, left, right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    pair = np.zeros(len(model["merges"]), dtype=np.int64)
    for rank, merge in enumerate(model["merges"]):
        a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
        made = vocab[tokens[a] + tokens[b]]
        if born[made] >= 0 or max(born[a], born[b]) >= rank:
            raise ValueError(f"merge {rank} makes a known token or uses a later one")
        born[made], left[made], right[made], pair[rank] = rank, a, b, a << 32 | b
    pattern = steps[0]["pattern"]["Regex"]
    letters, numbers, other = classes(pre_tokenizers.Split(Regex(pattern), "removed", invert=True))
    blanks = {c for c in range(0x110000) if chr(c).isspace() and not 0x1C <= c <= 0x1F}
    spelt = pattern.replace(r"\p{L}", _ranges(letters)).replace(r"\p{N}", _ranges(numbers)).replace(r"\s", _ranges(blanks))
    other |= {c for c in blanks if not regex.match(r"\s", chr(c))} | {c for c in range(0x1C, 0x20) if regex.match(r"\s", chr(c))}
    order = np.argsort(pair)
    out = Vocabulary(tokens, special, pattern, spelt, _ranges(other), pair[order], order, born, left, right, *[np.zeros(0, np.int64)] * 6)
    made = np.flatnonzero(born >= 0)
    whole = np.ones(n, dtype=bool)
    whole[made] = _apart(out, left[made], right[made], born[made])
    for t in made[np.argsort(born[made])]:
        whole[t] &= whole[left[t]] and whole[right[t]]
    byte = {c: b for b, c in enumerate(byte_letters())}
    words = {}
    for t, i in vocab.items():
        if whole[i]:
            body = t[: -len(end)] if t.endswith(end) and t != end else t
            word = [byte[c] for c in body]
            if body is not t:
                word[-1] += 256
            words[i] = word
    out.edge, out.target, out.link, out.length, out.token, out.above = automaton(words)
    return out


def automaton(words: dict[int, list[int]]) -> tuple[np.ndarray, ...]:
    """(edge, target, link, length, token, above) of the suffix automaton of all words together."""
    ways, link, length, token = [{}], [-1], [0], [-1]

    def state(like: dict[int, int], size: int) -> int:
        ways.append(dict(like))
        link.append(0)
        length.append(size)
        token.append(-1)
        return len(ways) - 1

    def step(p: int, c: int) -> int:
        """The state of the string of p followed by c, whose length is one more than that of p."""
        if c in ways[p]:
            return split(p, c)
        new, q = state({}, length[p] + 1), p
        while q >= 0 and c not in ways[q]:
            ways[q][c] = new
            q = link[q]
        link[new] = split(q, c) if q >= 0 else 0
        return new

    def split(p: int, c: int) -> int:
        """The state of p followed by c, parted from longer strings that shared its state."""
        q = ways[p][c]
        if length[q] == length[p] + 1:
            return q
        part = state(ways[q], length[p] + 1)
        link[part], link[q] = link[q], part
        while p >= 0 and ways[p].get(c) == q:
            ways[p][c] = part
            p = link[p]
        return part

    for t, word in words.items():
        at = 0
        for c in word:
            at = step(at, c)
        token[at] = t
    above = np.zeros(len(ways), dtype=np.int32)
    for s in np.argsort(np.array(length), kind="stable")[1:]:
        above[s] = link[s] if token[link[s]] >= 0 else above[link[s]]
    edge = np.fromiter((s << 9 | c for s, w in enumerate(ways) for c in w), dtype=np.int64)
    target = np.fromiter((q for w in ways for q in w.values()), dtype=np.int32)
    order = np.argsort(edge)
    arrays = (np.array(x, dtype=np.int32) for x in (link, length, token))
    return edge[order], target[order], *arrays, above


def _apart(v: Vocabulary, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
    """Whether no merge crosses the border of tokens x and y (before rank `until`, if given)."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    ok = np.ones(len(x), dtype=bool)
    until = np.full(len(x), NEVER) if until is None else until
    x_ends, y_ends = until.copy(), until - 1  # the moments at which x and y are merged away from the border
    live = np.arange(len(x))
    while len(live):
        a, b = x[live], y[live]
        key = a << 32 | b
        at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
        rank = np.where(v.pair[at] == key, v.pair_rank[at], NEVER) if len(v.pair) else np.full(len(key), NEVER)
        ok[live[(rank < x_ends[live]) & (rank <= y_ends[live]) & (rank < NEVER)]] = False
        born_a, born_b = v.born[a], v.born[b]
        go = ok[live] & ((born_a >= 0) | (born_b >= 0))
        live, a, b, born_a, born_b = live[go], a[go], b[go], born_a[go], born_b[go]
        cut = born_a > born_b  # the younger piece is taken apart; of two equal ones the right one is younger
        x_ends[live[cut]], x[live[cut]] = born_a[cut], v.right[a[cut]]
        y_ends[live[~cut]], y[live[~cut]] = born_b[~cut], v.left[b[~cut]]
    return ok


class Encoder:
    """Encodes texts with one vocabulary; holds what it has seen within fixed bounds."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.word, self.exact, self.odd = regex.compile(v.pattern), None, re.compile(f"[{v.other}]") if v.other else re.compile("(?!)")
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self.held: dict[str, bytes] = {}
        self.ways: dict[int, int] = {}
        self.states: list[tuple[int, int, int, int]] = []
        self.pairs, self.apart = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)

    def _go_together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 32 | y
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS
        new = np.flatnonzero(self.pairs[slot] != key)
        out = self.apart[slot]
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            answer = _apart(self.v, some >> 32, some & 0xFFFFFFFF)
            out[new] = answer[back]
            self.pairs[slot[new]], self.apart[slot[new]] = key[new], out[new]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order) and len(words[order[at]]) > ALONE:
            out[order[at]] = self._encode_one(words[order[at]])
            at += 1
        while at < len(order):
            many = max(1, TOGETHER // len(words[order[at]]))
            some = order[at : at + many]
            for i, ids in zip(some, self._encode([words[i] for i in some]), strict=True):
                out[i] = ids
            at += many
        return out

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Words from the longest to the shortest."""
        v, sizes = self.v, np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        width = int(sizes[0])
        symbol = np.zeros((len(words), width), dtype=np.int64)
        inside = np.arange(width) < sizes[:, None]
        symbol[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol[np.arange(len(words)), sizes - 1] += 256
        last = np.full((len(words), width + 1), -1, dtype=np.int32)  # token of each prefix
        state, matched = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        alive = np.searchsorted(-sizes, -np.arange(width), side="left")  # words longer than the position
        for i in range(width):
            n = alive[i]
            state[:n], matched[:n] = self._walk(state[:n], matched[:n], symbol[:n, i])
            s = state[:n]
            at = np.where((v.token[s] >= 0) & (matched[:n] == v.length[s]), s, v.above[s])
            row = np.arange(n)
            while len(row):
                begin = i + 1 - v.length[at]
                before, t = last[row, begin], v.token[at]
                good = begin == 0
                good[~good] = self._go_together(before[~good], t[~good])
                last[row[good], i + 1] = t[good]
                row, at = row[~good], v.above[at[~good]]
                if (at == 0).any():
                    raise ValueError("no token fits; a symbol is missing in the vocabulary")
        size_of = np.where(v.token >= 0, v.length, 0)
        token_size = np.zeros(len(v.tokens), dtype=np.int64)
        token_size[v.token[v.token >= 0]] = size_of[v.token >= 0]
        # Follow the tokens back from the ends of all words at once.
        ids, rows, where = [], np.arange(len(words)), sizes.copy()
        who = []
        while len(rows):
            t = last[rows, where]
            ids.append(t)
            who.append(rows)
            where = where - token_size[t]
            rows, where = rows[where > 0], where[where > 0]
        who, ids = np.concatenate(who), np.concatenate(ids)
        back = np.lexsort((-np.arange(len(who)), who))
        ids, counts = ids[back].astype("<u4").tobytes(), np.bincount(who, minlength=len(words))
        end = 0
        for k in (counts * 4).tolist():
            yield ids[end : end + k]
            end += k

    def _encode_one(self, word: bytes) -> bytes:
        """One long word: the same in plain numbers, as arrays of one row are slow."""
        v, known = self.v, {}
        if not self.ways:
            self.ways = dict(zip(v.edge.tolist(), v.target.tolist(), strict=True))
            self.ranks = dict(zip(v.pair.tolist(), v.pair_rank.tolist(), strict=True))
            self.trees = v.born.tolist(), v.left.tolist(), v.right.tolist()
            self.states = list(zip(*(x.tolist() for x in (v.link, v.length, v.token, v.above)), strict=True))
        ways, states = self.ways, self.states
        symbols = [*word[:-1], word[-1] + 256]
        last = array("i", [-1]) * (len(symbols) + 1)
        state = matched = 0
        for i, c in enumerate(symbols):
            while (to := ways.get(state << 9 | c)) is None:
                if state == 0:
                    raise ValueError("a symbol is missing in the vocabulary")
                state = states[state][0]
                matched = states[state][1]
            state, matched = to, matched + 1
            _, length, t, above = states[state]
            at = state if t >= 0 and matched == length else above
            while last[i + 1] < 0:
                if at == 0:
                    raise ValueError("no token fits; a symbol is missing in the vocabulary")
                _, length, t, above = states[at]
                before = last[i + 1 - length]
                if i + 1 > length and (before, t) not in known:
                    known[before, t] = self._apart_one(before, t)
                if i + 1 == length or known[before, t]:
                    last[i + 1] = t
                at = above
        ids, where = [], len(symbols)
        size = {t: length for _, length, t, _ in states}
        while where:
            ids.append(last[where])
            where -= size[last[where]]
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _apart_one(self, x: int, y: int) -> bool:
        """`_apart` for one pair."""
        rank_of, (born, left, right) = self.ranks, self.trees
        x_ends = y_ends = int(NEVER)
        while True:
            rank = rank_of.get(x << 32 | y, x_ends)
            if rank < x_ends and rank <= y_ends:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                x_ends, x = born[x], right[x]
            else:
                y_ends, y = born[y], left[y]

    def _walk(self, state: np.ndarray, matched: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more symbol, and the lengths that match."""
        v, state, matched = self.v, state.copy(), matched.copy()
        row = np.arange(len(state))
        while len(row):
            key = state[row] << 9 | symbol[row]
            at = np.minimum(np.searchsorted(v.edge, key), len(v.edge) - 1)
            hit = v.edge[at] == key
            done, row = row[hit], row[~hit]
            state[done] = v.target[at[hit]]
            matched[done] += 1
            if (state[row] == 0).any():
                raise ValueError("a symbol is missing in the vocabulary")
            state[row] = v.link[state[row]]
            matched[row] = v.length[state[row]]
        return state, matched

    def words(self, text: str, exact: bool = False) -> list[str]:
        if exact and self.exact is None:
            self.exact = re.compile(self.v.spelt)
        return (self.exact if exact else self.word).findall(text.lower() if text.isascii() else self.normal.normalize_str(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Texts of `PIECE` characters go together, so that new words are encoded at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in _groups(texts):
            parts = [(row, part, k % 2) for row, piece in group for k, part in enumerate(self.special.split(piece) if self.special else [piece])]
            words = [[] if special else self.words(part) for _, part, special in parts]
            some = {w for ws in words for w in ws}
            odd = self.odd.search(" ".join(some - self.held.keys())) is not None
            if odd:
                words = [[] if special else self.words(part, exact=True) for _, part, special in parts]
                some = {w for ws in words for w in ws}
            ids = self._known(some, hold=not odd)
            for (row, part, special), ws in zip(parts, words, strict=True):
                out[row].append(self.v.special[part].to_bytes(4, "little") if special else b"".join(map(ids.__getitem__, ws)))
        return [b"".join(x) for x in out]

    def _known(self, words: set[str], hold: bool) -> dict[str, bytes]:
        """The ids of some words, and perhaps of others. Words with odd signs are not held, so they are noticed again."""
        new = [w for w in words if w not in self.held]
        if not new:
            return self.held
        now = dict(zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True))
        fits = {w: ids for w, ids in now.items() if hold and len(w) <= LONGEST}
        if len(fits) == len(now) and len(self.held) + len(now) <= CACHE:
            self.held.update(now)
            return self.held
        now.update((w, self.held[w]) for w in words if w in self.held)
        if len(self.held) + len(fits) > CACHE:
            self.held = {}
        if len(fits) <= CACHE:
            self.held.update(fits)
        return now

    def decode(self, ids: bytes) -> str:
        """The tokens side by side, as files without a decoder have it."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BREAK = re.compile(r" (?=[0-9A-Za-z])")


def _pieces(text: str) -> Iterator[str]:
    """Parts of about PIECE characters, cut before blanks that words and composed letters never span."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) lists of about PIECE characters."""
    now, size = [], 0
    for row, text in enumerate(texts):
        for piece in _pieces(text or ""):
            if now and size + len(piece) > PIECE:
                yield now
                now, size = [], 0
            now.append((row, piece))
            size += len(piece)
    if now:
        yield now


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and, if asked for, their decoded text.

    path: tokenizer file, read by the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vars(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at < batch.num_rows and size < PIECE:
                    texts.append(batch.column(1)[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                rows = encoder.encode(texts)
                columns = [batch.column(0).slice(at - len(rows), len(rows)), pa.array(rows, pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.decode(r) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id bigint, ids binary" + (", decoded string" if decoded else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract of op13: how many ids a document has, and hashes of them and of their decoded text."""
    return encode(docs, path, decoded=True).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
